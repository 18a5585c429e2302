"""Stateful processors with typed value, list and map state; what a micro-batch writes follows its own rows, not the length of the window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barflow.operators.features import AVERAGES, FEATURES, WARMUP, with_last_averages
from barflow.operators.micro import REGIMES, regimes_of, with_lost
from barflow.plans.blocks import numbered
from barflow.sources.frames import last_n
from barflow.streaming.stateful import averaged, fresh_rows, look_back, plain

BEFORE_ALL = -(2**62)


def _sorted(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """All of a key's rows of one micro-batch, which its files bound, in order."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable", ignore_index=True)


class Features(StatefulProcessor):
    """The averages and counts of a symbol as one value, the rows that the next bar looks back on as a list; a batch of history may start both."""

    SO_FAR = "n long, close double, last long, gaps long, late long, means array<double>"

    def __init__(self, interval: int) -> None:
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.so_far = handle.getValueState("so_far", self.SO_FAR)
        self.kept = handle.getListState("kept", "close double, volume double, trades double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        n, close, last, gaps, late, means = self.so_far.get() if self.so_far.exists() else (0, None, None, 0, 0, [])
        rows = _sorted(rows, "open_time")
        fresh = fresh_rows(rows, "open_time", last)
        lates = late + np.cumsum(~fresh)[fresh]
        late += int((~fresh).sum())
        rows = rows[fresh]
        if len(rows):
            at = rows["open_time"].to_numpy(np.int64)
            counted = gaps + np.cumsum(np.diff(at, prepend=at[0] - self.interval if last is None else last) != self.interval)
            valid = n + np.arange(1, len(rows) + 1) >= WARMUP
            state = {"n": n, "close": close, "means": dict(zip([a.name for a in AVERAGES], means or []))}
            kept = [tuple(x) for x in self.kept.get()] if self.kept.exists() else []
            values, lost = look_back(kept, rows, averaged(state, rows))
            own = list(zip(rows["close"].astype(float), rows["volume"].astype(float), rows["trades"].astype(float)))
            self.kept.put([*kept, *own][-(WARMUP - 1) :])
            n, close, last, gaps, means = state["n"], state["close"], int(at[-1]), int(counted[-1]), [float(state["means"][a.name]) for a in AVERAGES]
            out = [(key[0], int(t), bool(v), int(g), int(d), *(plain(x) if v else [None] * len(FEATURES)), [FEATURES[i] for i in np.flatnonzero(nan & v)]) for t, v, g, d, x, nan in zip(at, valid, counted, lates, values, lost)]
            yield pd.DataFrame(out, columns=["symbol", "open_time", "valid", "gaps", "late", *FEATURES, "lost"])
        self.so_far.update((n, close, last, gaps, late, means))

    def handleInitialState(self, key, initialState, timerValues):  # noqa: N802, N803
        row = initialState.iloc[0]
        self.so_far.update((int(row["n"]), float(row["close"]), int(row["last"]), int(row["gaps"]), 0, [float(x) for x in row["means"]]))
        self.kept.put([(float(x["close"]), float(x["volume"]), float(x["trades"])) for x in row["kept"]])

    def close(self) -> None:
        pass


def feature_state(history: DataFrame, interval: int) -> DataFrame:
    """What :class:`Features` knows after ``history``, one row a symbol, by the batch plan: neither the averages nor the gaps are folded row by row."""
    rows = numbered(history)
    gap = rows.groupBy("symbol").agg(F.max("rn").alias("rn"), F.count("*").alias("n"))
    means = with_last_averages(rows).select("symbol", F.col("close"), F.col("open_time").alias("last"), "means")
    tail = last_n(rows, "symbol", ["open_time"], WARMUP - 1)
    kept = tail.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("open_time", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"), F.col("trades").cast("double").alias("trades")))), lambda x: x.dropFields("open_time")).alias("kept"))
    follows = rows.select("symbol", (F.col("rn") + 1).alias("rn"), F.col("open_time").alias("before_"))
    jumps = rows.select("symbol", "rn", "open_time").join(follows, ["symbol", "rn"]).groupBy("symbol").agg(F.count_if(F.col("open_time") - F.col("before_") != interval).alias("gaps"))
    return gap.select("symbol", "n").join(means, "symbol").join(kept, "symbol").join(jumps, "symbol", "left").select("symbol", "n", "close", "last", F.coalesce("gaps", F.lit(0)).alias("gaps"), "means", "kept")


def stream_features(bars: DataFrame, interval: int, history: DataFrame | None = None) -> DataFrame:
    """The fourteen features of each closed bar as it comes, equal to the batch result; a bar no later than the last one is dropped, gaps are counted, not repaired.

    With ``history``, a batch of earlier bars, the state begins as if these had streamed before: see :func:`feature_state`.
    """
    schema = "symbol string, open_time long, valid boolean, gaps long, late long, " + ", ".join(f"{c} double" for c in FEATURES) + ", lost array<string>"
    start = None if history is None else feature_state(history, interval).groupBy("symbol")
    rows = bars.groupBy("symbol").transformWithStateInPandas(Features(interval), schema, "Append", "None", initialState=start)
    # pandas has one mark for null and NaN, so the features that are NaN come by name
    return rows.withColumns({c: F.when(F.array_contains("lost", c), float("nan")).otherwise(F.col(c)) for c in FEATURES}).drop("lost")


class Imbalance(StatefulProcessor):
    """The book imbalance and its exponential average, a value of two numbers."""

    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.so_far = handle.getValueState("so_far", "ewma double, last long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        ewma, last = self.so_far.get() if self.so_far.exists() else (0.0, None)
        rows = _sorted(rows, "update_id")
        rows = rows[fresh_rows(rows, "update_id", last)]
        out = []
        for b in rows.itertuples(index=False):
            total = b.bid_qty + b.ask_qty
            obi = (b.bid_qty - b.ask_qty) / total if total > 0 else 0.0
            ewma, last = ewma + self.alpha * (obi - ewma), int(b.update_id)
            out.append((key[0], last, obi, ewma))
        if out:
            self.so_far.update((ewma, last))
            yield pd.DataFrame(out, columns=["symbol", "update_id", "obi", "obi_ewma"])

    def close(self) -> None:
        pass


def stream_obi(books: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Imbalance and its exponential average after each update, in update order; updates no newer than the last are dropped."""
    return books.groupBy("symbol").transformWithStateInPandas(Imbalance(alpha), "symbol string, update_id long, obi double, obi_ewma double", "Append", "None")


class Regimes(StatefulProcessor):
    """Closes by their number as a map: a micro-batch writes its own and removes as many old ones."""

    def __init__(self, *of) -> None:
        self.bars_per_year, self.vol, self.path, self.history, self.enough = of

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.so_far = handle.getValueState("so_far", "n long, last long")
        self.closes = handle.getMapState("closes", "place long", "close double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        n, last = self.so_far.get() if self.so_far.exists() else (0, None)
        rows = _sorted(rows, "open_time")
        rows = rows[fresh_rows(rows, "open_time", last)]
        if not len(rows):
            return
        before = sorted((k[0], v[0]) for k, v in self.closes.iterator()) if n else []
        closes = np.array([*[x for _, x in before], *rows["close"]], float)
        made = {name: x[len(before) :] for name, x in zip(REGIMES, regimes_of(closes, self.bars_per_year, self.vol, self.path, self.history, self.enough))}
        after, reach = n + len(rows), self.history + self.vol
        for place, _ in before:
            if place < after - reach:
                self.closes.removeKey((place,))
        for place, close in list(enumerate(rows["close"], n))[-reach:]:
            self.closes.updateValue((place,), (float(close),))
        self.so_far.update((after, int(rows["open_time"].iloc[-1])))
        yield pd.DataFrame({"symbol": key[0], "open_time": rows["open_time"].to_numpy(), **made, "rv": plain(made["rv"]), "efficiency": plain(made["efficiency"])})

    def close(self) -> None:
        pass


def stream_regimes(bars: DataFrame, bars_per_year: float, vol: int = 60, path: int = 30, history: int = 1440, enough: int = 100) -> DataFrame:
    """Volatility and trend regimes, updated on bar close only; a micro-batch is worked on as a whole."""
    schema = "symbol string, open_time long, rv double, lost boolean, vol_regime string, efficiency double, trend_regime string"
    return with_lost(bars.groupBy("symbol").transformWithStateInPandas(Regimes(bars_per_year, vol, path, history, enough), schema, "Append", "None"))


#: Seconds of a block of state: a call for each block, not for each second, since a call costs as much as thousands of sums.
BLOCK = 600
SUMS = "sec array<long>, buy array<double>, sell array<double>, n array<double>, notional array<double>"


def kept_sums(blocks) -> tuple[np.ndarray, np.ndarray]:
    """Seconds, ascending, and their four sums, out of a map of blocks."""
    rows = np.array(sorted(row for _, block in blocks.iterator() for row in zip(*block)), float).reshape(-1, 5)
    return rows[:, 0].astype(np.int64), rows[:, 1:]


def keep_sums(blocks, before: np.ndarray, secs: np.ndarray, sums: np.ndarray, touched: np.ndarray) -> None:
    """Let the map have ``sums`` of the ascending ``secs``: only the blocks of seconds that were touched, or are gone since ``before``, are written."""
    had = set((before // BLOCK).tolist())
    for b in set((np.intersect1d(touched, secs) // BLOCK).tolist()) | set((np.setdiff1d(before, secs) // BLOCK).tolist()):
        own = slice(*np.searchsorted(secs, [b * BLOCK, (b + 1) * BLOCK]))
        if own.start < own.stop:
            blocks.updateValue((b,), (secs[own].tolist(), *sums[own].T.tolist()))
        elif b in had:
            blocks.removeKey((b,))


def running(parts: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, .. rows, with digits to spare, since windows are differences of them."""
    return np.concatenate([np.zeros((1, parts.shape[1]), np.longdouble), np.cumsum(parts, axis=0, dtype=np.longdouble)])


def flow_of(buy: np.ndarray, sell: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(buy + sell > 0, (buy - sell) / (buy + sell), 0.0)


def vwap_of(notional: np.ndarray, volume: np.ndarray, default) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(volume > 0, notional / volume, default)


class Rolled(StatefulProcessor):
    """Buckets of one second in blocks of a map; each new one gives the sums over two spans that end with it, and those that no later one can ask for are removed."""

    def __init__(self, short_s: int, long_s: int) -> None:
        self.short_s, self.long_s = short_s, long_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "block long", SUMS)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        rows = _sorted(rows, "sec")
        before, sums = kept_sums(self.blocks)
        secs, sums = np.concatenate([before, rows["sec"].to_numpy(np.int64)]), np.concatenate([sums, rows[["buy", "sell", "n", "notional"]].to_numpy(float)])
        upto, new = running(sums), np.arange(len(before), len(secs))
        starts = [np.searchsorted(secs, secs[new] - span, "right") for span in (self.short_s, self.long_s)]
        (b1, s1, n1, _), (b2, s2, _, x2) = ((upto[new + 1] - upto[start]).astype(float).T for start in starts)
        first = starts[1][-1]  # no later second asks for those before it
        keep_sums(self.blocks, before, secs[first:], sums[first:], secs[new])
        yield pd.DataFrame({"symbol": key[0], "sec": secs[new], "flow_short": flow_of(b1, s1), "flow_long": flow_of(b2, s2), "trade_rate": n1 / self.short_s, "vwap": plain(vwap_of(x2, b2 + s2, np.nan))})

    def close(self) -> None:
        pass


def stream_flow(trades: DataFrame, short_s: int, long_s: int, late: str = "300 seconds") -> DataFrame:
    """Order flow over two spans of seconds after each second that has a trade: (symbol, sec, flow_short, flow_long, trade_rate, vwap).

    Two stateful steps under one watermark: trades become sums by second, which leave the first step once the watermark has passed them, so that they
    come to the second step whole, once and in order. Trades later than ``late`` behind the newest are dropped.
    """
    maker = F.col("is_buyer_maker")
    timed = trades.withColumn("at_", F.timestamp_millis("trade_time")).withWatermark("at_", late)
    seconds = timed.groupBy("symbol", F.window("at_", "1 second").alias("w_")).agg(
        F.sum(F.when(~maker, F.col("qty")).otherwise(0.0)).alias("buy"), F.sum(F.when(maker, F.col("qty")).otherwise(0.0)).alias("sell"),
        F.count("*").alias("n"), F.sum(F.col("price") * F.col("qty")).alias("notional"),
    )
    rows = seconds.select("symbol", F.floor(F.unix_millis("w_.start") / 1000).alias("sec"), "buy", "sell", "n", "notional")
    return rows.groupBy("symbol").transformWithStateInPandas(Rolled(short_s, long_s), "symbol string, sec long, flow_short double, flow_long double, trade_rate double, vwap double", "Append", "None")


class Snapshots(StatefulProcessor):
    """The last quote and the next due time as a value, trades as sums by second in blocks of a map; only blocks whose seconds a micro-batch touched or outlived are written."""

    def __init__(self, every_ms: int, short_s: int, long_s: int) -> None:
        self.every_ms, self.short_s, self.long_s = every_ms, short_s, long_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.so_far = handle.getValueState("so_far", "bid double, ask double, bid_qty double, ask_qty double, due long")
        self.blocks = handle.getMapState("blocks", "block long", SUMS)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        *book, due = self.so_far.get() if self.so_far.exists() else (None, None, None, None, BEFORE_ALL)
        rows = _sorted(rows, "sent", "kind")
        sent, kind = rows["sent"].to_numpy(np.int64), rows["kind"].to_numpy()
        quotes = np.concatenate([np.array([book], float), rows.loc[kind == "book", ["bid", "ask", "bid_qty", "ask_qty"]].to_numpy(float)])
        quoted = np.cumsum(kind == "book")  # place in quotes of the last one at each message; 0 is that of the state
        at = self.places(sent, kind, 0 if book[0] is not None else int(np.searchsorted(quoted, 1)), due)

        dealt = rows[kind == "trade"]
        sold, qty = dealt["is_buyer_maker"].to_numpy(bool), dealt["qty"].to_numpy(float)
        new = np.column_stack([np.where(sold, 0.0, qty), np.where(sold, qty, 0.0), np.ones(len(dealt)), dealt["price"].to_numpy(float) * qty])
        own, (before, sums) = dealt["sent"].to_numpy(np.int64) // 1000, kept_sums(self.blocks)
        upto, old, now = running(new), running(sums), sent[at] // 1000
        ends = np.cumsum(kind == "trade")[at]
        (b1, s1, n1, _), (b2, s2, _, x2) = ((upto[ends] - upto[np.searchsorted(own, now - span, "right")] + old[-1] - old[np.searchsorted(before, now - span, "right")]).astype(float).T for span in (self.short_s, self.long_s))

        secs, place = np.unique(np.concatenate([before, own]), return_inverse=True)
        whole = np.column_stack([np.bincount(place, x, len(secs)) for x in np.concatenate([sums, new]).T])
        first = np.searchsorted(secs, now[-1] - self.long_s, "right") if len(at) else 0
        keep_sums(self.blocks, before, secs[first:], whole[first:], own)
        if len(at):
            due = int(sent[at[-1]]) + self.every_ms
        self.so_far.update((*(quotes[-1].tolist() if len(quotes) > 1 else book), due))
        if len(at):
            bid, ask, bq, aq = quotes[quoted[at]].T
            mid = (bid + ask) / 2
            yield pd.DataFrame({"symbol": key[0], "sent": sent[at], "kind": kind[at], "mid": mid, "obi": flow_of(bq, aq), "flow": flow_of(b1, s1), "trade_rate": n1 / self.short_s, "vwap": vwap_of(x2, b2 + s2, mid)})

    def places(self, sent: np.ndarray, kind: np.ndarray, first: int, due: int) -> np.ndarray:
        """Messages that give a row, from ``first`` on: bars, and the first one that is due after each row."""
        bars = np.flatnonzero(kind == "bar")
        found, at = [], first
        while at < len(sent):
            bar = np.searchsorted(bars, at)
            at = min(max(at, int(np.searchsorted(sent, due))), int(bars[bar]) if bar < len(bars) else len(sent))
            if at < len(sent):
                found.append(at)
                due, at = int(sent[at]) + self.every_ms, at + 1
        return np.array(found, np.int64)

    def close(self) -> None:
        pass


def stream_snapshots(tagged: DataFrame, every_ms: int, short_s: int, long_s: int) -> DataFrame:
    """One row per symbol at most every ``every_ms`` of event time, plus one at each bar's close; none before the first quote.

    ``tagged``: symbol, sent, kind (book, trade, bar), bid, ask, bid_qty, ask_qty, price, qty, is_buyer_maker. Trades count while their second is within the long span.
    A message that is older than what its symbol had in an earlier micro-batch counts in its own second.
    """
    schema = "symbol string, sent long, kind string, mid double, obi double, flow double, trade_rate double, vwap double"
    return tagged.groupBy("symbol").transformWithStateInPandas(Snapshots(every_ms, short_s, long_s), schema, "Append", "None")
