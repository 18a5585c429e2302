"""Keyed processors over streams, each a small fold whose state Spark checkpoints."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.operators.features import AVERAGES, FEATURES, WARMUP
from barflow.operators.ledger import Book, Holding, Rules, money
from barflow.plans.rolling import exact_deviation, log_change, over, quotient, ratio, volatility
from barflow.plans.rolling import mean as mean_of


def keyed(stream: DataFrame, key: str, order: list[str], fold: Callable[[dict | None, pd.DataFrame], tuple[dict, Iterable[tuple]]], schema: str) -> DataFrame:
    """Run ``fold`` over each key's new rows in ``order``; its state is kept as JSON between micro-batches.

    Rows of one micro-batch come unordered, so they are sorted here, and a micro-batch is bounded by its files; a row older than the state is for the
    fold to judge.
    """

    names = [c.split()[0] for c in schema.split(", ")]

    def run(keys, frames, state):
        held = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
        held, out = fold(held, rows)
        state.update((json.dumps(held),))
        yield pd.DataFrame([(keys[0], *x) for x in out], columns=names)

    return stream.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")


# --- bars ---------------------------------------------------------------------------------------


def fresh_rows(rows: pd.DataFrame, time: str, last: int | None) -> np.ndarray:
    """Which of the sorted rows are newer than ``last`` and than every row before them."""
    at = rows[time].to_numpy(np.int64)
    newest = np.maximum.accumulate(np.r_[-(2**62) if last is None else last, at])[:-1]
    return at > newest


def averaged(state: dict, rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """The exponential averages after each row, from the list that batches use; ``state`` (n, close, means) is brought up to date."""
    means, out = state["means"], {a.name: np.empty(len(rows)) for a in AVERAGES}
    for i, (high, low, close) in enumerate(zip(rows["high"], rows["low"], rows["close"])):
        before = close if state["close"] is None else state["close"]
        inputs = {"close": close, "rise": max(close - before, 0.0), "fall": max(before - close, 0.0), "reach": high - low if state["close"] is None else max(high - low, abs(high - before), abs(low - before))}
        for a in AVERAGES:
            x = means["ema12"] - means["ema26"] if a.of == "spread" else inputs[a.of]
            out[a.name][i] = means[a.name] = float(a.after(means.get(a.name, 0.0), x, state["n"]))
        state["n"], state["close"] = state["n"] + 1, float(close)
    return out


def look_back(kept: list, rows: pd.DataFrame, mean: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The features of ``rows``, whose WARMUP - 1 rows before are ``kept``, one line for each row, and where a feature is no number rather than missing, as 0 / 0 is."""
    close, volume, trades = np.array([*map(tuple, kept), *zip(rows["close"], rows["volume"], rows["trades"])], float).T
    own = slice(len(kept), None)
    price, ma20, sd20 = close[own], over(close, 20, mean_of)[own], over(close, 20, exact_deviation)[own]
    span, paid = (rows["high"] - rows["low"]).to_numpy(float), rows["volume"].to_numpy(float)
    both, changes = mean["gain"] + mean["loss"], {k: log_change(close, k) for k in (1, 5, 15)}
    # of prices, which may be 0: values and where they are no number
    priced = {
        **{f"ret_{k}": (x[own], lost[own]) for k, (x, lost) in changes.items()}, "rvol_20": tuple(x[own] for x in volatility(*changes[1], 20)),
        "dist_ma_50": ratio(price, over(close, 50, mean_of)[own]), "atr_pct_14": ratio(mean["atr"], price),
        "macd_hist_pct": ratio(mean["ema12"] - mean["ema26"] - mean["signal"], price), "range_pct": ratio(span, price),
    }
    values = {c: x for c, (x, _) in priced.items()} | {
        "bb_z_20": np.where(sd20 > 0, quotient(price - ma20, sd20, sd20 > 0), 0.0), "dist_ma_50": priced["dist_ma_50"][0] - 1,
        "rsi_14": (np.where(both > 0, 100 * quotient(mean["gain"], both, both > 0), 50.0) - 50) / 50,
        "rel_volume": np.log((volume[own] + 1e-9) / (over(volume, 20, mean_of)[own] + 1e-9)), "rel_trades": np.log((trades[own] + 1) / (over(trades, 20, mean_of)[own] + 1)),
        "body_ratio": np.where(span > 0, quotient((rows["close"] - rows["open"]).to_numpy(float), span, span > 0), 0.0),
        "taker_imbalance": np.where(paid > 0, quotient(rows["taker"].to_numpy(float), paid, paid > 0) - 0.5, 0.0),
    }
    never = np.zeros(len(rows), bool)
    return np.stack([values[c] for c in FEATURES], axis=1), np.stack([priced[c][1] if c in priced else never for c in FEATURES], axis=1)


def plain(values: np.ndarray) -> list[float | None]:
    return [None if x != x else float(x) for x in values]


# --- scoring and ledgers ------------------------------------------------------------------------


def stream_ledger(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Closed trades as they close, from bars and the signals beside them (null for none), which fill at once where they have a price: the batch ledger's book, remembered between micro-batches."""

    def fold(s, rows):
        s = s or {"n": 0, "cash": rules.cash, "own": None, "waiting": None, "times": {}, "last": -(2**62)}
        book = Book(rules, Holding(**s["own"]) if s["own"] else None, tuple(s["waiting"]) if s["waiting"] else None)
        out = []
        for row in rows.itertuples(index=False):
            if row.t <= s["last"]:
                continue
            s["last"], at = int(row.t), s["n"]
            s["times"][str(at)] = int(row.t)
            done = book.bar(at, float(row.open), float(row.high), float(row.low), float(row.close))
            if isinstance(row.signal, str):
                done += book.signal(at, getattr(row, "price", None), row.signal, int(row.horizon), float(row.edge_bps), None, None, None)
            for h in done:
                m = money(h, s["cash"], rules)
                if m:
                    s["cash"] += m["pnl"]
                    out.append(("LONG" if h.side > 0 else "SHORT", s["times"][str(h.entry)], s["times"][str(h.exit)], m["pnl"], h.held, h.reason))
            needed = {str(at), str(book.own.entry)} if book.own else {str(at)}
            s["times"] = {k: v for k, v in s["times"].items() if k in needed}
            s["n"] += 1
        s["own"], s["waiting"] = asdict(book.own) if book.own else None, book.waiting
        return s, out

    return keyed(events, "symbol", ["t"], fold, "symbol string, side string, entry_time long, exit_time long, pnl double, bars long, reason string")
