"""Order flow, book, regimes and time joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.catalog import query
from barflow.catalog.common import FEATURES_SQL, M15, NUMBERED, W, YEAR_BARS, back, pick, r, rounded
from barflow.operators import features as X
from barflow.operators import micro as M
from barflow.plans.blocks import Blocked, blocked, numbered
from barflow.sources import adapters as A

_SEC = f"""{A.SQL_TRADES}, sec AS (SELECT symbol, trade_time // 1000 AS sec, sum(CASE WHEN NOT is_buyer_maker THEN qty ELSE 0 END) AS buy, sum(CASE WHEN is_buyer_maker THEN qty ELSE 0 END) AS sell,
  count(*) AS n, sum(price * qty) AS notional FROM trades GROUP BY ALL)"""


@query(f"WITH {_SEC} SELECT symbol, sec, buy, sell, n, round(notional, 6) + 0.0 AS notional FROM sec")
def trade_buckets_1s(spark, sf_dir):
    return M.second_buckets(A.trades(spark, sf_dir)).select("symbol", "sec", "buy", "sell", "n", r("notional").alias("notional"))


_FLOW = ("flow_short", "flow_long", "trade_rate", "vwap")


_FLOW_SQL = f"""WITH {_SEC}, w AS (SELECT symbol, sec, sum(buy) OVER a AS b1, sum(sell) OVER a AS s1, sum(n) OVER a AS n1, sum(buy) OVER b AS b5, sum(sell) OVER b AS s5, sum(notional) OVER b AS x5 FROM sec
  WINDOW a AS (PARTITION BY symbol ORDER BY sec RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY sec RANGE BETWEEN 17999 PRECEDING AND CURRENT ROW))
SELECT symbol, sec, round((b1 - s1) / (b1 + s1), 6) + 0.0 AS flow_short, round((b5 - s5) / (b5 + s5), 6) + 0.0 AS flow_long, round(n1 / 3600.0, 6) + 0.0 AS trade_rate, round(x5 / (b5 + s5) + 1e-9, 6) AS vwap FROM w"""


@query(_FLOW_SQL)
def flow_imbalance(spark, sf_dir):
    """Trades are minutes apart here, so the spans are an hour and five hours. vwap is moved off the ties of rounding, which the order of a sum decides."""
    rows = M.flow(M.second_buckets(A.trades(spark, sf_dir)), 3600, 18_000)
    return pick(rows.withColumn("vwap", F.col("vwap") + 1e-9), "symbol sec", _FLOW)


_BOOK = ("mid", "spread_bps", "microprice", "obi")
_BOOK_SQL = f"""{A.SQL_BOOKS}, m AS (SELECT *, 0.5::DOUBLE * (bid + ask) AS mid, (ask - bid) / (0.5::DOUBLE * (bid + ask)) * 1e4 AS spread_bps, (ask * bid_qty + bid * ask_qty) / (bid_qty + ask_qty) AS microprice,
  (bid_qty - ask_qty) / (bid_qty + ask_qty) AS obi FROM books)"""


@query(f"WITH {_BOOK_SQL} SELECT symbol, update_id, {rounded(_BOOK, 9)} FROM m")
def book_metrics(spark, sf_dir):
    return pick(M.book_metrics(A.books(spark, sf_dir)), "symbol update_id", _BOOK, 9)


@query(f"""WITH RECURSIVE {_BOOK_SQL}, k AS (SELECT symbol, update_id, obi, row_number() OVER (PARTITION BY symbol ORDER BY update_id) - 1 AS rn FROM m),
 s AS (SELECT symbol, update_id, rn, 0.05::DOUBLE * obi AS e FROM k WHERE rn = 0 UNION ALL SELECT k.symbol, k.update_id, k.rn, s.e + 0.05::DOUBLE * (k.obi - s.e) FROM s JOIN k ON k.symbol = s.symbol AND k.rn = s.rn + 1)
SELECT symbol, update_id, round(e, 6) + 0.0 AS obi_ewma FROM s""")
def obi_ewma(spark, sf_dir):
    return pick(M.obi_ewma(A.books(spark, sf_dir)), "symbol update_id", "obi_ewma")


_REGIME = f"""{A.sql_bars()}, {NUMBERED}, s AS (SELECT *, ln(close / lag(close) OVER ({W})) AS r1, abs(close - lag(close) OVER ({W})) AS d1, close - lag(close, 30) OVER ({W}) AS net FROM numbered),
 v AS (SELECT *, CASE WHEN rn >= 60 THEN stddev_samp(r1) OVER {back(60)} * sqrt({YEAR_BARS}::DOUBLE) END AS rv, sum(d1) OVER {back(30)} AS moved FROM s),
 p AS (SELECT *, list(rv) FILTER (rv IS NOT NULL) OVER {back(1440)} AS past, CASE WHEN rn >= 30 THEN CASE WHEN moved > 0 THEN abs(net) / moved ELSE 0 END END AS efficiency FROM v),
 regimes AS (SELECT *, CASE WHEN len(past) >= 100 AND rv IS NOT NULL THEN len(list_filter(past, lambda x: x <= rv)) / CAST(len(past) AS DOUBLE) END AS share FROM p)"""


def _regimes(spark, sf_dir):
    return M.regimes(A.bars(spark, sf_dir), YEAR_BARS)


@query(f"WITH {_REGIME} SELECT symbol, open_time, round(rv, 6) + 0.0 AS rv FROM regimes")
def rv_annualised(spark, sf_dir):
    return pick(_regimes(spark, sf_dir), "symbol open_time", "rv")


@query(f"WITH {_REGIME} SELECT symbol, open_time, CASE WHEN share > 0.8 THEN 'HIGH' WHEN share < 0.2 THEN 'LOW' ELSE 'NORMAL' END AS vol_regime FROM regimes")
def vol_regime(spark, sf_dir):
    return _regimes(spark, sf_dir).select("symbol", "open_time", "vol_regime")


@query(f"WITH {_REGIME} SELECT symbol, open_time, round(efficiency, 6) + 0.0 AS efficiency, CASE WHEN efficiency > 0.3 THEN CASE WHEN net > 0 THEN 'TREND_UP' ELSE 'TREND_DOWN' END ELSE 'RANGE' END AS trend_regime FROM regimes")
def trend_regime(spark, sf_dir):
    return _regimes(spark, sf_dir).select("symbol", "open_time", r("efficiency").alias("efficiency"), "trend_regime")


@query(f"WITH RECURSIVE {FEATURES_SQL} SELECT symbol, open_time, CASE WHEN rsi_14 * 50 + 50 > 55 THEN 'OVERBOUGHT' WHEN rsi_14 * 50 + 50 < 45 THEN 'OVERSOLD' ELSE 'NEUTRAL' END AS momentum_state FROM features")
def momentum_state(spark, sf_dir):
    """With bounds of 55 and 45: the series here seldom leave 30 to 70."""
    rsi = F.col("rsi_14") * 50 + 50
    state = F.when(rsi > 55, "OVERBOUGHT").when(rsi < 45, "OVERSOLD").otherwise("NEUTRAL")
    return X.features_14(A.bars(spark, sf_dir)).select("symbol", "open_time", state.alias("momentum_state"))


_CONTEXT = ("return_bps_1h", "return_bps_4h", "return_bps_24h", "vol_bps_24h", "high_day", "low_day", "pos_in_day")
_CONTEXT_SQL = f"""WITH {A.sql_bars()}, {NUMBERED}, a AS (SELECT *, ln(close / lag(close) OVER ({W})) AS r1 FROM numbered), c AS (SELECT symbol, open_time, close, ln(close / lag(close, 60) OVER ({W})) * 1e4 AS return_bps_1h,
  ln(close / lag(close, 240) OVER ({W})) * 1e4 AS return_bps_4h, ln(close / lag(close, 1440) OVER ({W})) * 1e4 AS return_bps_24h, CASE WHEN rn >= 1440 THEN stddev_pop(r1) OVER {back(1440)} * 1e4 END AS vol_bps_24h,
  max(high) OVER {back(1440)} AS high_day, min(low) OVER {back(1440)} AS low_day FROM a), d AS (SELECT *, CASE WHEN high_day > low_day THEN round((close - low_day) / (high_day - low_day), 2) ELSE 0.5 END AS pos_in_day FROM c)"""


def _context(spark, sf_dir):
    return M.price_context(A.bars(spark, sf_dir), {"1h": 60, "4h": 240, "24h": 1440}, {"24h": 1440}, 1440)


@query(f"{_CONTEXT_SQL} SELECT symbol, open_time, {rounded(_CONTEXT[:-1], 4)} FROM d")
def price_context(spark, sf_dir):
    return pick(_context(spark, sf_dir), "symbol open_time", _CONTEXT[:-1], 4)


@query(f"{_CONTEXT_SQL} SELECT symbol, open_time, pos_in_day + 0.0 AS pos_in_day FROM d")
def price_context_pos(spark, sf_dir):
    return pick(_context(spark, sf_dir), "symbol open_time", "pos_in_day", 2)


@query(f"""WITH {A.SQL_BOOKS}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol, book_time // 21600000 ORDER BY book_time DESC, update_id DESC) AS k FROM books)
SELECT symbol, update_id, book_time FROM b WHERE k = 1""")
def throttle_250ms(spark, sf_dir):
    """The last quote of each bucket of event time (six hours here, as quotes are minutes apart)."""
    last = A.books(spark, sf_dir).groupBy("symbol", F.floor(F.col("book_time") / 21_600_000)).agg(F.max(F.struct("book_time", "update_id")).alias("x"))
    return last.select("symbol", "x.update_id", "x.book_time")


_ASOF = f"""WITH {A.sql_bars()}, {A.SQL_BOOKS}"""


@query(f"""{_ASOF} SELECT b.symbol, b.open_time, k.update_id, round(k.bid, 6) + 0.0 AS bid FROM bars b ASOF LEFT JOIN books k ON b.symbol = k.symbol AND b.close_time >= k.book_time""")
def asof_snapshot(spark, sf_dir):
    """The latest quote at or before each bar's close."""
    found = M.asof(A.bars(spark, sf_dir), A.books(spark, sf_dir), "close_time", "book_time", ["update_id", "bid"])
    return found.select("symbol", "open_time", "update_id", r("bid").alias("bid"))


@query(f"""{_ASOF},
 a AS (SELECT b.symbol, b.update_id, b.book_time, t.trade_id, t.price FROM books b ASOF LEFT JOIN trades t ON b.symbol = t.symbol AND b.book_time >= t.trade_time)
SELECT a.symbol, a.update_id, a.trade_id, round(a.price, 6) + 0.0 AS price, k.open_time, round(k.close, 6) + 0.0 AS close FROM a ASOF LEFT JOIN bars k ON a.symbol = k.symbol AND a.book_time >= k.close_time""")
def asof_book_state(spark, sf_dir):
    """Each quote with the last trade and the last closed bar."""
    first = M.asof(A.books(spark, sf_dir).select("symbol", "update_id", "book_time"), A.trades(spark, sf_dir), "book_time", "trade_time", ["trade_id", "price"]).drop("trade_time_asof")
    both = M.asof(first, A.bars(spark, sf_dir), "book_time", "close_time", ["open_time", "close"])
    return both.select("symbol", "update_id", "trade_id", r("price").alias("price"), "open_time", r("close").alias("close"))


@query(f"""WITH {A.sql_bars()}, n AS (SELECT symbol, open_time, row_number() OVER ({W}) - 1 AS rn FROM bars), t AS (SELECT symbol, trade_id, trade_time FROM trades)
SELECT t.symbol, t.trade_id, n.rn AS bar FROM t ASOF LEFT JOIN n ON t.symbol = n.symbol AND t.trade_time >= n.open_time""")
def asof_searchsorted(spark, sf_dir):
    """Number of the bar that an arbitrary time falls in (the last that opened by then)."""
    picked = A.trades(spark, sf_dir).select("symbol", "trade_id", "trade_time")
    return M.asof(picked, numbered(A.bars(spark, sf_dir)), "trade_time", "open_time", ["rn"]).select("symbol", "trade_id", F.col("rn").alias("bar"))


@query(f"""WITH {A.sql_bars(M15)} SELECT b.symbol, b.open_time, count(t.trade_id) AS trades_hour, coalesce(sum(t.qty), 0) AS qty_hour FROM bars b LEFT JOIN trades t ON t.symbol = b.symbol AND t.trade_time > b.close_time - 3600000 AND t.trade_time <= b.close_time GROUP BY ALL""")
def range_trades_bar(spark, sf_dir):
    """Trades in the hour before each bar's close: an equi join on symbol and hour bucket, then the range."""
    bars = A.bars(spark, sf_dir, M15).select("symbol", "open_time", "close_time")
    hour = F.floor(F.col("close_time") / A.HOUR)
    spread = bars.withColumn("hour_", F.explode(F.array(hour, hour - 1)))
    trades = A.trades(spark, sf_dir).select(F.col("symbol").alias("s_"), F.floor(F.col("trade_time") / A.HOUR).alias("h_"), "trade_time", "qty")
    near = spread.join(trades, (F.col("symbol") == F.col("s_")) & (F.col("hour_") == F.col("h_")), "left")
    inside = (F.col("trade_time") > F.col("close_time") - A.HOUR) & (F.col("trade_time") <= F.col("close_time"))
    return near.groupBy("symbol", "open_time").agg(F.count(F.when(inside, 1)).alias("trades_hour"), F.coalesce(F.sum(F.when(inside, F.col("qty"))), F.lit(0.0)).alias("qty_hour"))


@query(f"WITH {A.sql_bars()} SELECT symbol, open_time, round(lead(open) OVER ({W}), 6) + 0.0 AS fill FROM bars")
def join_next_open(spark, sf_dir):
    b = blocked(numbered(A.bars(spark, sf_dir)), 0, 1)
    return pick(Blocked.home(b.rows.withColumn("fill", F.lead("open").over(b.window))), "symbol open_time", "fill")


@query(f"""WITH {A.sql_bars()}, f AS (SELECT symbol, open_time, ln(close / lag(close, 5) OVER ({W})) AS pred FROM bars), k AS (SELECT * FROM f WHERE abs(pred) > 0.5)
SELECT b.symbol, b.open_time, round(pred, 6) + 0.0 AS pred FROM bars b LEFT JOIN k USING (symbol, open_time)""")
def join_forecast_bar(spark, sf_dir):
    from barflow.operators.labels import past_returns

    bars = A.bars(spark, sf_dir)
    preds = past_returns(bars, (5,)).where("abs(momentum_5) > 0.5").select("symbol", "open_time", F.col("momentum_5").alias("pred"))
    return pick(bars.select("symbol", "open_time").join(preds, ["symbol", "open_time"], "left"), "symbol open_time", "pred")


_TIMES = f"""WITH {A.sql_bars()}, {A.SQL_BOOKS}, asked AS (SELECT symbol, book_time - book_time % {2 * A.HOUR} AS open_time FROM books)"""


def _asked(spark, sf_dir):
    """The even hours in which a symbol has a quote."""
    return A.books(spark, sf_dir).select("symbol", (F.col("book_time") - F.col("book_time") % (2 * A.HOUR)).alias("open_time"))


@query(f"{_TIMES} SELECT symbol, open_time, close FROM bars b WHERE EXISTS (SELECT 1 FROM asked a WHERE a.symbol = b.symbol AND a.open_time = b.open_time)")
def join_times_exact(spark, sf_dir):
    return A.bars(spark, sf_dir).join(_asked(spark, sf_dir), ["symbol", "open_time"], "left_semi").select("symbol", "open_time", "close")


@query(f"{_TIMES} SELECT symbol, open_time, close FROM bars b WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.symbol = b.symbol AND a.open_time = b.open_time)")
def join_cache_anti(spark, sf_dir):
    return A.bars(spark, sf_dir).join(_asked(spark, sf_dir), ["symbol", "open_time"], "left_anti").select("symbol", "open_time", "close")


@query(f"{_TIMES} SELECT symbol, open_time, count(*) AS n FROM (SELECT symbol, open_time FROM bars EXCEPT SELECT symbol, open_time FROM asked) GROUP BY ALL")
def except_cached(spark, sf_dir):
    rows = A.bars(spark, sf_dir).select("symbol", "open_time")
    return rows.exceptAll(_asked(spark, sf_dir).distinct()).groupBy("symbol", "open_time").agg(F.count("*").alias("n"))


@query(f"""WITH {A.sql_bars()}, {A.SQL_BOOKS}, u AS (SELECT symbol, 'bar' AS kind, close_time AS sent, close AS price FROM bars UNION ALL SELECT symbol, 'book', book_time, bid FROM books UNION ALL SELECT symbol, 'trade', trade_time, price FROM trades)
SELECT symbol, kind, sent, price FROM u""")
def union_tagged(spark, sf_dir):
    """Three kinds of messages as one wide table."""
    kind = lambda df, name, sent, price: df.select("symbol", F.lit(name).alias("kind"), F.col(sent).alias("sent"), F.col(price).alias("price"))
    return kind(A.bars(spark, sf_dir), "bar", "close_time", "close").unionByName(kind(A.books(spark, sf_dir), "book", "book_time", "bid")).unionByName(kind(A.trades(spark, sf_dir), "trade", "trade_time", "price"))


@query(f"WITH {A.sql_bars()}, u AS (SELECT * FROM bars WHERE open_time % {2 * A.HOUR} = 0 UNION ALL SELECT * FROM bars WHERE open_time % {3 * A.HOUR} = 0) SELECT symbol, count(*) AS rows, count(DISTINCT open_time) AS bars FROM u GROUP BY symbol")
def union_parts(spark, sf_dir):
    rows = A.bars(spark, sf_dir)
    both = rows.where(F.col("open_time") % (2 * A.HOUR) == 0).unionByName(rows.where(F.col("open_time") % (3 * A.HOUR) == 0))
    return both.groupBy("symbol").agg(F.count("*").alias("rows"), F.countDistinct("open_time").alias("bars"))
