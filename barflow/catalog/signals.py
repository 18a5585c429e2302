"""Forecast arrays, decisions, advice and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.catalog import query
from barflow.catalog.common import HORIZONS, W, pick, r
from barflow.functions import signals as S
from barflow.functions.ratios import ratio
from barflow.operators import labels as L
from barflow.plans.once import with_once
from barflow.sources import adapters as A

SIGMA = (0.5, 1.0, 1.5)
_SIGMA_SQL = "[0.5, 1.0, 1.5]::DOUBLE[]"
_FORECAST = f"""{A.sql_bars()}, fc AS (SELECT symbol, open_time, close_time, close, [{', '.join(f'ln(close / lag(close, {h}) OVER ({W}))' for h in HORIZONS)}] AS exp, {list(HORIZONS)} AS horizons, {_SIGMA_SQL} AS sigma FROM bars),
 forecasts AS (SELECT * FROM fc WHERE exp[3] IS NOT NULL),
 zs AS (SELECT *, abs(exp[1]) / sigma[1] AS z1, abs(exp[2]) / sigma[2] AS z2, abs(exp[3]) / sigma[3] AS z3 FROM forecasts),
 picked AS (SELECT *, CASE WHEN z1 >= z2 AND z1 >= z3 THEN 1 WHEN z2 >= z3 THEN 2 ELSE 3 END AS j FROM zs),
 decided AS (SELECT symbol, open_time, close, close_time, horizons[j] AS horizon, exp[j] * 1e4 AS edge_bps, CASE WHEN exp[j] * 1e4 > 8 THEN 'LONG' WHEN exp[j] * 1e4 < -8 THEN 'SHORT' ELSE 'FLAT' END AS signal FROM picked)"""


def forecasts(spark, sf_dir):
    """Momentum forecasts as arrays: symbol, open_time, close_time, close, horizons, exp, sigma."""
    rows = L.past_returns(A.bars(spark, sf_dir), HORIZONS).where(f"momentum_{max(HORIZONS)} IS NOT NULL")
    return rows.select("symbol", "open_time", "close_time", "close", F.array(*map(F.lit, HORIZONS)).alias("horizons"), F.array(*[F.col(f"momentum_{h}") for h in HORIZONS]).alias("exp"), F.array(*map(F.lit, SIGMA)).alias("sigma"))


def decided(spark, sf_dir):
    rows = forecasts(spark, sf_dir)
    return rows.withColumn("d_", S.decide_signal(F.col("exp"), F.col("sigma"), F.col("horizons"), 8.0)).select("*", "d_.*").drop("d_")


@query(f"WITH {_FORECAST} SELECT symbol, open_time, signal, CAST(horizon AS INTEGER) AS horizon, round(edge_bps, 4) + 0.0 AS edge_bps FROM decided")
def decide_signal(spark, sf_dir):
    return decided(spark, sf_dir).select("symbol", "open_time", "signal", "horizon", r("edge_bps", 4).alias("edge_bps"))


@query(f"WITH {_FORECAST} SELECT symbol, signal, count(*) AS n FROM decided GROUP BY ALL")
def signal_counts(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("symbol", "signal").agg(F.count("*").alias("n"))


@query(f"WITH {_FORECAST} SELECT symbol, open_time, round(close * exp(exp[1]), 6) + 0.0 AS price_1, round(close * exp(exp[2]), 6) + 0.0 AS price_5, round(close * exp(exp[3]), 6) + 0.0 AS price_15 FROM forecasts")
def exp_price(spark, sf_dir):
    prices = S.expected_prices(F.col("close"), F.col("exp"))
    return pick(forecasts(spark, sf_dir).select("*", *[prices[i].alias(f"price_{h}") for i, h in enumerate(HORIZONS)]), "symbol open_time", [f"price_{h}" for h in HORIZONS])


@query(f"WITH {_FORECAST}, x AS (SELECT symbol, open_time, unnest(horizons) AS h, unnest(exp) AS e, unnest(sigma) AS s FROM forecasts) SELECT symbol, open_time, CAST(h AS VARCHAR) AS horizon, round(e * 1e4, 1) + 0.0 AS exp_bps, round(s * 1e4, 1) + 0.0 AS resid_sigma_bps FROM x")
def forecast_by_horizon(spark, sf_dir):
    rows = forecasts(spark, sf_dir).select("symbol", "open_time", F.explode(S.by_horizon(F.col("horizons"), F.col("exp"), F.col("sigma"))).alias("horizon", "v"))
    return rows.select("symbol", "open_time", "horizon", r("v.exp_bps", 1).alias("exp_bps"), r("v.resid_sigma_bps", 1).alias("resid_sigma_bps"))


@query(f"WITH {_FORECAST}, x AS (SELECT symbol, open_time, generate_subscripts(exp, 1) - 1 AS pos, unnest(exp) AS e FROM forecasts) SELECT symbol, open_time, CAST(pos AS INTEGER) AS pos, round(e / CASE pos WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END, 6) + 0.0 AS z FROM x")
def zip_horizon_stats(spark, sf_dir):
    """Forecast over deviation, matched by position."""
    rows = forecasts(spark, sf_dir).select("symbol", "open_time", F.posexplode(F.arrays_zip("exp", "sigma")).alias("pos", "x"))
    return rows.select("symbol", "open_time", "pos", r(F.col("x.exp") / F.col("x.sigma")).alias("z"))


@query(f"""WITH {_FORECAST}, m AS (SELECT avg(exp[2]) AS mean, stddev_pop(exp[2]) AS std FROM forecasts) SELECT symbol, open_time, round((exp[2] - mean) / std, 6) + 0.0 AS z FROM forecasts, m""")
def broadcast_meta(spark, sf_dir):
    """Every row beside the one row of model metadata."""
    rows = forecasts(spark, sf_dir).withColumn("x", F.col("exp")[1])
    meta = rows.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return rows.crossJoin(F.broadcast(meta)).select("symbol", "open_time", r(ratio(F.col("x") - F.col("mean"), F.col("std"))).alias("z"))


@query(f"WITH {_FORECAST}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k FROM decided) SELECT symbol, open_time, signal FROM k WHERE k <= 20")
def forecast_history(spark, sf_dir):
    """The last 20 forecasts of each symbol, read in time order."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy(F.desc("open_time"))
    return decided(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 20").select("symbol", "open_time", "signal").orderBy("symbol", "open_time")


@query(f"WITH {_FORECAST} SELECT symbol, arg_max(signal, open_time) AS signal, max(open_time) AS open_time FROM decided GROUP BY symbol")
def latest_per_key(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("symbol").agg(F.max_by("signal", "open_time").alias("signal"), F.max("open_time").alias("open_time"))


@query(f"""WITH {_FORECAST}, {A.SQL_BOOKS}, f AS (SELECT symbol, arg_max(signal, open_time) AS signal FROM decided GROUP BY symbol), q AS (SELECT symbol || CASE WHEN update_id % 2 = 0 THEN '' ELSE '-alt' END AS symbol, bid, book_time, update_id FROM books),
 b AS (SELECT symbol, arg_max(bid, (book_time, update_id)) AS bid FROM q GROUP BY symbol) SELECT symbol, signal, bid FROM f FULL JOIN b USING (symbol)""")
def snapshot_pair(spark, sf_dir):
    """Latest forecast and latest quote in one row; quotes with odd numbers are of a second listing, which has no forecast, so that the outer side shows."""
    f = decided(spark, sf_dir).groupBy("symbol").agg(F.max_by("signal", "open_time").alias("signal"))
    listing = F.concat("symbol", F.when(F.col("update_id") % 2 == 0, "").otherwise("-alt"))
    b = A.books(spark, sf_dir).withColumn("symbol", listing).groupBy("symbol").agg(F.max_by("bid", F.struct("book_time", "update_id")).alias("bid"))
    return f.join(b, "symbol", "full").select("symbol", "signal", "bid")


ACTIONS = ("buy", "OPEN_SHORT", " close ", "hold", "nonsense", "EXIT", "SELL")
_ADVICE = f"""{A.SQL_TRADES}, raw AS (SELECT trade_id, symbol, trade_time, qty, price, list_extract({list(ACTIONS)}, CAST(trade_id % 7 + 1 AS INTEGER)) AS act FROM trades),
 advice AS (SELECT trade_id, symbol, trade_time, act, CASE WHEN trade_id % 11 = 0 THEN NULL ELSE round(price / 100 - 0.2, 4) END AS confidence, CASE WHEN trade_id % 13 = 0 THEN NULL ELSE round(qty / 8 - 0.2, 4) END AS size,
  CAST(qty * 40 AS BIGINT) AS horizon, round(price * 3, 4) AS stop, round(price * 10 - 20, 4) AS take FROM raw WHERE trade_id % 17 <> 0),
 norm AS (SELECT trade_id, trade_time, CASE upper(trim(act)) WHEN 'BUY' THEN 'OPEN_LONG' WHEN 'OPEN_SHORT' THEN 'OPEN_SHORT' WHEN 'CLOSE' THEN 'CLOSE' WHEN 'HOLD' THEN 'HOLD' WHEN 'EXIT' THEN 'CLOSE' WHEN 'SELL' THEN 'OPEN_SHORT' ELSE 'SKIP' END AS action,
  greatest(0, least(1, coalesce(confidence, 0))) AS confidence, greatest(0, least(1, coalesce(size, 0))) AS size, horizon AS horizon_bars, stop AS stop_bps, greatest(take, 0) AS take_bps FROM advice)"""


def advice_texts(spark, sf_dir):
    """Advice as a model would write it: JSON, half of it inside prose; every 17th is no JSON at all."""
    t = A.trades(spark, sf_dir)
    act = F.element_at(F.array(*map(F.lit, ACTIONS)), (F.col("trade_id") % 7 + 1).cast("int"))
    body = F.to_json(F.struct(
        act.alias("action"), F.when(F.col("trade_id") % 11 == 0, "much").otherwise(F.round(F.col("price") / 100 - 0.2, 4).cast("string")).alias("confidence"),
        F.when(F.col("trade_id") % 13 != 0, F.round(F.col("qty") / 8 - 0.2, 4)).alias("size"), (F.col("qty") * 40).cast("long").alias("horizon_bars"), F.round(F.col("price") * 3, 4).alias("stop_bps"), F.round(F.col("price") * 10 - 20, 4).alias("take_bps"),
        F.col("symbol").alias("reason"),
    ))
    text = F.when(F.col("trade_id") % 17 == 0, "no idea, sorry").when(F.col("trade_id") % 2 == 0, body).otherwise(F.concat(F.lit("Sure!\n```json\n"), body, F.lit("\n``` done")))
    return t.select("trade_id", "symbol", "trade_time", text.alias("text"))


def normalised(spark, sf_dir):
    return with_once(advice_texts(spark, sf_dir), "a", S.normalise_advice(S.parse_advice(F.col("text")))).drop("text")


@query(f"WITH {A.SQL_TRADES} SELECT trade_id, trade_id % 17 <> 0 AS parsed, CASE WHEN trade_id % 17 <> 0 THEN symbol END AS reason FROM trades")
def advice_parse(spark, sf_dir):
    rows = with_once(advice_texts(spark, sf_dir), "advice", S.parse_advice(F.col("text")))
    return rows.select("trade_id", F.col("advice").isNotNull().alias("parsed"), F.try_variant_get("advice", "$.reason", "string").alias("reason"))


@query(f"WITH {_ADVICE} SELECT trade_id, action, CAST(horizon_bars AS BIGINT) AS horizon_bars, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in ('confidence', 'size', 'stop_bps', 'take_bps'))} FROM norm")
def advice_normalise(spark, sf_dir):
    rows = normalised(spark, sf_dir).where("a IS NOT NULL").select("trade_id", "a.*")
    return pick(rows, "trade_id action horizon_bars", "confidence size stop_bps take_bps", 4)


@query(f"""WITH {A.SQL_TRADES} SELECT trade_id, round(greatest(-1, least(1, price / 100 - 0.3)), 9) + 0.0 AS bias, round(greatest(0, least(1, qty / 8 - 0.2)), 9) + 0.0 AS confidence,
  round(greatest(-1, least(1, price / 100 - 0.3)) * greatest(0, least(1, qty / 8 - 0.2)), 9) + 0.0 AS weighted, round(greatest(-500, least(500, price * 9 - 100)), 9) + 0.0 AS move, CAST(trade_id % 4 = 0 AS DOUBLE) AS trend_up, CAST(trade_id % 3 = 1 AS DOUBLE) AS short FROM trades""")
def advice_scores(spark, sf_dir):
    regimes, actions = F.array(*map(F.lit, ("trend_up", "range", "other", ""))), F.array(*map(F.lit, ("long", "Short", "wait")))
    text = F.to_json(F.struct(
        (F.col("price") / 100 - 0.3).alias("bias"), (F.col("qty") / 8 - 0.2).alias("confidence"), (F.col("price") * 9 - 100).alias("expected_move_bps"),
        F.element_at(regimes, (F.col("trade_id") % 4 + 1).cast("int")).alias("regime"), F.element_at(actions, (F.col("trade_id") % 3 + 1).cast("int")).alias("action"),
    ))
    rows = with_once(A.trades(spark, sf_dir), "s", S.advice_scores(F.try_parse_json(text)))
    return pick(rows.select("trade_id", *[F.col("s")[i].alias(n) for i, n in ((0, "bias"), (1, "confidence"), (2, "weighted"), (3, "move"), (5, "trend_up"), (10, "short"))]), "trade_id", "bias confidence weighted move trend_up short", 9)


_RISK = f"""{_ADVICE}, st AS (SELECT *, CAST(trade_id % 3 AS INTEGER) - 1 AS has_pos, CASE trade_id % 4 WHEN 0 THEN 'LONG' WHEN 1 THEN 'SHORT' ELSE 'FLAT' END AS model_signal, trade_id % 5 = 0 AS cool, trade_id % 23 = 0 AS late FROM norm),
 sided AS (SELECT *, CASE action WHEN 'OPEN_LONG' THEN 1 WHEN 'OPEN_SHORT' THEN -1 END AS side, CASE model_signal WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN -1 ELSE 0 END AS model_side FROM st),
 counted AS (SELECT *, CASE WHEN action = 'CLOSE' THEN CAST(has_pos = 0 OR confidence < 0.55 AS INTEGER) WHEN side IS NOT NULL THEN (side <> model_side)::INTEGER + (confidence < 0.6)::INTEGER + (has_pos = side)::INTEGER + cool::INTEGER + (size <= 0)::INTEGER {{late}} ELSE 0 END AS vetoes FROM sided),
 risk AS (SELECT trade_id, symbol_of.symbol, vetoes, CASE WHEN vetoes = 0 AND (side IS NOT NULL OR action = 'CLOSE') THEN action ELSE 'NONE' END AS action, CASE WHEN vetoes = 0 AND side IS NOT NULL THEN size ELSE 0 END AS size,
  CASE WHEN vetoes = 0 AND side IS NOT NULL THEN greatest(15, least(150, CASE WHEN stop_bps > 0 THEN stop_bps ELSE 50 END)) ELSE 0 END AS stop_bps, CASE WHEN vetoes = 0 AND side IS NOT NULL THEN least(400, take_bps) ELSE 0 END AS take_bps,
  CASE WHEN vetoes = 0 AND side IS NOT NULL THEN greatest(1, least(240, CASE WHEN horizon_bars > 0 THEN horizon_bars ELSE 5 END)) ELSE 0 END AS horizon FROM counted JOIN (SELECT trade_id, symbol FROM trades) symbol_of USING (trade_id))"""


def judged(spark, sf_dir, late_after_ms=None):
    rows = normalised(spark, sf_dir).where("a IS NOT NULL")
    signal = F.when(F.col("trade_id") % 4 == 0, "LONG").when(F.col("trade_id") % 4 == 1, "SHORT").otherwise("FLAT")
    rows = rows.select(
        "trade_id", "symbol", "a", (F.col("trade_id") % 3 - 1).cast("int").alias("has_pos"), signal.alias("model_signal"), F.lit(5).alias("model_horizon"),
        F.when(F.col("trade_id") % 5 == 0, F.array(F.lit("cooling"))).otherwise(F.array().cast("array<string>")).alias("blocked"),
        F.col("trade_time").alias("bar_time"), (F.col("trade_time") + F.when(F.col("trade_id") % 23 == 0, 4 * A.MINUTE).otherwise(A.MINUTE)).alias("decided_at"),
    )
    return S.risk_decide(rows, late_after_ms=late_after_ms)


@query(f"WITH {_RISK.format(late='')} SELECT trade_id, action, CAST(vetoes AS INTEGER) AS vetoes, CAST(horizon AS BIGINT) AS horizon, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in ('size', 'stop_bps', 'take_bps'))} FROM risk")
def risk_decide(spark, sf_dir):
    rows = judged(spark, sf_dir).select("trade_id", F.size("vetoes").alias("vetoes"), "decision.*")
    return pick(rows, "trade_id action vetoes horizon", "size stop_bps take_bps", 4)


@query(f"WITH {_RISK.format(late='+ late::INTEGER')} SELECT trade_id, action, CAST(vetoes AS INTEGER) AS vetoes FROM risk")
def late_advice_veto(spark, sf_dir):
    return judged(spark, sf_dir, 3 * A.MINUTE).select("trade_id", "decision.action", F.size("vetoes").alias("vetoes"))


@query(f"WITH {_RISK.format(late='')} SELECT symbol, count(*) AS calls, count(*) FILTER (action LIKE 'OPEN%') AS opens, count(*) FILTER (vetoes > 0) AS vetoed FROM risk GROUP BY symbol")
def decision_counts(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return rows.groupBy("symbol").agg(F.count("*").alias("calls"), F.count_if(F.col("decision.action").startswith("OPEN")).alias("opens"), F.count_if(F.size("vetoes") > 0).alias("vetoed"))
