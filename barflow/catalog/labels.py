"""Targets, samples, splits and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.catalog import query
from barflow.catalog.common import FEATURES_SQL, HORIZONS, NUMBERED, W, features_sql, pick, r, rounded
from barflow.operators import features as X
from barflow.operators import labels as L
from barflow.plans.blocks import numbered
from barflow.plans.lineage import checkpointed
from barflow.sources import adapters as A

LOOKBACK, EMBARGO = 32, 15
STATS = ["ret_1", "rsi_14"]


@query(f"WITH {A.sql_bars()} SELECT symbol, open_time, " + ", ".join(f"round(ln(lead(close, {h}) OVER ({W}) / close), 6) + 0.0 AS y_{h}" for h in HORIZONS) + " FROM bars")
def forward_returns(spark, sf_dir):
    return pick(L.forward_returns(A.bars(spark, sf_dir), HORIZONS), "symbol open_time", [f"y_{h}" for h in HORIZONS])


@query(f"WITH {A.sql_bars()} SELECT symbol, open_time, " + ", ".join(f"round(ln(lead(close, {h}) OVER ({W}) / lead(open, 1) OVER ({W})), 6) + 0.0 AS tradable_{h}" for h in HORIZONS) + " FROM bars")
def tradable_returns(spark, sf_dir):
    return pick(L.tradable_returns(A.bars(spark, sf_dir), HORIZONS), "symbol open_time", [f"tradable_{h}" for h in HORIZONS])


_PAST = [f"{n}_{h}" for h in HORIZONS for n in ("momentum", "reversal")]
_PAST_SQL = f"WITH {A.sql_bars()} SELECT symbol, open_time, " + ", ".join(f"round(ln(close / lag(close, {h}) OVER ({W})), 6) + 0.0 AS momentum_{h}, round(-ln(close / lag(close, {h}) OVER ({W})), 6) + 0.0 AS reversal_{h}" for h in HORIZONS) + " FROM bars"


@query(_PAST_SQL)
def past_return(spark, sf_dir):
    return pick(L.past_returns(A.bars(spark, sf_dir), HORIZONS), "symbol open_time", _PAST)


@query(_PAST_SQL)
def naive_forecasters(spark, sf_dir):
    return pick(L.past_returns(A.bars(spark, sf_dir), HORIZONS), "symbol open_time", _PAST)


@query(f"""WITH {A.sql_bars()}, s AS (SELECT *, ln(lead(close) OVER ({W}) / close) AS r1 FROM bars), p AS (SELECT symbol, open_time, count(r1) OVER f AS n, sum(r1) OVER f AS total, r1
  FROM s WINDOW f AS ({W} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) SELECT symbol, open_time, round(total, 6) + 0.0 AS total, round(r1, 6) + 0.0 AS first_step FROM p WHERE n = 10""")
def future_return_array(spark, sf_dir):
    rows = L.future_steps(A.bars(spark, sf_dir), 10).where("path IS NOT NULL")
    return pick(rows.withColumn("total", F.aggregate("path", F.lit(0.0), lambda a, x: a + x)).withColumn("first_step", F.col("path")[0]), "symbol open_time", "total first_step")


@query(f"""WITH {A.sql_bars()}, r AS (SELECT *, ln(close / lag(close) OVER ({W})) AS r1 FROM bars)
SELECT symbol, open_time, round(first_value(close) OVER ({W}) * exp(sum(coalesce(r1, 0)) OVER ({W} ROWS UNBOUNDED PRECEDING)), 4) + 0.0 AS price FROM r""")
def price_path(spark, sf_dir):
    """Prices back from log returns: the first close times the running product, by blocked scan (a decay of 1 is a running sum over block totals)."""
    rows = L.past_returns(A.bars(spark, sf_dir), (1,))
    from pyspark.sql import Window

    cut = rows.withColumn("at_", F.floor(F.col("rn") / 4096))
    own = F.sum(F.coalesce("momentum_1", F.lit(0.0))).over(Window.partitionBy("symbol", "at_").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    totals = cut.groupBy(F.col("symbol").alias("key_"), F.col("at_").alias("of_")).agg(F.sum("momentum_1").alias("sum_"), F.min_by("close", "rn").alias("open_"))
    over = Window.partitionBy("key_").orderBy("of_")
    before = totals.withColumn("before_", F.coalesce(F.sum("sum_").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("start_", F.first("open_").over(over))
    joined = cut.withColumn("own_", own).join(before, (F.col("symbol") == F.col("key_")) & (F.col("at_") == F.col("of_")))
    return pick(joined.withColumn("price", F.col("start_") * F.exp(F.col("own_") + F.col("before_"))), "symbol open_time", "price", 4)


#: Samples must not span a gap. The trades here leave gaps in any minute series, so samples and what is fitted on them are hourly.
HOURLY_SQL = features_sql(A.HOUR)
_ELIGIBLE = f"""gapped AS (SELECT *, CAST(coalesce(open_time - lag(open_time) OVER ({W}) <> {A.HOUR}, false) AS INTEGER) AS gap, CAST(NOT valid AS INTEGER) AS bad FROM features),
 spans AS (SELECT *, sum(bad) OVER ({W} ROWS BETWEEN {LOOKBACK - 1} PRECEDING AND CURRENT ROW) AS bads, sum(gap) OVER ({W} ROWS BETWEEN {LOOKBACK - 2} PRECEDING AND {max(HORIZONS)} FOLLOWING) AS gaps,
   lead(rn, {max(HORIZONS)}) OVER ({W}) AS last FROM gapped),
 eligible AS (SELECT symbol, open_time, rn FROM spans WHERE rn >= {LOOKBACK - 1} AND last IS NOT NULL AND bads = 0 AND gaps = 0)"""


def _eligible(spark, sf_dir):
    return L.eligible(X.features_14(A.bars(spark, sf_dir, A.HOUR)), A.HOUR, LOOKBACK, max(HORIZONS))


@query(f"WITH RECURSIVE {HOURLY_SQL}, {_ELIGIBLE} SELECT symbol, open_time, rn FROM eligible")
def eligible_samples(spark, sf_dir):
    return _eligible(spark, sf_dir).select("symbol", "open_time", "rn")


_SPLIT = f"""places AS (SELECT symbol, open_time, rn, row_number() OVER ({W}) - 1 AS place, count(*) OVER (PARTITION BY symbol) AS n FROM eligible),
 starts AS (SELECT symbol, max(CASE WHEN place = n - floor(n * 0.15::DOUBLE) THEN rn END) AS test_start, max(CASE WHEN place = n - floor(n * 0.15::DOUBLE) - floor(n * 0.15::DOUBLE) THEN rn END) AS val_start FROM places GROUP BY symbol),
 split AS (SELECT * FROM (SELECT symbol, open_time, rn, CASE WHEN rn >= test_start THEN 'test' WHEN rn >= val_start AND rn < test_start - {EMBARGO} THEN 'val' WHEN rn < val_start - {EMBARGO} THEN 'train' END AS split
   FROM places JOIN starts USING (symbol)) WHERE split IS NOT NULL)"""


def _split(spark, sf_dir):
    return L.chrono_split(_eligible(spark, sf_dir).select("symbol", "open_time", "rn"), EMBARGO)


@query(f"WITH RECURSIVE {HOURLY_SQL}, {_ELIGIBLE}, {_SPLIT} SELECT symbol, open_time, rn, split FROM split")
def chrono_split(spark, sf_dir):
    return _split(spark, sf_dir).select("symbol", "open_time", "rn", "split")


@query(f"WITH RECURSIVE {HOURLY_SQL}, {_ELIGIBLE}, {_SPLIT} SELECT symbol, count(*) AS shared FROM (SELECT symbol, rn FROM split WHERE split = 'train' INTERSECT SELECT symbol, rn FROM split WHERE split = 'test') GROUP BY symbol")
def intersect_check(spark, sf_dir):
    """Samples both in train and test: none."""
    rows = _split(spark, sf_dir)
    part = lambda s: rows.where(F.col("split") == s).select("symbol", "rn")
    return part("train").intersect(part("test")).groupBy("symbol").agg(F.count("*").alias("shared"))


@query(f"""WITH {A.sql_bars()}, {NUMBERED}, c AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol)
SELECT symbol, open_time, CASE WHEN rn < floor(n * 0.65::DOUBLE) THEN 'train' WHEN rn < floor(n * (0.65::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM numbered JOIN c USING (symbol)""")
def ratio_split(spark, sf_dir):
    return L.ratio_split(numbered(A.bars(spark, sf_dir))).select("symbol", "open_time", "split")


@query(f"""WITH {A.sql_bars()}, e AS (SELECT max(open_time) + 1 AS stop FROM bars), folds AS (SELECT fold, stop - (3 - fold) * {5 * A.DAY} AS a, stop - (2 - fold) * {5 * A.DAY} AS b FROM e, (SELECT unnest(range(3)) AS fold)),
s AS (SELECT fold, CASE WHEN open_time >= a AND open_time < b THEN 'test' WHEN open_time >= a - {5 * A.DAY} AND open_time < a - {A.DAY} THEN 'val' WHEN open_time < a - {6 * A.DAY} THEN 'train' END AS split FROM bars, folds WHERE open_time < b)
SELECT CAST(fold AS INTEGER) AS fold, split, count(*) AS bars FROM s WHERE split IS NOT NULL GROUP BY ALL""")
def walk_forward_folds(spark, sf_dir):
    rows = A.bars(spark, sf_dir)
    return L.walk_forward(rows, L.fold_table(rows, 3, 5 * A.DAY), A.DAY, 5 * A.DAY).groupBy("fold", "split").agg(F.count("*").alias("bars"))


@query(f"""WITH {A.sql_bars()}, q AS (SELECT quantile_cont(open_time, 0.7) AS cut FROM bars), s AS (SELECT CASE WHEN open_time < cut THEN 'train' WHEN open_time >= cut + {A.HOUR} THEN 'test' END AS split, symbol FROM bars, q)
SELECT symbol, split, count(*) AS bars FROM s WHERE split IS NOT NULL GROUP BY ALL""")
def time_quantile_split(spark, sf_dir):
    return L.time_quantile_split(A.bars(spark, sf_dir), 0.7, A.HOUR).groupBy("symbol", "split").agg(F.count("*").alias("bars"))


_NORMAL = f"""train AS (SELECT symbol, rn FROM split WHERE split = 'train'), marks AS (SELECT f.*, max(CASE WHEN t.rn IS NOT NULL THEN 1 END) OVER (PARTITION BY f.symbol ORDER BY f.rn ROWS BETWEEN CURRENT ROW AND {LOOKBACK - 1} FOLLOWING) AS covered
  FROM features f LEFT JOIN train t USING (symbol, rn)),
 stats AS (SELECT symbol, count(*) AS rows, {', '.join(f'avg({c}) AS mean_{c}, stddev_pop({c}) + 1e-12 AS std_{c}' for c in STATS)} FROM marks WHERE covered = 1 GROUP BY symbol)"""


def _stats(spark, sf_dir):
    rows = checkpointed(X.features_14(A.bars(spark, sf_dir, A.HOUR)))
    samples = L.eligible(rows, A.HOUR, LOOKBACK, max(HORIZONS)).select("symbol", "open_time", "rn")
    return rows, L.normaliser(rows, L.chrono_split(samples, EMBARGO).where("split = 'train'"), STATS, LOOKBACK)


_STAT_NAMES = [f"{p}_{c}" for c in STATS for p in ("mean", "std")]


@query(f"WITH RECURSIVE {HOURLY_SQL}, {_ELIGIBLE}, {_SPLIT}, {_NORMAL} SELECT symbol, rows, {rounded(_STAT_NAMES)} FROM stats")
def fit_normaliser(spark, sf_dir):
    return pick(_stats(spark, sf_dir)[1], "symbol rows", _STAT_NAMES)


@query(f"WITH RECURSIVE {HOURLY_SQL}, {_ELIGIBLE}, {_SPLIT}, {_NORMAL} SELECT symbol, open_time, " + ", ".join(f"round(greatest(-5.0, least(5.0, (coalesce({c}, 0) - mean_{c}) / std_{c})), 6) + 0.0 AS z_{c}" for c in STATS) + " FROM features JOIN stats USING (symbol)")
def zscore_clip(spark, sf_dir):
    rows, stats = _stats(spark, sf_dir)
    return pick(L.zscore_clip(rows, stats, STATS), "symbol open_time", [f"z_{c}" for c in STATS])


_MINMAX_SQL = f"""WITH {A.sql_bars()}, {NUMBERED}, c AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol), r AS (SELECT symbol, min(close) AS lo, max(close) AS hi FROM numbered JOIN c USING (symbol) WHERE rn < floor(n * 0.65::DOUBLE) GROUP BY symbol)"""


def _scaled(spark, sf_dir):
    rows = L.ratio_split(numbered(A.bars(spark, sf_dir)))
    return L.minmax(rows, rows.where("split = 'train'"), ["close"])


@query(_MINMAX_SQL + " SELECT symbol, open_time, round((close - lo) / (hi - lo), 6) + 0.0 AS scaled_close FROM bars JOIN r USING (symbol)")
def minmax_scale(spark, sf_dir):
    return pick(_scaled(spark, sf_dir), "symbol open_time", "scaled_close")


@query(_MINMAX_SQL + " SELECT symbol, open_time, round((close - lo) / (hi - lo) * (hi - lo) + lo, 6) + 0.0 AS back_close FROM bars JOIN r USING (symbol)")
def minmax_inverse(spark, sf_dir):
    return pick(_scaled(spark, sf_dir), "symbol open_time", "back_close")


@query(f"""WITH RECURSIVE {FEATURES_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k FROM features WHERE valid)
SELECT symbol, count(*) AS rows, {', '.join(f'round(avg({c}), 6) + 0.0 AS mean_{c}, round(stddev_pop({c}) + 1e-12, 6) + 0.0 AS std_{c}' for c in STATS)} FROM l WHERE k <= 100 GROUP BY symbol HAVING count(*) >= 50""")
def renormalise(spark, sf_dir):
    return pick(L.last_rows_stats(X.features_14(A.bars(spark, sf_dir)), STATS, 100, 50), "symbol rows", _STAT_NAMES)


@query(f"""WITH {A.sql_bars()}, y AS (SELECT symbol, ln(lead(close, 5) OVER ({W}) / close) AS y, ln(close / lag(close, 5) OVER ({W})) AS p FROM bars)
SELECT symbol, round(stddev_pop(y), 6) + 0.0 AS y_scale FROM y GROUP BY symbol""")
def target_scale(spark, sf_dir):
    """Deviation of the targets."""
    return pick(_scales(spark, sf_dir), "symbol", "y_scale")


@query(f"""WITH {A.sql_bars()}, y AS (SELECT symbol, ln(lead(close, 5) OVER ({W}) / close) AS y, ln(close / lag(close, 5) OVER ({W})) AS p FROM bars)
SELECT symbol, round(stddev_pop(y - p), 6) + 0.0 AS sigma FROM y GROUP BY symbol""")
def residual_sigma(spark, sf_dir):
    """Deviation of what the momentum forecast leaves of the targets."""
    return pick(_scales(spark, sf_dir), "symbol", "sigma")


def _scales(spark, sf_dir):
    rows = L.past_returns(A.bars(spark, sf_dir), (5,)).select("symbol", "open_time", "momentum_5").join(L.forward_returns(A.bars(spark, sf_dir), (5,)).select("symbol", "open_time", "y_5"), ["symbol", "open_time"])
    return rows.groupBy("symbol").agg(F.stddev_pop("y_5").alias("y_scale"), F.stddev_pop(F.col("y_5") - F.col("momentum_5")).alias("sigma"))


@query(f"""WITH RECURSIVE {FEATURES_SQL}, v AS (SELECT symbol, open_time, ret_1, rsi_14, row_number() OVER ({W}) - 1 AS place FROM features WHERE valid)
SELECT s.symbol, s.open_time, CAST(count(*) AS INTEGER) AS lines, round(arg_min(x.ret_1, x.place), 6) + 0.0 AS first_ret, round(arg_max(x.rsi_14, x.place), 6) + 0.0 AS last_rsi, round(sum((x.place - s.place + {LOOKBACK}) * x.ret_1), 5) + 0.0 AS ret_line, round(sum((x.place - s.place + {LOOKBACK}) * x.rsi_14), 5) + 0.0 AS rsi_line
FROM v s JOIN v x ON x.symbol = s.symbol AND x.place BETWEEN s.place - {LOOKBACK - 1} AND s.place WHERE s.place >= {LOOKBACK - 1} GROUP BY s.symbol, s.open_time""")
def window_vectors(spark, sf_dir):
    """The input window of each valid sample, an array of arrays: its length, two of its values, and its columns summed with the line's number as weight."""
    rows = X.features_14(A.bars(spark, sf_dir)).where("valid")
    windows = L.window_vectors(numbered(rows.drop("rn")), ["ret_1", "rsi_14"], LOOKBACK)
    line = lambda k: F.aggregate(F.transform("window", lambda x, i: (i + 1) * x[k]), F.lit(0.0), lambda a, x: a + x)
    first, last = F.col("window")[0], F.element_at("window", -1)
    return windows.select("symbol", "open_time", F.size("window").alias("lines"), r(first[0]).alias("first_ret"), r(last[1]).alias("last_rsi"), r(line(0), 5).alias("ret_line"), r(line(1), 5).alias("rsi_line"))
