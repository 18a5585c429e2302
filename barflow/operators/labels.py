"""Targets, samples and leak-free splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.ratios import log_ratio
from barflow.plans.blocks import Blocked, blocked, numbered
from barflow.plans.lineage import checkpointed
from barflow.plans.running import quantiles


def forward_returns(bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """y_h = ln(close h bars on / close), null at the end of a symbol."""
    b = blocked(numbered(bars), 0, max(horizons))
    return Blocked.home(b.rows.select("*", *[log_ratio(F.lead("close", h).over(b.window), F.col("close")).alias(f"y_{h}") for h in horizons]))


def tradable_returns(bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """ln(close h bars on / open of the next bar): what an order filled at the next open earns."""
    b = blocked(numbered(bars), 0, max(horizons))
    entry = F.lead("open", 1).over(b.window)
    return Blocked.home(b.rows.select("*", *[log_ratio(F.lead("close", h).over(b.window), entry).alias(f"tradable_{h}") for h in horizons]))


def past_returns(bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """momentum_h = ln(close / close h bars before) and reversal_h, its opposite."""
    b = blocked(numbered(bars), max(horizons))
    back = {h: log_ratio(F.col("close"), F.lag("close", h).over(b.window)) for h in horizons}
    return Blocked.home(b.rows.select("*", *[x.alias(f"momentum_{h}") for h, x in back.items()], *[(-x).alias(f"reversal_{h}") for h, x in back.items()]))


def future_steps(bars: DataFrame, steps: int) -> DataFrame:
    """path: the next ``steps`` one-bar log returns as an array; rows with fewer have null."""
    b = blocked(numbered(bars), 1, steps)
    df = b.rows.withColumn("r1_", log_ratio(F.lead("close", 1).over(b.window), F.col("close")))
    path = F.collect_list("r1_").over(b.window.rowsBetween(0, steps - 1))
    return Blocked.home(df.withColumn("path", F.when(F.size(path) == steps, path))).drop("r1_")


def window_vectors(df: DataFrame, names: list[str], lookback: int) -> DataFrame:
    """window: the last ``lookback`` rows of the named columns as an array of arrays, only where all are there."""
    b = blocked(df, lookback)
    rows = b.rows.withColumn("window", F.collect_list(F.array(*names)).over(b.back(lookback)))
    return Blocked.home(rows).where(F.size("window") == lookback)


def eligible(df: DataFrame, interval: int, lookback: int, horizon: int) -> DataFrame:
    """Numbered rows with ``valid`` whose input window is valid throughout and whose window and label span have no gap in time."""
    b = blocked(df, lookback, horizon)
    w = b.window
    gap = F.when(F.col("open_time") - F.lag("open_time", 1).over(w) != interval, 1).otherwise(0)
    rows = b.rows.withColumn("gap_", gap)
    bad = F.sum(F.when(F.col("valid"), 0).otherwise(1)).over(b.back(lookback))
    gaps = F.sum("gap_").over(w.rowsBetween(-(lookback - 2), horizon)) if lookback > 1 else F.sum("gap_").over(w.rowsBetween(1, horizon))
    marked = rows.select("*", bad.alias("bad_"), gaps.alias("gaps_"), F.lead("rn", horizon).over(w).alias("last_"))
    kept = marked.where((F.col("rn") >= lookback - 1) & F.col("last_").isNotNull() & (F.col("bad_") == 0) & (F.col("gaps_") == 0))
    return Blocked.home(kept).drop("gap_", "bad_", "gaps_", "last_")


def chrono_split(samples: DataFrame, embargo: int, val: float = 0.15, test: float = 0.15, key: str = "symbol") -> DataFrame:
    """split: train, val or test by the sample's place among its key's; samples within ``embargo`` bars before the next part are left out.

    Samples are numbered rows; their places come from counts of spans, not from one ordered task per key.
    """
    placed = checkpointed(numbered(samples.withColumnRenamed("rn", "bar_"), key).withColumnRenamed("rn", "place_"))  # read three times
    sizes = placed.groupBy(F.col(key).alias("key_")).agg(F.count("*").alias("n_"))
    sizes = sizes.withColumn("test_at_", F.col("n_") - F.floor(F.col("n_") * test)).withColumn("val_at_", F.col("test_at_") - F.floor(F.col("n_") * val))
    known = placed.join(sizes, F.col(key) == F.col("key_"))
    starts = known.groupBy("key_").agg(F.max(F.when(F.col("place_") == F.col("test_at_"), F.col("bar_"))).alias("test_start"), F.max(F.when(F.col("place_") == F.col("val_at_"), F.col("bar_"))).alias("val_start"))
    joined = placed.join(starts, F.col(key) == F.col("key_"))
    split = (
        F.when(F.col("bar_") >= F.col("test_start"), "test").when((F.col("bar_") >= F.col("val_start")) & (F.col("bar_") < F.col("test_start") - embargo), "val")
        .when(F.col("bar_") < F.col("val_start") - embargo, "train")
    )
    return joined.withColumn("split", split).where("split IS NOT NULL").withColumnRenamed("bar_", "rn").drop("place_", "key_", "test_start", "val_start")


def ratio_split(rows: DataFrame, train: float = 0.65, val: float = 0.20, key: str = "symbol") -> DataFrame:
    """split by place without embargo: the first share trains, the next validates, the rest tests; each part has at least one row where there are three."""
    sizes = rows.groupBy(F.col(key).alias("key_")).agg(F.count("*").alias("n_"))
    a = F.greatest(F.floor(F.col("n_") * train), F.lit(1))
    b = F.greatest(F.floor(F.col("n_") * (train + val)), a + 1)
    cut = sizes.withColumn("a_", F.least(a, F.greatest(F.col("n_") - 2, F.lit(1)))).withColumn("b_", F.least(b, F.greatest(F.col("n_") - 1, F.lit(1))))
    out = rows.join(cut, F.col(key) == F.col("key_"))
    return out.withColumn("split", F.when(F.col("rn") < F.col("a_"), "train").when(F.col("rn") < F.col("b_"), "val").otherwise("test")).drop("key_", "n_", "a_", "b_")


def walk_forward(rows: DataFrame, folds: DataFrame, embargo_ms: int, val_ms: int) -> DataFrame:
    """Every fold's train, val and test rows: ``folds`` has fold, start, stop; val are the ``val_ms`` before, both gaps keep the embargo.

    The fold table is a handful of literal rows.
    """
    t = F.col("open_time")
    split = (
        F.when((t >= F.col("start")) & (t < F.col("stop")), "test").when((t >= F.col("start") - val_ms) & (t < F.col("start") - embargo_ms), "val")
        .when(t < F.col("start") - val_ms - embargo_ms, "train")
    )
    return rows.join(F.broadcast(folds), t < F.col("stop")).withColumn("split", split).where("split IS NOT NULL")


def fold_table(rows: DataFrame, count: int, length_ms: int) -> DataFrame:
    """``count`` consecutive test spans that end at the last bar."""
    last = rows.agg((F.max("open_time") + 1).alias("stop_"))
    return last.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("fold"), "stop_").select(
        "fold", (F.col("stop_") - (count - F.col("fold")) * length_ms).alias("start"), (F.col("stop_") - (count - 1 - F.col("fold")) * length_ms).alias("stop"))


def normaliser(df: DataFrame, samples: DataFrame, names: list[str], lookback: int) -> DataFrame:
    """Mean and deviation (population, plus 1e-12) of each feature over the distinct rows that some training window covers, one row per symbol."""
    marked = df.join(samples.select("symbol", "rn").withColumn("is_train", F.lit(1)), ["symbol", "rn"], "left")
    b = blocked(marked, 0, lookback)
    covered = Blocked.home(b.rows.withColumn("covered_", F.max("is_train").over(b.window.rowsBetween(0, lookback - 1)))).where("covered_ = 1")
    return covered.groupBy("symbol").agg(*[F.avg(c).alias(f"mean_{c}") for c in names], *[(F.stddev_pop(c) + 1e-12).alias(f"std_{c}") for c in names], F.count("*").alias("rows"))


def zscore_clip(df: DataFrame, stats: DataFrame, names: list[str], limit: float = 5.0) -> DataFrame:
    """(value - mean) / std clipped, missing values taken as 0 before centring; ``stats`` has a row per symbol and is joined, not collected."""
    joined = df.join(stats, "symbol")
    z = {c: (F.coalesce(F.nanvl(c, F.lit(None)), F.lit(0.0)) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in names}
    return joined.select(*df.columns, *[F.greatest(F.lit(-limit), F.least(F.lit(limit), x)).alias(f"z_{c}") for c, x in z.items()])


def minmax(df: DataFrame, train: DataFrame, names: list[str], key: str = "symbol") -> DataFrame:
    """Scale to 0..1 by the training rows' range of each key; a constant column gives 0. scaled_ columns and, beside them, back_ that undoes it."""
    ranges = train.groupBy(F.col(key).alias("key_")).agg(*[F.min(c).alias(f"lo_{c}") for c in names], *[F.max(c).alias(f"hi_{c}") for c in names])
    joined = df.join(ranges, F.col(key) == F.col("key_"))
    width = {c: F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in names}
    scaled = joined.select(*df.columns, *[f"lo_{c}" for c in names], *[f"hi_{c}" for c in names], *[F.when(w > 0, (F.col(c) - F.col(f"lo_{c}")) / w).otherwise(0.0).alias(f"scaled_{c}") for c, w in width.items()])
    return scaled.select(*df.columns, *[f"scaled_{c}" for c in names], *[(F.col(f"scaled_{c}") * w + F.col(f"lo_{c}")).alias(f"back_{c}") for c, w in width.items()])


def time_quantile_split(rows: DataFrame, share: float, embargo_ms: int) -> DataFrame:
    """train before the exact time quantile, test after it plus the embargo."""
    cut = quantiles(rows, [], "open_time", [share]).select(F.col("quantiles")[0].alias("cut_"))
    split = F.when(F.col("open_time") < F.col("cut_"), "train").when(F.col("open_time") >= F.col("cut_") + embargo_ms, "test")
    return rows.crossJoin(F.broadcast(cut)).withColumn("split", split).where("split IS NOT NULL").drop("cut_")


def last_rows_stats(df: DataFrame, names: list[str], n: int, least: int) -> DataFrame:
    """Mean and deviation over each symbol's last ``n`` valid rows, only where there are at least ``least``."""
    w = Window.partitionBy("symbol").orderBy(F.desc("open_time"))
    last = df.where("valid").withColumn("back_", F.row_number().over(w)).where(F.col("back_") <= n)
    stats = last.groupBy("symbol").agg(F.count("*").alias("rows"), *[F.avg(c).alias(f"mean_{c}") for c in names], *[(F.stddev_pop(c) + 1e-12).alias(f"std_{c}") for c in names])
    return stats.where(F.col("rows") >= least)
