"""Running totals, ranks and quantiles of long groups without one task for a group: first over spans, then within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.plans.lineage import checkpointed

ROWS_PER_SPAN = 1_000_000


def running(df: DataFrame, by: list[str], order: list[str], span: Column, name: str, value: Column, how: str = "sum", before: bool = False) -> DataFrame:
    """Add the sum or max of ``value`` over the rows of a group up to each row in ``order``, or up to the one before it.

    ``span`` cuts a group into ordered runs of rows: it must never fall along ``order``. The spans' own totals are windowed by group, a row for each
    span; rows only within their span. Null keys are a group. Without a row before, a sum is 0 and a max null.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    rows = df.withColumn("span_", span)
    keys = [F.col(c).alias(f"key{i}_") for i, c in enumerate(by)]
    ends = rows.groupBy(*keys, F.col("span_").alias("of_")).agg(fold(value).alias("end_"))
    earlier = Window.partitionBy(*[f"key{i}_" for i in range(len(by))]).orderBy("of_").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before_", fold("end_").over(earlier)).drop("end_")
    same = [F.col(c).eqNullSafe(F.col(f"key{i}_")) for i, c in enumerate(by)]
    joined = rows.join(ends, [*same, F.col("span_") == F.col("of_")])
    own = fold(value).over(Window.partitionBy(*by, "span_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    out = F.coalesce("before_", F.lit(0)) + F.coalesce(own, F.lit(0)) if how == "sum" else F.greatest("before_", own)
    return joined.withColumn(name, out).drop("span_", "of_", "before_", *[f"key{i}_" for i in range(len(by))])


def counted(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Distinct values of a column in each group with n, how often they occur, and upto, how many rows have them or smaller ones; nulls do not count.

    The distinct values are dealt to ranges first, so continuous values make many tasks.
    """
    counts = checkpointed(df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n")))
    parts = -(-counts.count() // ROWS_PER_SPAN)
    if parts <= 1:
        return counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy(column)))
    ranged = checkpointed(counts.repartitionByRange(parts, *by, column).withColumn("range_", F.spark_partition_id()))
    return running(ranged, by, [column], F.col("range_"), "upto", F.col("n")).drop("range_")


def quantiles(df: DataFrame, by: list[str], column: str, shares: list[float]) -> DataFrame:
    """One row a group with quantiles ARRAY<DOUBLE>, linear between the two nearest rows, exact whatever the group's size."""
    ranks = counted(df, by, column)
    sizes = ranks.groupBy(*[F.col(c).alias(f"key{i}_") for i, c in enumerate(by)]).agg(F.sum("n").alias("group_rows_"))
    same = [F.col(c).eqNullSafe(F.col(f"key{i}_")) for i, c in enumerate(by)]
    placed = ranks.join(sizes, same) if by else ranks.crossJoin(F.broadcast(sizes))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("n") <= place) & (place < F.col("upto")), F.col(column).cast("double")))

    def share(q: float) -> tuple[Column, Column, Column]:
        exact = (F.col("group_rows_") - 1) * F.lit(float(q))
        return at(F.floor(exact)), at(F.ceil(exact)), F.max(exact - F.floor(exact))

    parts = {f"{n}{i}_": x for i, q in enumerate(shares) for n, x in zip(("low", "high", "rest"), share(q))}
    found = placed.groupBy(*by).agg(*[x.alias(n) for n, x in parts.items()])
    return found.select(*by, F.array(*[F.col(f"low{i}_") + (F.col(f"high{i}_") - F.col(f"low{i}_")) * F.col(f"rest{i}_") for i in range(len(shares))]).alias("quantiles"))

