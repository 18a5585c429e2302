"""Cutting long series into blocks, so that a few symbols still make many tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
#: Rows of a block of the recurrence: decay**-255 must stay far from overflow.
SCAN_ROWS = 256
SPAN_MS = 30 * 86_400_000
MOST_REMEMBERED = 1e-18


def numbered(df: DataFrame, key: str = "symbol", order: str = "open_time", span: int = SPAN_MS) -> DataFrame:
    """Add rn, the place of a row in its key's order from 0, without one task for all rows of a key.

    Rows are ranked within (key, span of ``order``); the rows before each span come from counts of spans. ``order`` is BIGINT and unique within a key.
    """
    spans = df.withColumn("span_", F.floor(F.col(order) / span))
    counts = spans.groupBy(F.col(key).alias("key_"), F.col("span_").alias("of_")).agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy("key_").orderBy("of_").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before_", F.coalesce(before, F.lit(0))).drop("n_")
    joined = spans.join(counts, (F.col(key) == F.col("key_")) & (F.col("span_") == F.col("of_")))
    rank = F.row_number().over(Window.partitionBy(key, "span_").orderBy(order))
    return joined.withColumn("rn", F.col("before_") + rank - 1).drop("key_", "of_", "span_", "before_")


@dataclass
class Blocked:
    """Rows copied into the blocks that need them; ``window`` orders a block, ``own`` tells a block's rows from its halo."""

    rows: DataFrame
    window: WindowSpec

    def back(self, n: int) -> WindowSpec:
        """The frame of the last ``n`` rows, the current one included."""
        return self.window.rowsBetween(-(n - 1), 0)

    @staticmethod
    def home(df: DataFrame) -> DataFrame:
        return df.where("home_ = block_").drop("home_", "block_")


def blocked(df: DataFrame, behind: int, ahead: int = 0, key: str = "symbol", order: str = "open_time", rows: int = BLOCK_ROWS) -> Blocked:
    """Cut numbered rows into blocks with ``behind`` rows of the block before and ``ahead`` of the one after.

    Window functions over a block then see all rows that a frame of that reach asks for, and a block's rows are as many as ``rows``
    however long the series is.
    """
    source = df if "rn" in df.columns else numbered(df, key, order)
    first = F.greatest(F.floor((F.col("rn") - ahead) / rows), F.lit(0))
    placed = source.withColumn("home_", F.floor(F.col("rn") / rows)).withColumn("block_", F.explode(F.sequence(first, F.floor((F.col("rn") + behind) / rows))))
    return Blocked(placed, Window.partitionBy(key, "block_").orderBy(order))


@dataclass(frozen=True)
class Recurrence:
    """h[t] = decay * h[t-1] + input[t], h before the first row being 0."""

    name: str
    input: F.Column
    decay: float


def memory(*decays: float, rows: int = SCAN_ROWS) -> int:
    """Rows after which recurrences of these decays keep less than MOST_REMEMBERED of a value, in whole scan blocks: the halo that :func:`recurrences` needs."""
    return -(-int(np.ceil(np.log(MOST_REMEMBERED) / np.log(max(decays)))) // rows) * rows


def recurrences(b: Blocked, specs: list[Recurrence], key: str = "symbol", rows: int = SCAN_ROWS) -> Blocked:
    """Add each recurrence as a column of numbered rows, within the blocks that are there: no further shuffle.

    A scan block of ``rows`` rows has decay^j * sum(input_i * decay^-i), a running sum; the last value of an earlier scan block reaches it with
    decay^rows for each block between, until that is under MOST_REMEMBERED. The halo behind must be :func:`memory` of the decays, so that what the
    block's first rows lack is forgotten by its own. A null input counts as 0.
    """
    scan = b.rows.withColumn("at_", F.floor(F.col("rn") / rows)).withColumn("j_", F.col("rn") % rows)
    upto = Window.partitionBy(key, "block_", "at_").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    scaled = {s.name: F.coalesce(s.input, F.lit(0.0)) * F.pow(F.lit(s.decay), -F.col("j_")) for s in specs}
    scan = scan.withColumns({f"local_{s.name}": F.pow(F.lit(s.decay), F.col("j_")) * F.sum(scaled[s.name]).over(upto) for s in specs})

    def carried(s: Recurrence) -> F.Column:
        end = F.when(F.col("j_") == rows - 1, F.col(f"local_{s.name}"))
        total = F.lit(0.0)
        for k in range(1, memory(s.decay, rows=rows) // rows + 1):
            earlier = Window.partitionBy(key, "block_").orderBy("at_").rangeBetween(-k, -k)
            total = total + F.coalesce(F.sum(end).over(earlier), F.lit(0.0)) * s.decay ** ((k - 1) * rows)
        return total

    scan = scan.withColumns({s.name: F.col(f"local_{s.name}") + carried(s) * F.pow(F.lit(s.decay), F.col("j_") + 1) for s in specs})
    return Blocked(scan.drop("at_", "j_", *[f"local_{s.name}" for s in specs]), b.window)
