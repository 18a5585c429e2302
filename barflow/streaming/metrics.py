"""Service metrics of a stream as a table of rows that add up: counters, last values and latency histograms by beat."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.functions.signals import log_linear_bucket
from barflow.plans.running import running
from barflow.streaming.runner import KEPT_VERSIONS, _numbers, _text, forget

#: Milliseconds of a beat, and how many micro-batches' files are merged into one.
BEAT, MERGED = 5000, 64
KEYS = ["service", "metric"]
SCHEMA = "service string, metric string, beat long, bucket int, n long, total long, top long, last struct<ts: long, seq: long, ns: long>"
_SPAN = 1 << 26


def _folded(rows: DataFrame) -> DataFrame:
    sums = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top"), F.max("last").alias("last")]
    return rows.groupBy(*KEYS, "beat", "bucket").agg(*sums)


def record(stream: DataFrame, path: str, checkpoint: str, beat: int = BEAT, merged: int = MERGED) -> None:
    """Drain a stream of (service, metric, ns, ts in ms, seq) into the metrics table at ``path``; rows without ns or ts are left out.

    A micro-batch adds its counts by service, metric, beat (the ``beat`` milliseconds that ts lies in) and histogram bucket, as files of its own number. Then a
    manifest names all files that count: a micro-batch that is done again after a broken run replaces its own rows, so totals go on without doubles, and a
    reader sees all of it or nothing. After ``merged`` micro-batches their rows are added up into one set of files; what that replaces stays for KEPT_VERSIONS
    micro-batches more.
    """
    spark = stream.sparkSession
    wanted = stream.where("ns IS NOT NULL AND ts IS NOT NULL").select(
        *KEYS, (F.floor(F.col("ts") / beat) * beat).alias("beat"), log_linear_bucket(F.col("ns")).alias("bucket"), F.lit(1).alias("n"), F.col("ns").alias("total"), F.col("ns").alias("top"), F.struct("ts", "seq", "ns").alias("last"),
    )

    def write(rows: DataFrame, name: str) -> str:
        _folded(rows).write.mode("overwrite").parquet(f"{path}/data/{name}")
        return f"{path}/data/{name}"

    def add(batch: DataFrame, number: int) -> None:
        known = [n for n in _numbers(spark, f"{path}/manifest") if n < number]
        held = json.loads(_text(spark, f"{path}/manifest/{known[-1]}.json")) if known else {"merged": [], "fresh": [], "replaced": []}
        fresh = [*held["fresh"], write(batch, str(number))]
        gone, stay = [x for x in held["replaced"] if x[0] <= number - KEPT_VERSIONS], [x for x in held["replaced"] if x[0] > number - KEPT_VERSIONS]
        for _, old in gone:
            forget(spark, old)
        if len(fresh) >= merged:
            whole = write(spark.read.schema(SCHEMA).parquet(*fresh), f"{number}-merged")
            held = {"merged": [*held["merged"], whole], "fresh": [], "replaced": [*stay, *[[number, x] for x in fresh]]}
        else:
            held = {"merged": held["merged"], "fresh": fresh, "replaced": stay}
        _text(spark, f"{path}/manifest/{number}.json", json.dumps(held))
        forget(spark, f"{path}/manifest/{number - KEPT_VERSIONS}.json")

    wanted.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def table(spark: SparkSession, path: str) -> DataFrame:
    """The metrics table as its last manifest has it: rows of SCHEMA that add up by any of its keys."""
    numbers = _numbers(spark, f"{path}/manifest")
    held = json.loads(_text(spark, f"{path}/manifest/{numbers[-1]}.json")) if numbers else {"merged": [], "fresh": []}
    files = [*held["merged"], *held["fresh"]]
    return spark.read.schema(SCHEMA).parquet(*files) if files else spark.createDataFrame([], SCHEMA)


def totals(rows: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """counter, total, top and gauge (the ns of the last ts, of equals the last seq) of each group."""
    return rows.groupBy(*by).agg(F.sum("n").alias("counter"), F.sum("total").alias("total"), F.max("top").alias("top"), F.max("last")["ns"].alias("gauge"))


def heartbeat(rows: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """What each group would report at its beats: counter and total up to the beat's end, and gauge. Beats without a row are not there."""
    beats = rows.groupBy(*by, "beat").agg(F.sum("n").alias("n"), F.sum("total").alias("sum_"), F.max("last")["ns"].alias("gauge"))
    span = F.floor(F.col("beat") / _SPAN)
    counted = running(beats, by, ["beat"], span, "counter", F.col("n"))
    return running(counted, by, ["beat"], span, "total", F.col("sum_")).select(*by, "beat", "counter", "total", "gauge")
