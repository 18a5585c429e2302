"""Starting, draining and serving streams; all folders lie under the session's shared checkpoint folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.plans.lineage import checkpointed, shared_root
from barflow.streaming.state import typed_state

#: Rows of a staged file, and files of a micro-batch: more rows make more micro-batches, not larger ones.
ROWS_PER_FILE, FILES_PER_TRIGGER = 1_000_000, 1
#: The log of Spark's file sink, and how many of its numbers one compacted file stands for.
MANIFEST, MANIFEST_COMPACTED = "_spark_metadata", 10
KEPT_VERSIONS, BUCKETS = 3, 64


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, see :func:`barflow.plans.lineage.shared_root`."""
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder as a stream: everything that is there (replay), then what arrives."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of a folder, and its data files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, [x for x in system.listStatus(folder) if not x.getPath().getName().startswith(("_", "."))] if system.exists(folder) else []


def _text(spark: SparkSession, path: str, text: str | None = None) -> str:
    """Write a small text file as a whole, or read one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if text is None:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(system.open(at), "UTF-8")
    out = system.create(at, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    return text


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers that name the files of a folder, ascending."""
    return sorted(int(n.split(".")[0]) for x in _files(spark, path)[1] if (n := x.getPath().getName()).split(".")[0].isdigit())


def staged(df: DataFrame, order: str, parts: int, path: str | None = None) -> str:
    """Write ``df`` as files of ascending ranges of ``order``, ``parts`` of them or one for each ROWS_PER_FILE rows, which a stream replays in order.

    ``df`` is computed once and written by parallel tasks. The order stands in a manifest beside the files, the log that Spark's own file sink keeps and its
    file source reads: it names each file with a place that goes on from what stands at ``path`` already, so the dates that a store gives its files do not
    count. Rows of equal ``order`` share a file; an empty ``df`` leaves one without rows.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = path or f"{folder}/staged"
    df.write.parquet(f"{folder}/whole")
    whole = spark.read.schema(df.schema).parquet(f"{folder}/whole")
    known = {str(x.getPath()) for x in _files(spark, path)[1]}
    whole.repartitionByRange(max(parts, -(-whole.count() // ROWS_PER_FILE)), order).write.mode("append").parquet(path)
    fresh = sorted((x for x in _files(spark, path)[1] if str(x.getPath()) not in known), key=lambda x: x.getPath().getName())
    entry = {"isDir": False, "blockReplication": 1, "blockSize": 1 << 25, "action": "add"}
    named = [entry | {"path": str(x.getPath().toUri()), "size": x.getLen(), "modificationTime": len(known) + 1 + i} for i, x in enumerate(fresh)]
    log = f"{path}/{MANIFEST}"
    before = _numbers(spark, log)
    number = before[-1] + 1 if before else 0
    lines = [json.dumps(x) for x in named]
    if number % MANIFEST_COMPACTED == MANIFEST_COMPACTED - 1:  # the log's own rule: such a number stands for all before it
        lines = [*_entries(spark, log), *lines]
    _text(spark, f"{log}/{number}" + ".compact" * (number % MANIFEST_COMPACTED == MANIFEST_COMPACTED - 1), "\n".join(["v1", *lines]))
    return path


def _entries(spark: SparkSession, log: str) -> list[str]:
    """All lines of a manifest, from its last compacted number on."""
    names = sorted((x.getPath().getName() for x in _files(spark, log)[1]), key=lambda n: int(n.split(".")[0]))
    start = max([i for i, n in enumerate(names) if n.endswith(".compact")], default=0)
    return [line for n in names[start:] for line in _text(spark, f"{log}/{n}").split("\n")[1:]]


def subscribed(spark: SparkSession, path: str, schema) -> Callable[[], DataFrame]:
    """Subscribe to a staged folder from now on: what its manifest names already is left out. The result drains what has come since: the rows of the files that it names by then."""
    since = max((json.loads(line)["modificationTime"] for line in _entries(spark, f"{path}/{MANIFEST}")), default=-1)

    def late() -> DataFrame:
        named = [json.loads(line) for line in _entries(spark, f"{path}/{MANIFEST}")]
        fresh = spark.createDataFrame([(x["path"].rsplit("/", 1)[1],) for x in named if x["modificationTime"] > since], "file_ string")
        rows = source(spark, path, schema, FILES_PER_TRIGGER).withColumn("of_", F.col("_metadata.file_name"))
        return drained(rows.join(fresh, F.col("of_") == F.col("file_"), "left_semi").select(*schema.names))

    return late


def drained(stream: DataFrame, mode: str = "append", partition_by: list[str] | None = None) -> DataFrame:
    """Run a stream until its source is used up, into Parquet with a checkpoint, and read the result. A broken run resumes from the checkpoint without doubles."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with typed_state(spark):
        writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def forget(spark: SparkSession, path: str) -> None:
    """Delete a version's folder, where it is there."""
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def serve_latest(stream: DataFrame, key: str, order: str, path: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Keep only the newest row of each key at ``path``: slow readers never see a backlog.

    Keys lie in buckets by their hash. A micro-batch reads and writes only the buckets that it has keys of, as files of its own number, and then a
    manifest of one small file that says which number each bucket has: a reader sees all of a micro-batch or nothing. Files that a newer number has replaced stay
    for KEPT_VERSIONS micro-batches more.
    """
    spark = stream.sparkSession
    rest = [c for c in stream.columns if c != key]

    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def newest(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket_", bucket).groupBy("bucket_", key).agg(F.max_by(F.struct(*rest), order).alias("x")).select("bucket_", key, "x.*")

    def merge(batch: DataFrame, number: int) -> None:
        rows = checkpointed(newest(batch))
        known = [n for n in _numbers(spark, f"{path}/manifest") if n < number]
        manifest = json.loads(_text(spark, f"{path}/manifest/{known[-1]}.json")) if known else {"buckets": {}, "replaced": []}
        changed = [str(r[0]) for r in rows.select("bucket_").distinct().collect()]
        old = [f"{path}/data/{manifest['buckets'][b]}/bucket_={b}" for b in changed if b in manifest["buckets"]]
        both = rows if not old else rows.drop("bucket_").unionByName(spark.read.schema(stream.schema).parquet(*old))
        newest(both).repartition("bucket_").write.mode("overwrite").partitionBy("bucket_").parquet(f"{path}/data/{number}")
        for at, gone in manifest["replaced"]:
            if at <= number - KEPT_VERSIONS:
                forget(spark, gone)
        replaced = [x for x in manifest["replaced"] if x[0] > number - KEPT_VERSIONS] + [[number, x] for x in old]
        _text(spark, f"{path}/manifest/{number}.json", json.dumps({"buckets": manifest["buckets"] | {b: number for b in changed}, "replaced": replaced}))
        forget(spark, f"{path}/manifest/{number - KEPT_VERSIONS}.json")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_version(spark: SparkSession, path: str, schema) -> DataFrame:
    """The serving table as its last manifest has it."""
    numbers = _numbers(spark, f"{path}/manifest")
    parts = [f"{path}/data/{n}/bucket_={b}" for b, n in json.loads(_text(spark, f"{path}/manifest/{numbers[-1]}.json"))["buckets"].items()] if numbers else []
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
