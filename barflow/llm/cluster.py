"""Shared folders, lineage cuts and connected components for the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset a local session, which has one machine only, gets a temporary one;
    a cluster raises RuntimeError, as its executors would write to folders of their own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="barflow-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def table_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that one run writes and reads again."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or it with as many underscores as it takes to clash with no column of ``df``, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has BIGINT columns ``u`` and ``v``; loops, repeats and either direction are accepted,
    rows with a null end are ignored. Returns (node, component), one row per node. Alternates the
    large-star and small-star rewrites until the edge set stands still, so a hub costs one partial
    minimum and a join that can be split, never a collected neighbour list. Raises RuntimeError
    if ``max_rounds`` do not suffice.
    """
    links = cut_lineage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _signature(links)
    for _ in range(max_rounds):
        links = cut_lineage(_small_star(_large_star(links)))
        after = _signature(links)
        if after == before:
            roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is tied to the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest neighbour."""
    least = links.groupBy("u").agg(F.min("v").alias("low"))
    moved = links.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(least.select("u", F.col("low").alias("v"))).distinct()
