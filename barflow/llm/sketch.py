"""Bottom-k sketches of word shingles: mergeable fingerprints of documents."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 128
WORDS = 5
BLOCK_BYTES = 1 << 20
RANGES_PER_SPLIT, MOST_RANGES = 4, 200_000

#: Odd multipliers of the rolling hash and of the final mixing.
BASE, STEP, MIX_A, MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
RANGE = 2.0**63


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


class _Tables:
    """Powers of the base and of its inverse, grown to the longest block seen."""

    up = _powers(int(BASE), 1 << 12)
    down = _powers(pow(int(BASE), -1, 1 << 64), 1 << 12)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << int(np.ceil(np.log2(n)))
            cls.up, cls.down = _powers(int(BASE), size), _powers(pow(int(BASE), -1, 1 << 64), size)
        return cls.up[:n], cls.down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _word_hashes(block: np.ndarray) -> np.ndarray:
    """A hash of each word of a block of bytes, from differences of one running polynomial."""
    letter = ~SPACE[block]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False]))))
    starts, ends = edges[::2], edges[1::2]
    up, down = _Tables.of(len(block) + 1)
    sums = np.empty(len(block) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """63-bit hashes of all shingles of ``words`` words (repeats included); fewer words make one shingle, none gives an empty array."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    parts, start = [], 0
    while start < len(data):
        end = min(start + BLOCK_BYTES, len(data))
        while end < len(data) and not SPACE[data[end]]:
            end = min(end + 1 + int(np.argmax(np.append(SPACE[data[end + 1 : end + BLOCK_BYTES]], True))), len(data))
        parts.append(_word_hashes(data[start:end]))
        start = end
    hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    n = len(hashes) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * STEP + hashes[i : i + n]
    return _mixed(total + np.uint64(width)) >> np.uint64(1)


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if len(hashes) > 16 * k:  # repeats can hide some of the k: then all are sorted
        part = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(part) > k:
            return part[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts' union."""
    return np.union1d(a, b)[:k]


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * RANGE / float(sketch[k - 1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of the shingle sets; exact below k. Two empty sketches are alike (1.0), an empty one is unlike any other."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's distinct shingles that b has; an empty a is contained in anything."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def as_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def with_sketch(df: DataFrame, text: str = "text", out: str = "sketch", k: int = K, words: int = WORDS) -> DataFrame:
    """Add the bottom-k sketch of ``text`` as an ascending ARRAY<BIGINT>; null, empty and blank texts have an empty one."""

    @F.pandas_udf("array<long>")
    def sketch(texts: pd.Series) -> pd.Series:
        return pd.Series([bottom(shingle_hashes(t, words), k).astype(np.int64) for t in texts])

    return df.withColumn(out, sketch(F.col(f"`{text}`")))


def merge_sketches(df: DataFrame, by: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each value of ``by``: that of all its parts together.

    Keeps the k smallest distinct hashes by a ranked window, whose limit Spark applies before the shuffle, so a hot value moves k rows from
    each task. Parts with an empty or null sketch add nothing; a value that has only these gets an empty one. Null keys group together.
    """
    rows = df.select(*by, F.explode_outer(sketch).alias("hash_"))
    ranked = rows.where("hash_ IS NOT NULL").withColumn("rank_", F.dense_rank().over(Window.partitionBy(*by).orderBy("hash_"))).where(F.col("rank_") <= k)
    full = ranked.groupBy(*by).agg(F.array_sort(F.collect_set("hash_")).alias(sketch))
    empty = df.groupBy(*by).agg(F.max(F.size(F.coalesce(sketch, F.array()))).alias("most_")).where("most_ = 0").select(*by, F.array().cast("array<long>").alias(sketch))
    return full.unionByName(empty)


def with_estimates(df: DataFrame, left: str, right: str, k: int = K) -> DataFrame:
    """Add resemblance, left_in_right, right_in_left, left_distinct and right_distinct of two sketch columns; a null sketch counts as empty."""

    @F.pandas_udf("resemblance double, left_in_right double, right_in_left double, left_distinct double, right_distinct double")
    def estimate(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        def array(x):
            return np.empty(0, np.uint64) if x is None else np.asarray(x, np.int64).astype(np.uint64)

        pairs = [(array(x), array(y)) for x, y in zip(a, b)]
        rows = [(resemblance(x, y, k), containment(x, y, k), containment(y, x, k), distinct(x, k), distinct(y, k)) for x, y in pairs]
        return pd.DataFrame(rows, columns=["resemblance", "left_in_right", "right_in_left", "left_distinct", "right_distinct"], dtype=float)

    return df.withColumn("estimate_", estimate(left, right)).select(*df.columns, "estimate_.*")


def beside_next(df: DataFrame, id_col: str, text: str, each, schema: str) -> DataFrame:
    """Run ``each`` over every row beside the next in ascending id (after the last: the first), without one task for all.

    ``each`` takes an iterator of (id, text, next text) and yields tuples of ``schema``. Ids come in order with nulls first, equal ids in order
    of their texts; a lone row is its own next. Null texts pass as empty. Rows go once to a range of ids; the first id of each range is sent to the
    range before it as well, so no second shuffle has to find a neighbour. The ids alone are dealt to ranges first, whose smallest ids are the
    bounds; there are RANGES_PER_SPLIT ranges for each part of ``df`` (at most MOST_RANGES).
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id_"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text_"))
    parts = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), RANGES_PER_SPLIT * df.rdd.getNumPartitions()))
    ranges = df.select(F.col(f"`{id_col}`").cast("long").alias("id_")).repartitionByRange(parts, "id_").groupBy(F.spark_partition_id().alias("range_"))
    lowest = ranges.agg(F.min("id_").alias("low_"), F.count_if(F.col("id_").isNull()).alias("absent_")).collect()
    lows = sorted(r["low_"] for r in lowest if r["low_"] is not None)
    bounds = np.array(lows[1:], np.int64)
    first = None if not lows or any(r["absent_"] for r in lowest) else lows[0]

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, absent: pd.Series) -> pd.Series:
        missing, known = absent.to_numpy(bool), ids.to_numpy(np.int64)
        own = np.where(missing, 0, np.searchsorted(bounds, known, side="right"))
        out = []
        for o, x, lost in zip(own.tolist(), known.tolist(), missing.tolist()):
            to = [o]
            if o and not lost and bounds[o - 1] == x:
                to.append(o - 1)
            if lost if first is None else (not lost and x == first):
                to.append(len(bounds))
            out.append(to)
        return pd.Series(out)

    place = places(F.coalesce("id_", F.lit(0)), F.col("id_").isNull())  # a null among them would turn the ids into doubles
    sent = rows.select("id_", "text_", F.posexplode(place).alias("copy_", "place_"))
    ranged = sent.withColumn("guest_", F.col("copy_") > 0).drop("copy_").repartitionById(len(bounds) + 1, F.col("place_"))
    ordered = ranged.sortWithinPartitions("place_", "guest_", F.col("id_").asc_nulls_first(), "text_")

    def run(batches):
        import pyarrow as pa

        def triples():
            held, done = None, False
            for batch in batches:
                for id_, t, guest in zip(batch.column("id_").to_pylist(), batch.column("text_"), batch.column("guest_").to_pylist()):
                    if done:
                        continue
                    t = t.as_py()
                    if held is not None:
                        yield held[0], held[1], t
                    held, done = (id_, t), guest
        got, size = [], 0
        target = _arrow_schema(schema)
        for row in each(triples()):
            got.append(row)
            size += sum(len(x) for x in row if isinstance(x, str))
            if size > 8 << 20 or len(got) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), target)], schema=target)
                got, size = [], 0
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), target)], schema=target)

    return ordered.select("id_", "text_", "guest_").mapInArrow(run, schema)


def _arrow_schema(ddl: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(","))])


def half_edited(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprint every text and its edited text: the last floor(n/2) code points give way to the first as many (or all) of the next document.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). Nulls, ties and a single row: see
    :func:`beside_next`; a null text counts as empty; an empty table gives no rows; other columns are not looked at.
    """

    def each(rows):
        last_text, last = None, None
        for id_, own, following in rows:
            mine = last if last_text is own else bottom(shingle_hashes(own, words), k)
            half = len(own) // 2
            edited = own[: len(own) - half] + following[:half]
            changed = bottom(shingle_hashes(edited, words), k)
            last_text, last = following, bottom(shingle_hashes(following, words), k)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            yield id_, len(own), digest, as_text(mine), as_text(changed), resemblance(mine, changed, k), resemblance(mine, last, k)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(df, id_col, text, each, schema).withColumnRenamed("doc_id", id_col)
