"""SimHash fingerprints and near-duplicate components by meet-in-the-middle ball hashing."""

from __future__ import annotations

from functools import partial
from itertools import combinations, islice
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.llm.cluster import connected_components, cut_lineage

BITS = 64
SHINGLE_WORDS = 4
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
HASHES_AT_ONCE = 1 << 16
VARIANTS_AT_ONCE = 1 << 21
#: Rows of a task, and bits by which large buckets are cut at a time.
TASK_ROWS, DEEPER_BITS = 2_000_000, 8

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a text.

    A-Z are lower-cased, words are the runs between space and 0x09-0x0D, every shingle of ``words``
    words counts as often as it occurs; fewer words make one shingle; null, empty and blank texts
    give 0. A bit is set when over half of the shingle hashes have it.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return _hash(b" ".join(tokens))
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    total = len(tokens) - words + 1
    counts = np.zeros(BITS, np.int64)
    for start in range(0, total, HASHES_AT_ONCE):
        n = min(HASHES_AT_ONCE, total - start)
        hashes = np.fromiter(map(_hash, islice(shingles, n)), np.uint64, n)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    prints = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
    return pd.Series(prints.view(np.int64))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the SimHash of ``text`` as a BIGINT holding the unsigned value's bits."""
    return df.withColumn(out, fingerprint_udf(F.col(f"`{text}`")))


def as_hex(column) -> F.Column:
    """The 16 lower-case hex digits of a BIGINT fingerprint."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _prefixes(prints: np.ndarray, bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Top-``bits`` prefixes of every variant with up to ``budget`` flips, and whose they are."""
    own = (prints >> np.uint64(BITS - bits)).astype(np.int64)
    masks = np.array([sum(1 << b for b in c) for r in range(budget + 1) for c in combinations(range(bits), r)], np.int64)
    return (own[:, None] ^ masks).ravel(), np.repeat(np.arange(len(prints)), len(masks))


def _leaf_pairs(prints: np.ndarray, left: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours in the sorted list of variants that share one; ``left``: flips each has left in ``free`` bits."""
    one = np.array([1 << b for b in range(free)], np.uint64)
    two = np.array([(1 << a) | (1 << b) for a, b in combinations(range(free), 2)], np.uint64)
    values, owners = [prints], [np.arange(len(prints))]
    for least, masks in ((1, one), (2, two)):
        who = np.flatnonzero(left >= least)
        values.append((prints[who][:, None] ^ masks).ravel())
        owners.append(np.repeat(who, len(masks)))
    # variants differ from their owner in the free bits only: these identify them together with the fixed ones
    values, owners = np.concatenate(values), np.concatenate(owners)
    ordered = np.sort(values)
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(repeated):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    mixed = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
    seen = np.zeros(1 << 20, bool)
    seen[mixed(repeated)] = True
    keep = seen[mixed(values)]
    values, owners = values[keep], owners[keep]
    order = np.lexsort((owners, values))
    values, owners = values[order], owners[order]
    same = (values[1:] == values[:-1]) & (owners[1:] != owners[:-1])
    pairs = np.unique(owners[:-1][same] * len(prints) + owners[1:][same])
    return pairs // len(prints), pairs % len(prints)


def _collide(prints: np.ndarray, left: np.ndarray, free: int, emit) -> None:
    """Find fingerprints that share a variant, cutting the variants bit by bit until a part is small.

    ``prints`` have the fixed bits as the variants have them. Each half of the next bit gets its own fingerprints, and those of
    the other half that can still flip it.
    """
    if len(prints) < 2:
        return
    made = (1 + free * (left >= 1) + free * (free - 1) // 2 * (left >= 2)).sum()
    if made > VARIANTS_AT_ONCE and free:
        top = np.uint64(1 << (free - 1))
        for side in (0, 1):
            own = ((prints & top) != 0) == bool(side)
            take = np.flatnonzero(own | (left >= 1))
            flipped = ~own[take]
            _collide(np.where(flipped, prints[take] ^ top, prints[take]), left[take] - flipped, free - 1, lambda a, b, take=take: emit(take[a], take[b]))
        return
    emit(*_leaf_pairs(prints, left, free))


def spanning_links(prints: np.ndarray, prefix: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket of variants: each fingerprint beside the smallest of those it hangs together with.

    ``prints`` are distinct; ``prefix`` is the bucket's value of the top ``bits``. Colliding pairs are deduplicated and verified
    by their distance before they are joined, so that a dense bucket returns fewer links than fingerprints.
    """
    shift = np.uint64(BITS - bits)
    flips = np.bitwise_count((prints >> shift) ^ np.uint64(prefix)).astype(np.int64)
    moved = (prints & np.uint64((1 << (BITS - bits)) - 1)) | (np.uint64(prefix) << shift)
    label = np.arange(len(prints))

    def emit(a: np.ndarray, b: np.ndarray) -> None:
        near = np.bitwise_count(prints[a] ^ prints[b]) <= radius
        _join(label, a[near], b[near])

    _collide(moved, radius // 2 - flips, BITS - bits, emit)
    tied = np.flatnonzero(label != np.arange(len(prints)))
    return prints[tied], prints[label[tied]]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i] in place; a class is labelled by its smallest index."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        x, y = x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            next_ = label[label]
            if (next_ == label).all():
                break
            label[:] = next_


def _balls(bits: int, radius: int) -> int:
    """Number of ways to flip up to ``radius`` of ``bits`` bits."""
    return sum(comb(bits, r) for r in range(radius + 1))


def _spread(batches, bits: int, half: int):
    """Each fingerprint beside every bucket, of top bits, that one of its variants falls in."""
    import pyarrow as pa

    step = max(1, 1_000_000 // _balls(bits, half))
    for batch in batches:
        own = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(own), step):
            part = own[at : at + step]
            bucket, who = _prefixes(part.view(np.uint64), bits, half)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(part[who])], names=["bucket", "print"])


def _around(batches, bits: int, half: int):
    """The buckets within ``half`` flips of each given one."""
    import pyarrow as pa

    for batch in batches:
        own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(own), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(_prefixes(own[at : at + 1000] << np.uint64(BITS - bits), bits, half)[0])], names=["bucket"])


def _deepen(batches, before: int, bits: int, half: int):
    """Fingerprints of buckets of ``before`` top bits beside those of ``bits`` bits that their variants fall in, with the flips that are left."""
    import pyarrow as pa

    more = bits - before
    for batch in batches:
        bucket, own = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        left = half - np.bitwise_count((own >> np.uint64(BITS - before)) ^ bucket).astype(np.int64)
        tail = (own >> np.uint64(BITS - bits)) & np.uint64((1 << more) - 1)
        for flips in range(half + 1):
            masks = np.array([sum(1 << b for b in c) for r in range(flips + 1) for c in combinations(range(more), r)], np.uint64)
            who = np.flatnonzero(left == flips)
            for at in range(0, len(who), 10_000):
                w = who[at : at + 10_000]
                deeper = (bucket[w] << np.uint64(more))[:, None] | (tail[w][:, None] ^ masks)
                yield pa.RecordBatch.from_arrays([pa.array(deeper.ravel().view(np.int64)), pa.array(np.repeat(own[w], len(masks)).view(np.int64))], names=["bucket", "print"])


def _meet(batches, bits: int, radius: int):
    """A spanning set of links of each bucket."""
    import pyarrow as pa

    got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not got:
        return
    buckets, owners = (np.concatenate(x) for x in zip(*got))
    order = np.argsort(buckets, kind="stable")
    buckets, owners = buckets[order].view(np.uint64), owners[order].view(np.uint64)
    ends = np.flatnonzero(np.r_[buckets[1:] != buckets[:-1], True]) + 1
    start = 0
    for end in ends:
        u, v = spanning_links(np.sort(owners[start:end]), int(buckets[start]), bits, radius)
        start = end
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def near_links(prints: DataFrame, column: str = "fingerprint", radius: int = 4, variants_per_bucket: int = 1 << 20) -> DataFrame:
    """Links (u, v) that join all fingerprints of ``prints`` within ``radius`` bits into the right components.

    Every distinct fingerprint emits its variants within half the radius. Two fingerprints within the radius share one of
    these; two that share one are within the radius. A variant travels as its owner plus the bucket of its top bits: owners
    go to each bucket that one of their variants falls in (1 + k + k(k-1)/2 rows for k bits and two flips) and the bucket
    expands the rest, so that the shuffle carries dozens of rows for each fingerprint instead of two thousand. k follows
    the number of fingerprints, so buckets stay of one size. Where families of fingerprints share their top bits, the buckets
    around those bits go on with DEEPER_BITS more bits, again and again, so none is one task's; nulls have no part.
    """
    if radius not in (0, 2, 4):
        raise ValueError("radius must be 0, 2 or 4: variants with more than two flips are not made")
    half = radius // 2
    distinct = cut_lineage(prints.select(F.col(f"`{column}`").alias("print")).where("print IS NOT NULL").distinct())
    least, total = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), distinct.count()
    tasks = lambda rows: max(least, -(-rows // TASK_ROWS))
    bits = max(8, min(30, int(np.ceil(np.log2(max(1, total * _balls(BITS, half) / variants_per_bucket))))))
    # a bucket holds the fingerprints whose own top bits are within half the radius of it: away from crowded ones it is of usual size
    usual = max(1, 8 * variants_per_bucket // _balls(BITS, half))
    own = F.shiftrightunsigned("print", BITS - bits).alias("own")
    crowded = cut_lineage(distinct.groupBy(own).count().where(F.col("count") > usual).select("own"))
    wide = None if crowded.isEmpty() else crowded.mapInArrow(partial(_around, bits=bits, half=half), "bucket long").distinct()
    placed = distinct.repartition(tasks(total * _balls(bits, half))).mapInArrow(partial(_spread, bits=bits, half=half), "bucket long, print long")
    rows, links = total * _balls(bits, half), None
    while True:
        cold = placed if wide is None else placed.join(wide, "bucket", "left_anti")
        met = cold.repartition(tasks(rows), "bucket").mapInArrow(partial(_meet, bits=bits, radius=radius), "u long, v long")
        links = met if links is None else links.unionByName(met)
        if wide is None:
            return links
        hot, before, bits = cut_lineage(placed.join(wide, "bucket", "left_semi").select("bucket", "print")), bits, min(BITS, bits + DEEPER_BITS)
        spread = hot.repartition(tasks(hot.count() * _balls(bits - before, half)))
        placed = cut_lineage(spread.mapInArrow(partial(_deepen, before=before, bits=bits, half=half), "bucket long, print long"))
        rows = placed.count()
        wide = cut_lineage(placed.groupBy("bucket").count().where(F.col("count") > usual * _balls(bits, half)).select("bucket"))
        wide = None if bits == BITS or wide.isEmpty() else wide


def _classes(df: DataFrame, id_col: str, text: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """Rows as (id_, print_), and for each fingerprint its component's root and smallest id."""
    prints = cut_lineage(df.select(F.col(f"`{id_col}`").alias("id_"), fingerprint_udf(F.col(f"`{text}`")).alias("print_")))
    nodes = prints.groupBy("print_").agg(F.min("id_").alias("low_"))
    found = connected_components(near_links(prints, "print_", radius))
    rooted = cut_lineage(nodes.join(found.withColumnRenamed("node", "print_"), "print_", "left").select("print_", "low_", F.coalesce("component", "print_").alias("root_")))
    # written first: Spark splits a root with many fingerprints only between plain shuffles
    lowest = cut_lineage(rooted.groupBy("root_").agg(F.min("low_").alias("component_id")))
    return prints, cut_lineage(rooted.join(lowest, "root_").select("print_", "root_", "component_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """(id, fingerprint BIGINT, component_id) for every row: its fingerprint and the smallest id reachable by links.

    Rows with equal fingerprints are one node, however many they are. Null, empty and blank texts have fingerprint 0 and link like
    any other. Null ids keep their row and never name a component, which is null if no member has an id; repeated ids repeat in the
    result. Other columns are not looked at.
    """
    prints, named = _classes(df, id_col, text, radius)
    return prints.join(named, "print_").select(F.col("id_").alias(id_col), F.col("print_").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row with the smallest id stays, with all its columns.

    A row without an id stays only where no row of its component has one (the smallest fingerprint of these). Of rows that share
    id and fingerprint one stays, that with the smallest text. Other columns may have any name.
    """
    names, df = df.columns, df.toDF(*[f"c{i}_" for i in range(len(df.columns))])
    id_col, text = (f"c{names.index(c)}_" for c in (id_col, text))
    prints, named = _classes(df, id_col, text, radius)
    first = F.min(F.struct(F.col("id_").isNull().alias("absent"), "id_", "print_")).alias("first")
    leaders = cut_lineage(prints.join(named, "print_").groupBy("root_").agg(first).select("first.id_", "first.print_"))
    same_id = F.col(id_col).eqNullSafe(F.col("id_"))
    led = df.join(leaders.select("id_").distinct(), same_id, "left_semi")
    repeated = cut_lineage(prints.join(leaders.select("id_").distinct(), prints["id_"].eqNullSafe(leaders["id_"]), "left_semi").groupBy("id_").count().where("count > 1").select("id_"))
    if repeated.isEmpty():
        return led.toDF(*names)
    columns = [F.col(c) for c in df.columns]
    several = with_fingerprint(led.join(repeated, same_id, "left_semi"), text, "print__")
    both = same_id & (F.col("print__") == F.col("print_"))
    chosen = several.join(leaders, both, "left_semi").groupBy(id_col, "print__").agg(F.min_by(F.struct(*columns), text).alias("row__"), F.first(F.struct(*columns)).alias("any__"))
    row = F.coalesce("row__", "any__")
    return led.join(repeated, same_id, "left_anti").unionByName(chosen.select(row.alias("row__")).select("row__.*")).toDF(*names)
