"""Embedding near-duplicates by p-stable hashing of normalised vectors, with exact cosine checks inside the buckets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.cluster import connected_components, cut_lineage

#: Members of a bucket that are compared at once.
BLOCK = 2048
#: Members of a bucket that a task gets; larger buckets are cut into blocks of about this size, and tasks share the pairs of blocks.
SPLIT = 8192
#: One in so many vectors tells which buckets are large before all are hashed; this steers the cutting only, never what is compared.
LOOKED_AT = 32
#: Rows and bytes of vectors that a task is given.
TASK_ROWS, TASK_BYTES = 1_000_000, 64 << 20
SKETCH_BITS = 64


@dataclass(frozen=True)
class Hashing:
    """Gaussian projections cut into cells of one width: ``tables`` keys of ``projections`` cells each, and a sign sketch; for vectors of any length.

    With width w, a projection puts two vectors at distance c in one cell with probability
    p(c) = 1 - 2 Phi(-w/c) - 2c/(sqrt(2 pi) w) (1 - exp(-w^2 / 2c^2)); a table finds a pair with p(c)^projections.
    """

    projections: int
    tables: int
    width: float = 2.0
    seed: int = 11

    @staticmethod
    def collision(distance: float, width: float) -> float:
        from math import erf, exp, pi, sqrt

        r = width / distance
        return 1 - 2 * 0.5 * (1 - erf(r / sqrt(2))) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))

    @classmethod
    def for_rows(cls, rows: int, cosine: float, recall: float = 0.995, strangers: float = 2.0, width: float = 2.0) -> Hashing:
        """As many projections as leave about ``strangers`` unrelated (orthogonal) vectors in a bucket, as many tables as find a pair at the threshold with ``recall``."""
        far, near = cls.collision(2**0.5, width), cls.collision((2 - 2 * cosine) ** 0.5, width)
        projections = max(4, int(np.ceil(np.log(max(rows, 2) / strangers) / -np.log(far))))
        return cls(projections, int(np.ceil(np.log(1 - recall) / np.log(1 - near**projections))), width)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A 64-bit key for each row and table."""
        planes, shift, _ = _planes(self, unit.shape[1])
        cells = np.floor((unit @ planes + shift) / self.width).astype(np.int64).view(np.uint64).reshape(len(unit), self.tables, self.projections)
        out = np.zeros(cells.shape[:2], np.uint64)
        for j in range(self.projections):
            out = (out ^ cells[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        """One sign bit for each of 64 directions."""
        bits = (unit @ _planes(self, unit.shape[1])[2] > 0).astype(np.uint8)
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


@lru_cache(maxsize=4)
def _planes(of: Hashing, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(of.seed)
    n = of.tables * of.projections
    return rng.standard_normal((dim, n)), rng.uniform(0, of.width, n), rng.standard_normal((dim, SKETCH_BITS))


def _unit(column) -> np.ndarray:
    """Rows of an Arrow list column, all of one length, at norm 1; scaled first, as squares of very large or small values leave the range of doubles."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sketch_limit(cosine: float) -> int:
    """Sign bits that may differ: six standard deviations over the mean of a pair at the threshold, so that practically no link fails it."""
    p = float(np.arccos(cosine) / np.pi)
    return int(np.ceil(SKETCH_BITS * p + 6 * (SKETCH_BITS * p * (1 - p)) ** 0.5))


def partnered(sketches: np.ndarray, limit: int, sides: np.ndarray | None = None) -> np.ndarray:
    """Which rows have another row within ``limit`` sign bits, of the other side where there are two; rows that have found one are not compared again."""
    found = np.zeros(len(sketches), bool)
    two = sides is not None and sides.any()
    for start in range(0, len(sketches), BLOCK):
        there = sketches[start : start + BLOCK]
        for at in range(0, len(sketches), BLOCK):
            who = np.flatnonzero(~found[at : at + BLOCK]) + at
            if not len(who):
                continue
            near = np.bitwise_count(sketches[who][:, None] ^ there) <= limit
            if two:
                near &= sides[who][:, None] != sides[start : start + BLOCK]
            own = (who >= start) & (who < start + len(there))
            near[np.flatnonzero(own), who[own] - start] = False
            found[who] = near.any(axis=1)
    return found


def linked_pairs(left: np.ndarray, right: np.ndarray | None, table: int, hashing: Hashing, cosine: float, limit: int):
    """Index pairs of one bucket (or of two blocks of it) that link and share no bucket of an earlier table; a block at a time."""
    same = right is None
    right = left if same else right
    for i in range(0, len(left), BLOCK):
        for j in range(i if same else 0, len(right), BLOCK):
            a, b = np.nonzero(left[i : i + BLOCK] @ right[j : j + BLOCK].T >= cosine - 1e-9)
            a, b = a + i, b + j
            if same:
                a, b = a[a < b], b[a < b]
            if not len(a):
                continue
            rows, cols = slice(i, i + BLOCK), slice(j, j + BLOCK)
            sketches = hashing.sketch(left[rows]), hashing.sketch(right[cols])
            keys = (hashing.keys(left[rows])[:, :table], hashing.keys(right[cols])[:, :table]) if table else None
            for at in range(0, len(a), 1 << 18):
                x, y = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
                exact = np.einsum("ij,ij->i", left[x], right[y]) >= cosine
                exact &= np.bitwise_count(sketches[0][x - i] ^ sketches[1][y - j]) <= limit
                x, y = x[exact], y[exact]
                if keys:
                    fresh = ~(keys[0][x - i] == keys[1][y - j]).any(axis=1)
                    x, y = x[fresh], y[fresh]
                yield x, y


def usable(vector: str) -> F.Column:
    """Whether a vector takes part: not null, empty or zero, no null and no non-finite component."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, recall: float = 0.995, strangers: float = 2.0) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Equal vectors (any float type, compared as doubles by 128 bits of hash) are one class and link with each other. Class representatives are hashed
    into buckets, vectors of each length by themselves; members of a bucket without a partner by their sign sketch go no further, the others meet
    with their vectors and every pair is checked by its cosine in double precision. A pair counts in the first table that brings it together, so a
    bucket returns sums and a spanning set of links, never its pairs. Buckets over SPLIT members are cut into blocks before anything is compared,
    and tasks share the pairs of blocks.

    n_links: rows linked directly; component_id: smallest id reachable; kept: the id is its component's. Vectors that :func:`usable` rejects link with
    nothing. Null ids keep their row: their component is named by another member, or is null and not kept. Repeated ids count as rows of their own;
    all with their component's id are kept. Other columns are not looked at.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").alias("id_"), F.when(usable(f"`{vector}`"), F.col(f"`{vector}`").cast("array<double>")).alias("vector_"))
    pair = [F.when(F.col("vector_").isNotNull(), F.xxhash64(F.lit(i), "vector_")).alias(f"h{i}_") for i in (0, 1)]
    keyed = rows.select("id_", "vector_", *pair)
    grouped = keyed.where("h0_ IS NOT NULL").groupBy("h0_", "h1_").agg(F.count("*").alias("size_"), F.min("id_").alias("low_"), F.first("vector_").alias("vector_"))
    classes = cut_lineage(grouped.withColumn("class_", F.monotonically_increasing_id()).withColumn("dim_", F.size("vector_")))
    stock = classes.agg(F.count("*").alias("rows"), F.sum("dim_").alias("numbers")).first()
    hashing = Hashing.for_rows(stock["rows"], cosine, recall, strangers)
    limit = sketch_limit(cosine)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-stock["rows"] * hashing.tables // TASK_ROWS))
    bucket = ["dim_", "table_", "key_"]

    def scatter(batches):
        import pyarrow as pa

        for batch in batches:
            lengths = batch.column(2).to_numpy()
            for dim in np.unique(lengths):
                same = batch if (lengths == dim).all() else batch.filter(pa.array(lengths == dim))
                for start in range(0, same.num_rows, 4096):
                    part = same.slice(start, 4096)
                    unit = _unit(part.column(1))
                    keys, own = hashing.keys(unit).view(np.int64), part.column(0).to_numpy(zero_copy_only=False)
                    n, t = keys.shape
                    sketch = hashing.sketch(unit).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n * t, dim, np.int32)), pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(keys.ravel()), pa.array(np.repeat(own, t)), pa.array(np.repeat(sketch, t))], names=[*bucket, "class_", "sketch_"])

    def screen(batches):
        got = _in_runs(batches, [*names, "class_"], names)
        if got is None:
            return
        table, bounds = got
        sketch = table.column("sketch_").to_numpy().view(np.uint64)
        sides = table.column("side_").to_numpy()
        stay = np.zeros(table.num_rows, bool)
        for a, b in bounds:
            if b - a > 1:
                stay[a:b] = partnered(sketch[a:b], limit, sides[a:b])
        yield from table.filter(stay).select([*bucket, "class_"]).combine_chunks().to_batches()

    kept = "dim_ int, table_ int, key_ long, class_ long"
    names = [*bucket, "left_", "right_"]
    hashed = lambda of: of.select("class_", "vector_", "dim_").mapInArrow(scatter, f"{kept}, sketch_ long")
    large = _large(hashed(classes.where(F.pmod(F.xxhash64("class_"), F.lit(LOOKED_AT)) == 0)), bucket, LOOKED_AT)
    partners = _blocks(hashed(classes), bucket, large).repartition(parts, *names).mapInArrow(screen, kept)
    screened = cut_lineage(partners if large is None else partners.distinct())
    spread = _blocks(screened, bucket, _large(screened, bucket))
    size = spread.agg(F.count("*").alias("rows"), F.sum("dim_").alias("numbers")).first()
    met = spread.join(classes.select("class_", "size_", "vector_"), "class_")

    def verify(batches):
        import pyarrow as pa

        got = _in_runs(batches, [*names, "class_"], names)
        if got is None:
            return
        found, bounds = got
        vectors = found.column("vector_").chunk(0)
        cols = {n: found.column(n).to_numpy() for n in ("table_", "class_", "left_", "right_", "side_", "size_")}
        for a, b in bounds:
            if b - a < 2:
                continue
            unit = _unit(vectors.slice(a, b - a))
            own, size, table = cols["class_"][a:b], cols["size_"][a:b], int(cols["table_"][a])
            links, label = np.zeros(b - a, np.int64), np.arange(b - a)
            if cols["left_"][a] == cols["right_"][a]:
                x_of = y_of = np.arange(b - a)
                pairs = linked_pairs(unit, None, table, hashing, cosine, limit)
            else:
                first = cols["side_"][a:b] == 0
                x_of, y_of = np.flatnonzero(first), np.flatnonzero(~first)
                pairs = linked_pairs(unit[x_of], unit[y_of], table, hashing, cosine, limit)
            for x, y in pairs:
                x, y = x_of[x], y_of[y]
                np.add.at(links, x, size[y])
                np.add.at(links, y, size[x])
                _join(label, x, y)
            who = np.flatnonzero(links)
            if len(who):
                yield pa.RecordBatch.from_arrays([pa.array(own[who]), pa.array(own[label[who]]), pa.array(links[who])], names=["u", "v", "links"])

    tasks = max(least, -(-(size["numbers"] or 0) * 8 // TASK_BYTES), -(-size["rows"] // TASK_ROWS))
    found = cut_lineage(met.repartition(tasks, *names).mapInArrow(verify, "u long, v long, links long"))
    linked = found.groupBy(F.col("u").alias("class_")).agg(F.sum("links").alias("links_"))
    component = connected_components(found.select("u", "v")).withColumnRenamed("node", "class_")
    rooted = cut_lineage(classes.select("class_", "h0_", "h1_", "size_", "low_").join(linked, "class_", "left").join(component, "class_", "left").withColumn("root_", F.coalesce("component", "class_")))
    lowest = cut_lineage(rooted.groupBy("root_").agg(F.min("low_").alias("component_id")))
    named = cut_lineage(rooted.join(lowest, "root_").select("h0_", "h1_", (F.col("size_") - 1 + F.coalesce("links_", F.lit(0))).alias("n_links"), "component_id"))
    joined = keyed.select("id_", "h0_", "h1_").join(named, ["h0_", "h1_"], "left")
    own = F.when(F.col("h0_").isNull(), F.col("id_")).otherwise(F.col("component_id"))
    return joined.select(F.col("id_").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id_") == own, F.lit(False)).alias("kept"))


def _large(members: DataFrame, bucket: list[str], each: int = 1) -> DataFrame | None:
    """The buckets with over SPLIT members, each row standing for ``each`` of these, and their number n_; None if there are none."""
    large = cut_lineage(members.groupBy(*bucket).agg((F.count("*") * each).alias("n_")).where(F.col("n_") > SPLIT))
    return None if large.isEmpty() else large


def _blocks(members: DataFrame, bucket: list[str], large: DataFrame | None) -> DataFrame:
    """``members`` with left_, right_ and side_: the pair of blocks that they are to be compared in, and which of the two they are.

    A bucket of ``large`` has one block for each SPLIT members, and a member's block is drawn by its class; block i meets each block j >= i, so a
    member goes to as many pairs as there are blocks.
    """
    if large is None:
        return members.withColumns({"left_": F.lit(0), "right_": F.lit(0), "side_": F.lit(0)})
    blocks = F.ceil(F.col("n_") / SPLIT).cast("int")
    cut = members.join(large, bucket, "left")
    own = F.pmod(F.xxhash64("class_"), blocks).cast("int")
    parts = cut.withColumn("own_", F.coalesce(own, F.lit(0))).withColumn("other_", F.explode(F.sequence(F.lit(0), F.coalesce(blocks, F.lit(1)) - 1)))
    placed = parts.withColumns({"left_": F.least("own_", "other_"), "right_": F.greatest("own_", "other_"), "side_": (F.col("own_") > F.col("other_")).cast("int")})
    return placed.drop("n_", "own_", "other_")


def _in_runs(batches, order: list[str], same: list[str]):
    """The task's rows as one sorted Arrow table, and where the runs of equal ``same`` begin and end; None without rows."""
    import pyarrow as pa

    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return None
    table = pa.Table.from_batches(batches).sort_by([(c, "ascending") for c in order]).combine_chunks()
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in same:
        x = table.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new)
    return table, list(zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]))


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i] in place; a class is labelled by its smallest index."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not (label[label] == label).all():
            label[:] = label[label]
