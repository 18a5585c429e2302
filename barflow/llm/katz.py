"""LM scoring by a Katz backoff model whose n-gram counts and backoff weights lie in partitioned tables.

Documents become blocks of a few million tokens. A block asks for its distinct n-grams only, in ranges of their hash; the task that has a range sums
what all blocks say of it and answers each block in its own order. So a table's range and a block are the largest things that a task ever holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.cluster import table_folder

#: Tokens of a block, but for a longer document, which is one block; grams of one range of a table.
BLOCK_TOKENS, RANGE_GRAMS = 1 << 20, 1 << 20
#: Counts up to this are discounted, larger ones are taken as they are.
DISCOUNTED = 5
#: No word holds a blank, so these stand for nothing else.
BEGIN, END = (np.uint64(xxhash.xxh64_intdigest(mark)) for mark in (b" begin", b" end"))

BLOCK = "block long, ids array<{kind}>, lengths array<int>, held_out array<boolean>, words binary, tokens binary"
ASKED = "gram_order int, range long, block long, grams binary, said binary"
ANSWERED = "kind string, gram_order int, range long, block long, grams binary, said binary, spectrum array<long>, distinct long, total long"
WEIGHED = "kind string, gram_order int, range long, block long, grams binary, said binary"


def pack(x: np.ndarray) -> bytes:
    """Eight-byte numbers by the place of their bytes, after the number of places that any of them needs."""
    places = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T
    used = next((i for i in range(8, 1, -1) if places[i - 1].any()), 1)
    return bytes([used]) + places[:used].tobytes()


def unpack(data: bytes, kind=np.int64) -> np.ndarray:
    used = data[0]
    places = np.frombuffer(data, np.uint8, offset=1).reshape(used, -1)
    out = np.zeros((places.shape[1], 8), np.uint8)
    out[:, :used] = places.T
    return out.view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def joined(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a history and the word after it."""
    x = history * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def discounts(spectrum: list[int]) -> np.ndarray:
    """Factor of each count from 0 to DISCOUNTED and, last, of all larger ones, from the numbers of n-grams that occur 1, 2, ... DISCOUNTED + 1 times.

    Good-Turing factors as Katz gives them; a count for which they are not defined or not in (0, 1) stays as it is.
    """
    n, k = np.concatenate([[0.0], np.asarray(spectrum, float)]), DISCOUNTED
    out = np.ones(k + 2)
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for c in range(1, k + 1):
        if n[c] and common < 1:
            factor = ((c + 1) * n[c + 1] / (c * n[c]) - common) / (1 - common)
            out[c] = factor if 0 < factor < 1 else 1.0
    return out


@dataclass(frozen=True)
class Totals:
    """What is known of the corpus as a whole: for each order the discounts, and of single tokens their number and that of distinct ones."""

    factors: list[np.ndarray]
    tokens: int
    types: int
    freed: float

    def kept(self, order: int, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * self.factors[order - 1][np.minimum(counts, DISCOUNTED + 1)]

    def single(self, counts: np.ndarray) -> np.ndarray:
        """Probability of single tokens; a token of no count has that of the one unknown word. Where no count is discounted, the unknown counts once."""
        whole = self.tokens + (not self.freed)
        return np.where(counts > 0, self.kept(1, counts), self.freed or 1.0) / whole


class Block:
    """One block's tokens and, for each order, its distinct n-grams in order of their hash, the place of each token's own and the counts it learns from."""

    def __init__(self, row: dict, order: int) -> None:
        self.lengths = np.asarray(row["lengths"], np.int64)
        self.held_out = np.asarray(row["held_out"], bool)
        self.starts = np.cumsum(self.lengths) - self.lengths
        words, tokens = np.frombuffer(row["words"], np.uint64), unpack_small(row["tokens"])
        learnt = np.repeat(~self.held_out, self.lengths)
        by_hash = np.argsort(words)
        place = np.empty(len(words), np.int64)
        place[by_hash] = np.arange(len(words))
        self.grams, self.at = [words[by_hash]], [place[tokens]]
        hashes, marks = words[tokens], BEGIN
        gram = hashes
        for k in range(2, order + 1):
            history = np.roll(gram, 1)
            history[self.starts] = marks
            gram = joined(history, hashes)
            marks = joined(marks[None], BEGIN[None])[0] if k < order else marks
            grams, at = np.unique(gram, return_inverse=True)
            self.grams.append(grams)
            self.at.append(at)
        self.counts = [np.bincount(at[learnt], minlength=len(g)) for at, g in zip(self.at, self.grams)]

    def histories(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct histories of n-grams of ``order``, sorted, that of a text's begin among them, and each token's place there."""
        mark = BEGIN
        for _ in range(order - 2):
            mark = joined(mark[None], BEGIN[None])[0]
        grams, at = self.grams[order - 2], np.roll(self.at[order - 2], 1)
        where = int(np.searchsorted(grams, mark))
        if where == len(grams) or grams[where] != mark:
            grams, at = np.insert(grams, where, mark), at + (at >= where)
        at[self.starts] = where
        return grams, at


def unpack_small(data: bytes) -> np.ndarray:
    """Four-byte numbers stored by the place of their bytes."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _sides(grams: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2^bits ranges of the hash begins in sorted ``grams``, and their end."""
    firsts = (np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(grams, firsts), len(grams))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, text, held_out) to blocks; words are what stands between white space, after A to Z are lower-cased."""
    number, task = count(), TaskContext.get().partitionId()

    def fresh() -> tuple:
        return {b" end": 0}, [], [], [], []

    def made(kind: pa.DataType) -> pa.RecordBatch:
        words = np.fromiter((END if i == 0 else xxhash.xxh64_intdigest(w) for w, i in known.items()), np.uint64, len(known))
        tokens = np.ascontiguousarray(np.concatenate(runs).astype(np.uint32)).view(np.uint8).reshape(-1, 4).T.tobytes()
        cells = [pa.array([(task << 24) + next(number)], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([lengths], pa.list_(pa.int32())), pa.array([out], pa.list_(pa.bool_())), pa.array([words.tobytes()], pa.binary()), pa.array([tokens], pa.binary())]
        return pa.RecordBatch.from_arrays(cells, names=[part.split()[0] for part in BLOCK.split(", ")])

    known, ids, lengths, out, runs = fresh()
    size, kind = 0, None
    for part in parts:
        kind = part.schema.field(0).type
        for one, text, held in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
            words = (text or b"").lower().split()
            run = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint32, len(words))
            runs.append(np.append(run, np.uint32(0)))
            ids.append(one)
            lengths.append(len(words) + 1)
            out.append(held)
            size += len(words) + 1
            if size >= BLOCK_TOKENS:
                yield made(kind)
                known, ids, lengths, out, runs = fresh()
                size = 0
    if size:
        yield made(kind)


def _ask(parts: Iterator[pa.RecordBatch], order: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Each block's distinct n-grams with the times they occur in what is learnt from, by range."""
    for part in parts:
        for row in _rows(part):
            block = Block(row, order)
            for k in range(1, order + 1):
                grams, counts = block.grams[k - 1], block.counts[k - 1]
                sides = _sides(grams, bits)
                full = np.flatnonzero(np.diff(sides))
                for at in range(0, len(full), 64):
                    yield _batch([{"gram_order": k, "range": r, "block": row["block"], "grams": pack_sorted(grams[a:b]), "said": pack(counts[a:b])} for r in full[at : at + 64].tolist() for a, b in [sides[r : r + 2]]], ASKED)


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    """One range of one order: the table of its counts, and for each block what its counts lack and whether another block speaks for the n-gram."""
    order, at = key[0].as_py(), key[1].as_py()
    rows = sorted(table.select(["block", "grams", "said"]).to_pylist(), key=lambda r: r["block"])
    grams, said = [unpack_sorted(r["grams"]) for r in rows], [unpack(r["said"]) for r in rows]
    known, place = np.unique(np.concatenate(grams), return_inverse=True)
    own = np.concatenate(said)
    total = np.bincount(place, own, len(known)).astype(np.int64)
    learnt = np.flatnonzero(own > 0)
    _, first = np.unique(place[learnt], return_index=True)
    other = own > 0
    other[learnt[first]] = False
    code = (total[place] - own) * 2 + other
    out, begun = [], 0
    for row, g in zip(rows, grams):
        out.append({"kind": "answer", "gram_order": order, "range": at, "block": row["block"], "said": pack(code[begun : begun + len(g)])})
        begun += len(g)
    known, total = known[total > 0], total[total > 0]
    spectrum = np.bincount(total[total <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)[1:].tolist()
    out.append({"kind": "table", "gram_order": order, "range": at, "grams": pack_sorted(known), "said": pack(total), "spectrum": spectrum, "distinct": len(known), "total": int(total.sum())})
    return pa.Table.from_batches([_batch(out, ANSWERED)])


def _known(row: dict, order: int) -> tuple[Block, list[np.ndarray], list[np.ndarray]]:
    """A block with the count in the whole corpus of each of its n-grams, and whether it is the one that speaks for it."""
    block = Block(row, order)
    totals, speaks = [], []
    for k in range(1, order + 1):
        code = np.concatenate([unpack(a["said"]) for a in sorted((a for a in row["answers"] if a["gram_order"] == k), key=lambda a: a["range"])])
        totals.append(block.counts[k - 1] + (code >> 1))
        speaks.append((block.counts[k - 1] > 0) & (code & 1 == 0))
    return block, totals, speaks


def _probabilities(block: Block, totals: list[np.ndarray], corpus: Totals, weights: dict[int, np.ndarray], order: int) -> np.ndarray:
    """Probability of each token after its history of ``order`` - 1 tokens: of the n-gram where it is known, else the weight of its history times that of the shorter one."""
    p = corpus.single(totals[0])[block.at[0]]
    for k in range(2, order + 1):
        weight, follows = weights[k]
        _, history = block.histories(k)
        counts = totals[k - 1][block.at[k - 1]]
        p = np.where(counts > 0, corpus.kept(k, counts) / np.maximum(follows[history], 1), weight[history] * p)
    return p


def _weights(row: dict, block: Block, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For n-grams of each order up to ``order``: backoff weight of each history of the block, and what its counts are divided by."""
    out = {}
    for k in range(2, order + 1):
        parts = [unpack(a["said"], np.float64).reshape(2, -1) for a in sorted((a for a in row["weights"] if a["gram_order"] == k), key=lambda a: a["range"])]
        out[k] = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    return out


def _ask_weights(parts: Iterator[pa.RecordBatch], order: int, corpus: Totals, bits: int) -> Iterator[pa.RecordBatch]:
    """For each history of n-grams of ``order``: over the n-grams that a block speaks for, their counts, what discounting takes off, and the lower probability of their last words."""
    for part in parts:
        for row in _rows(part):
            block, totals, speaks = _known(row, order)
            lower = _probabilities(block, totals, corpus, _weights(row, block, order - 1), order - 1)
            histories, at = block.histories(order)
            first = np.full(len(block.grams[order - 1]), -1, np.int64)
            first[block.at[order - 1]] = np.arange(len(at))
            spoken = np.flatnonzero(speaks[order - 1])
            counts, token = totals[order - 1][spoken], first[spoken]
            sums = [np.bincount(at[token], w, len(histories)) for w in (counts, counts - corpus.kept(order, counts), lower[token])]
            sides = _sides(histories, bits)
            full = np.flatnonzero(np.diff(sides))
            for i in range(0, len(full), 64):
                yield _batch([{"gram_order": order, "range": r, "block": row["block"], "grams": pack_sorted(histories[a:b]), "said": pack(np.concatenate([s[a:b] for s in sums]))} for r in full[i : i + 64].tolist() for a, b in [sides[r : r + 2]]], ASKED)


def _weigh(key: tuple, table: pa.Table) -> pa.Table:
    """One range of histories: the weight that makes the probabilities after each sum to one.

    Counts are divided by the number of times that the history occurs, or one more where no count after it is discounted, so that there is always something left.
    A history that was never learnt has weight 1.
    """
    order, at = key[0].as_py(), key[1].as_py()
    rows = sorted(table.select(["block", "grams", "said"]).to_pylist(), key=lambda r: r["block"])
    grams, sums = [unpack_sorted(r["grams"]) for r in rows], [unpack(r["said"], np.float64).reshape(3, -1) for r in rows]
    known, place = np.unique(np.concatenate(grams), return_inverse=True)
    follows, freed, lower = (np.bincount(place, np.concatenate([s[i] for s in sums]), len(known)) for i in range(3))
    whole = follows + (freed <= 0)
    weight = np.where(follows > 0, np.where(freed > 0, freed, 1.0) / whole / np.maximum(1.0 - lower, 1e-300), 1.0)
    out, begun = [], 0
    for row, g in zip(rows, grams):
        of = place[begun : begun + len(g)]
        out.append({"kind": "answer", "gram_order": order, "range": at, "block": row["block"], "said": pack(np.concatenate([weight[of], whole[of]]))})
        begun += len(g)
    have = follows > 0
    out.append({"kind": "table", "gram_order": order, "range": at, "grams": pack_sorted(known[have]), "said": pack(np.concatenate([weight[have], whole[have]]))})
    return pa.Table.from_batches([_batch(out, WEIGHED)])


def _score(parts: Iterator[pa.RecordBatch], order: int, corpus: Totals, id_col: str) -> Iterator[pa.RecordBatch]:
    for part in parts:
        kind = part.schema.field("ids").type.value_type
        for row in _rows(part):
            block, totals, _ = _known(row, order)
            p = _probabilities(block, totals, corpus, _weights(row, block, order), order)
            counts = totals[0][block.at[0]]
            base = np.log10((counts + 1) / (corpus.tokens + corpus.types + 1))
            sums = [np.add.reduceat(x, block.starts) for x in ((counts > 0).astype(np.int64), base, np.log10(p))]
            cells = [pa.array(row["ids"], kind), pa.array(block.held_out), pa.array(block.lengths), pa.array(sums[0]), pa.array(np.full(len(block.lengths), corpus.tokens)), pa.array(sums[1]), pa.array(sums[2])]
            yield pa.RecordBatch.from_arrays(cells, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(df: DataFrame, held_out: F.Column, order: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row, by a model learnt from the rows that are not ``held_out``.

    Tokens are words between white space, A to Z lower-cased, and one end. base_score is add-one over single tokens, score the base-10 logarithm of the
    probability of all tokens under the Katz model of ``order``, whose histories begin with begin marks. All words that were not learnt are one unknown
    word. Null texts are empty: they have an end alone. Rows with equal or null ids count each; a null ``held_out`` counts as false. With nothing to
    learn from, the unknown word has probability 1. An empty table gives no row.

    The tables lie in the shared folder, one for blocks, dealt into buckets so that answers come to them, one for counts and one for weights, partitioned
    by kind and order. Words and n-grams are known by 64 bits of hash: among n distinct ones about n^2 / 2^65 pairs are taken for one, and their
    counts added. A document is never cut, so the longest one bounds a block.
    """
    spark, folder = df.sparkSession, table_folder(df.sparkSession, "katz")
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{text}`").alias("text_"), F.coalesce(held_out, F.lit(False)).alias("held_out_"))
    blocks = _dealt(rows.mapInArrow(_blocks, BLOCK.format(kind=kind)), f"{folder}/blocks")
    asked_of = spark.read.schema(blocks.schema).parquet(f"{folder}/blocks")
    size = asked_of.agg(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0))).first()[0]
    bits = max(0, int(np.ceil(np.log2(max(1.0, size / RANGE_GRAMS)))))

    asked = asked_of.mapInArrow(partial(_ask, order=order, bits=bits), ASKED)
    _stored(asked.groupBy("gram_order", "range").applyInArrow(_merge, ANSWERED), f"{folder}/counts", ANSWERED)
    counts = spark.read.schema(ANSWERED).parquet(f"{folder}/counts")
    found = {r["gram_order"]: r for r in counts.where("kind = 'table'").groupBy("gram_order").agg(F.sum("distinct").alias("distinct"), F.sum("total").alias("total"), *[F.sum(F.col("spectrum")[i]).alias(f"n{i}") for i in range(DISCOUNTED + 1)]).collect()}
    spectra = [[(found[k][f"n{i}"] or 0) if k in found else 0 for i in range(DISCOUNTED + 1)] for k in range(1, order + 1)]
    factors = [discounts(s) for s in spectra]
    freed = float(sum((1 - factors[0][c]) * c * spectra[0][c - 1] for c in range(1, DISCOUNTED + 1)))
    corpus = Totals(factors, *((found[1]["total"] or 0, found[1]["distinct"] or 0) if found else (0, 0)), freed)

    known = _beside(blocks, counts, "answers").withColumn("weights", F.array().cast("array<struct<gram_order:int,range:long,said:binary>>"))
    for k in range(2, order + 1):
        sums = known.mapInArrow(partial(_ask_weights, order=k, corpus=corpus, bits=bits), ASKED)
        _stored(sums.groupBy("gram_order", "range").applyInArrow(_weigh, WEIGHED), f"{folder}/weights{k}", WEIGHED)
        found = spark.read.schema(WEIGHED).parquet(f"{folder}/weights{k}")
        known = _beside(known, found, "more").withColumn("weights", F.concat("weights", "more")).drop("more")
    return known.mapInArrow(partial(_score, order=order, corpus=corpus, id_col=id_col), f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _dealt(blocks: DataFrame, path: str) -> DataFrame:
    """Write blocks in buckets, as many as a join has partitions, and read them so that a join finds them where they lie."""
    spark, name = blocks.sparkSession, path.rsplit("/", 2)[1].replace("-", "_")
    blocks.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return table


def _stored(df: DataFrame, path: str, schema: str) -> None:
    df.write.partitionBy("kind", "gram_order").option("compression", "zstd").parquet(path)


def _beside(blocks: DataFrame, tables: DataFrame, name: str) -> DataFrame:
    """Blocks with their answers, which are as many as the block's own n-grams."""
    answers = tables.where("kind = 'answer'").groupBy("block").agg(F.collect_list(F.struct("gram_order", "range", "said")).alias(name))
    return blocks.join(answers.hint("shuffle_hash"), "block")
