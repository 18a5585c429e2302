"""Spelling variant grouping: words within one edit are found by walking tries of all words level by level, as joins with a table of edges."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.cluster import cut_lineage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words in a task's table before it is handed on.
FLUSH = 500_000
#: Tries hold words of up to so many code points; longer ones meet by the hashes of what is left without a letter.
TRIE_LENGTH = 64

def word_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, damage: int | None = None) -> DataFrame:
    """(word, n): lower-cased runs of letters of at least ``least_length`` code points that occur ``least_count`` times or more.

    Only A to Z is lower-cased. With ``damage``, a run whose crc32 of ``<id>:<run>`` that number divides loses the code point at crc32 % length. Null
    texts have no runs; a null id counts as an empty one. Each task sums its own words before they are shuffled.
    """

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for part in parts:
            for one, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if not body:
                    continue
                runs = Counter(RUN.findall(body.encode().lower().decode()))
                start = zlib.crc32(f"{'' if one is None else one}:".encode())
                for run, n in runs.items():
                    if len(run) < least_length:
                        continue
                    if damage:
                        h = zlib.crc32(run.encode(), start)
                        if h % damage == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least_length:
                                continue
                    total[run] += n
                if len(total) >= FLUSH:
                    yield _batch(total)
                    total.clear()
        if total:
            yield _batch(total)

    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id_"), F.col(f"`{text}`").alias("text_")).where("text_ IS NOT NULL")
    partial = rows.mapInArrow(counted, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _batch(total: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])


def _node(string: str, length) -> F.Column:
    """The trie node of a prefix; words and reversed words have tries of their own."""
    return F.xxhash64("back", F.substring(string, F.lit(1), length))


def _letter(string, at) -> F.Column:
    """The code point at a position counted from 0; empty past the end."""
    return F.substring(string, at + 1, F.lit(1))


def edges(words: DataFrame) -> DataFrame:
    """(depth, node, nexts) of the tries of ``words`` (word, back), from half the length of each word on.

    ``nexts`` has each letter that goes on from the node with the letters that go on from there, and an empty letter where a word ends, so that a walk sees a
    dead end one level ahead. A node has no more letters than the alphabet, so a row's size is bounded.
    """
    at = words.select("word", "back", F.explode(F.sequence(_half("word"), F.length("word"))).alias("depth"))
    steps = at.select("depth", _node("word", F.col("depth")).alias("node"), _letter("word", F.col("depth")).alias("letter"), _letter("word", F.col("depth") + 1).alias("then"))
    pairs = steps.groupBy("depth", "node", "letter").agg(F.collect_set("then").alias("thens"))
    return pairs.groupBy("depth", "node").agg(F.map_from_entries(F.collect_list(F.struct("letter", "thens"))).alias("nexts"))


def _half(word: str) -> F.Column:
    return F.floor(F.length(word) / 2).cast("int")


def walk(words: DataFrame) -> DataFrame:
    """Pairs (word, near) of ``words`` (word) in which ``near`` has one letter of the word replaced or left out, by frontiers that go down two tries.

    A state is (word, near, edits) at a level: ``near`` is the word after its edit, and its first ``level`` letters are a path of the trie. Each level is one join
    of the states with the edges of that depth. An unedited prefix is a path by itself, so states begin at their edit: edits in the second half of a
    word are made in the trie of words, those in the first half in the trie of reversed words, where so deep a node has few letters to replace by.
    """
    both = cut_lineage(words.select("word", F.lit(False).alias("back")).unionByName(words.select(F.reverse("word").alias("word"), F.lit(True).alias("back"))))
    table = cut_lineage(edges(both))
    least, most = both.agg(F.min(_half("word")), F.max(F.length("word"))).first()
    none = F.array().cast("array<string>")
    frontier = both.select("back", "word", F.col("word").alias("near"), F.lit(1).alias("edits")).limit(0)
    found = frontier.select("back", "word", "near")
    for level in range(least or 0, most or 0):
        start = both.where((_half("word") <= level) & (F.length("word") > level)).select("back", "word", F.col("word").alias("near"), F.lit(0).alias("edits"))
        states = frontier.unionByName(start).withColumn("node", _node("near", F.lit(level)))
        met = states.join(table.where(F.col("depth") == level).select("node", "nexts"), "node")
        before, after = F.substring("near", 1, level), F.substring(F.col("near"), F.lit(level + 2), F.length("near"))
        goes_on = lambda letter, then: F.coalesce(F.array_contains(F.try_element_at("nexts", letter), then), F.lit(False))
        letter = [_letter("near", F.lit(level + k)) for k in range(3)]
        cut = F.when(goes_on(letter[1], letter[2]), F.array(F.concat(before, after))).otherwise(none)
        others = F.filter(F.map_keys("nexts"), lambda c: (c != letter[0]) & (c != "") & goes_on(c, letter[1]))
        edited = F.concat(cut, F.transform(others, lambda c: F.concat(before, c, after)))
        kept = F.when(goes_on(letter[0], letter[1]), F.array("near")).otherwise(none)
        moved = cut_lineage(met.select("back", "word", F.explode(F.when(F.col("edits") == 0, edited).otherwise(kept)).alias("near")))
        ended = F.length("near") <= level + 1
        found = found.unionByName(moved.where(ended))
        frontier = moved.where(~ended).withColumn("edits", F.lit(1))
    return found.select(*[F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)).alias(c) for c in ("word", "near")])


def _left_out(word: str) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of a word and then of what is left of it without each of its letters."""
    letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(letters) - 1, 0x9E3779B97F4A7C15, np.uint64)]))[::-1]
    whole, short = np.cumsum(letters * powers), np.cumsum(letters[:-1] * powers[1:])
    before = np.concatenate([[np.uint64(0)], short])
    return np.concatenate([whole[-1:], before + whole[-1] - whole]).view(np.int64)


def one_edit(a: str, b: str) -> bool:
    """Whether two texts differ by exactly one inserted, deleted or replaced code point."""
    if len(a) < len(b):
        a, b = b, a
    low, high = 0, len(b)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return len(a) - len(b) <= 1 and a != b and a[low + 1 :] == b[low + (len(a) == len(b)) :]


def leap(words: DataFrame) -> DataFrame:
    """Pairs (word, near) as from :func:`walk` for words too long to walk: one row for each left-out letter, hashes instead of texts, and a check of each pair."""

    @F.pandas_udf("array<long>")
    def left_out(texts: pd.Series) -> pd.Series:
        return texts.map(_left_out)

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one_edit(x, y) for x, y in zip(a, b, strict=True)])

    named = cut_lineage(words.select("word", F.xxhash64("word").alias("id")))
    marks = cut_lineage(named.select("id", F.posexplode(left_out("word")).alias("at", "mark")))
    left, right = marks.where("at > 0"), marks.select(F.col("id").alias("near_id"), F.col("at").alias("near_at"), "mark")
    pairs = left.join(right, "mark").where("id <> near_id AND near_at IN (0, at)").select("id", "near_id").distinct()
    pairs = pairs.join(named, "id").join(named.select(F.col("id").alias("near_id"), F.col("word").alias("near")), "near_id")
    return pairs.where(near("word", "near")).select("word", "near")


def near_pairs(words: DataFrame) -> DataFrame:
    """Every ordered pair (word, near) of distinct ``words`` that differ by exactly one inserted, deleted or replaced code point."""
    half = walk(words.where(F.length("word") <= TRIE_LENGTH)).unionByName(leap(words.where(F.length("word") >= TRIE_LENGTH)))
    half = half.where("word <> near")
    return half.unionByName(half.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def variants(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``counts`` (word, n), whose words are distinct.

    A word's form is its near word of largest n, the least in code-point order among equals, if that n is at least ``ratio`` times the word's own; else null.
    The root follows forms to the last one, by pointers that double their reach each round. Near words come from :func:`near_pairs`; prefixes are
    nodes by their hash, so a pair counts only if both its ends are words and one edit apart.
    """
    counts = cut_lineage(counts.select("word", "n"))
    pairs = near_pairs(counts.select("word")).join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    pairs = pairs.where((F.length("word") > TRIE_LENGTH) | (F.levenshtein("word", "near") == 1))
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    table = counts.join(best, "word", "left")
    big = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    table = cut_lineage(table.select("word", F.when(big, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(big, -F.col("best.less")).alias("form_n")))
    hops = cut_lineage(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("last"))
        joined = cut_lineage(hops.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")))
        if not joined.where("moved").limit(1).count():
            break
        hops = joined.select("word", "root")
    return table.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
