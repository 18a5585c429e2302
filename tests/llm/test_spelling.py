"""Spelling variants against a comparison of all words with all others."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from barflow.llm import spelling


def brute(counts: dict[str, int], ratio: int = 5) -> dict[str, tuple]:
    near = {w: [v for v in counts if w != v and abs(len(v) - len(w)) <= 1 and (v in edits(w))] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None)
    return out


class edits:  # noqa: N801
    """Whether a word is one edit away, by trying all places."""

    def __init__(self, word: str) -> None:
        self.word = word

    def __contains__(self, other: str) -> bool:
        a, b = sorted((self.word, other), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def rows(df) -> dict[str, tuple]:
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_words_of_any_length_against_brute_force(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(260)}
    for length in (63, 64, 65, 66, 300):
        base = "".join(rng.choice("xyz") for _ in range(length))
        words |= {base, base[:5] + base[6:], base[:40] + "q" + base[41:], base + "w", "w" + base, base[:-1] + "u", base[:9] + "qq" + base[9:]}
    counts = {w: rng.choice([1, 2, 9, 50, 300]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("near", spelling.F.lit(1)).withColumn("BACK", spelling.F.lit(1))
    assert rows(spelling.variants(df)) == brute(counts)


def test_no_word_and_single_word(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert rows(spelling.variants(empty)) == {}
    assert rows(spelling.variants(spark.createDataFrame([("alone", 7)], "word string, n long"))) == {"alone": (None, "alone", 7, 0, None)}
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "short WORDSÉ " * 5), (2, "x" * 100_000)], "doc_id int, text string")
    assert {tuple(r) for r in spelling.word_counts(docs).collect()} == {("wordsÉ", 5)}


def test_one_edit():
    assert spelling.one_edit("abc", "abd") and spelling.one_edit("abc", "ab") and spelling.one_edit("abc", "xabc") and spelling.one_edit("aab", "ab")
    assert not spelling.one_edit("abc", "abc") and not spelling.one_edit("abc", "acb") and not spelling.one_edit("abcd", "ab")


def test_whole_table_against_brute_force(spark, sf_dir):
    from barflow.llm.queries import op11_spelling_variants

    counts: Counter[str] = Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert rows(op11_spelling_variants(spark, sf_dir)) == brute(counts)
