"""The Katz model against plain dictionaries, and that its probabilities sum to one."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import product

import pytest

from barflow.llm import katz


class Plain:
    """Katz backoff of one order over dictionaries of word tuples."""

    def __init__(self, texts: list[list[str]], order: int) -> None:
        self.order, self.counts = order, [Counter() for _ in range(order)]
        for words in texts:
            padded = ["<s>"] * (order - 1) + words
            for i in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    self.counts[k - 1][tuple(padded[i - k + 1 : i + 1])] += 1
        self.factor = []
        for counts in self.counts:
            n = Counter(counts.values())
            common = 6 * n[6] / n[1] if n[1] else 1
            d = {}
            for c in range(1, 6):
                f = ((c + 1) * n[c + 1] / (c * n[c]) - common) / (1 - common) if n[c] and common < 1 else 1
                d[c] = f if 0 < f < 1 else 1
            self.factor.append(d)
        self.followers = [{} for _ in range(order)]
        for k in range(2, order + 1):
            for gram in self.counts[k - 1]:
                self.followers[k - 1].setdefault(gram[:-1], []).append(gram)

    def kept(self, k: int, c: int) -> float:
        return c * self.factor[k - 1].get(c, 1)

    def p(self, gram: tuple) -> float:
        k = len(gram)
        counts = self.counts[k - 1]
        if k == 1:
            freed = sum(c - self.kept(1, c) for c in counts.values())
            return (self.kept(1, counts[gram]) if gram in counts else freed or 1) / (sum(counts.values()) + (not freed))
        after = self.followers[k - 1].get(gram[:-1])
        if not after:
            return self.p(gram[1:])
        follows = sum(counts[g] for g in after)
        freed = sum(counts[g] - self.kept(k, counts[g]) for g in after)
        whole = follows + (not freed > 0)
        if gram in counts:
            return self.kept(k, counts[gram]) / whole
        return (freed or 1) / whole / (1 - sum(self.p(g[1:]) for g in after)) * self.p(gram[1:])


def words(text: str | None) -> list[str]:
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), " end"]


def made(seed: int, n: int = 60) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    pool = [f"w{int(rng.expovariate(0.15))}" for _ in range(400)]
    return [(i, " ".join(rng.choices(pool, k=rng.randrange(30)))) for i in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_every_text_against_dictionaries(spark, monkeypatch, order):
    monkeypatch.setattr(katz, "RANGE_GRAMS", 64)
    rows = [*made(order), (100, None), (101, ""), (102, "  Éa W1\x0bw2\tUNSEEN w1 "), (102, "w1 w2"), (104, "w1 " * 5000)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3).selectExpr("*", "1 AS ids", "2 AS block", "3 AS WORDS")
    got = katz.score(df, katz.F.col("doc_id") % 4 == 1, order=order).collect()
    plain = Plain([words(t) for i, t in rows if i % 4 != 1], order)
    total = sum(plain.counts[0].values())
    want = []
    for i, text in rows:
        padded, base, logp = ["<s>"] * (order - 1) + words(text), 0.0, 0.0
        for j in range(order - 1, len(padded)):
            base += math.log10((plain.counts[0][(padded[j],)] + 1) / (total + len(plain.counts[0]) + 1))
            logp += math.log10(plain.p(tuple(padded[j - order + 1 : j + 1])))
        known = sum((w,) in plain.counts[0] for w in words(text))
        want.append((i, i % 4 == 1, len(words(text)), known, total, round(base, 6), round(logp, 6)))
    key = lambda r: (r[0], r[2])
    assert sorted([(*r[:5], round(r[5], 6), round(r[6], 6)) for r in map(tuple, got)], key=key) == sorted(want, key=key)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_after_any_history_sum_to_one(spark, order):
    rows = [(i, t) for i, t in made(9, 25)]
    seen = sorted({w for _, t in rows for w in words(t)} - {" end"})
    rng = random.Random(1)
    histories = rng.sample(seen, 6) + ["never"]
    probes, at = [], 1000
    for first, last in product(histories[:3] + ["never"], histories):
        for w in [*seen, "unknown", None]:
            probes.append((at, first, last, w))
            at += 1
    texts = rows + [(at, " ".join(x for x in (a, b, w) if x)) for at, a, b, w in probes] + [(-1 - i, f"{a} {b}") for i, (a, b) in enumerate(product(histories[:3] + ["never"], histories))]
    got = {r["doc_id"]: r for r in katz.score(spark.createDataFrame(texts, "doc_id int, text string"), (katz.F.col("doc_id") >= 1000) | (katz.F.col("doc_id") < 0), order=order).collect()}
    plain = Plain([words(t) for _, t in rows], order)
    sums: Counter = Counter()
    for at, a, b, w in probes:
        begun = ["<s>"] * (order - 1) + [a, b] + ([w] if w else [])
        whole = ["<s>"] * (order - 1) + words(" ".join(x for x in (a, b, w) if x))
        rest = sum(math.log10(plain.p(tuple(whole[j - order + 1 : j + 1]))) for j in range(order - 1, len(whole)) if j != order + 1)
        assert len(begun) <= len(whole)
        sums[a, b] += 10 ** (got[at]["score"] - rest)
    assert all(abs(s - 1) < 1e-9 for s in sums.values()), sums


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    got = katz.score(df, katz.F.lit(True)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got) == [(2, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    assert katz.score(df.limit(0), katz.F.lit(False)).collect() == []


def test_whole_table(spark, sf_dir):
    from barflow.llm.queries import op13_lm_scoring

    got = op13_lm_scoring(spark, sf_dir).toPandas()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = got[got.held_out]
    assert 0 < len(held) < len(got) / 4 and (held.score > held.base_score).mean() > 0.9
    assert (got.train_tokens == got[~got.held_out].n_tokens.sum()).all() and (got[~got.held_out].n_known == got[~got.held_out].n_tokens).all()
