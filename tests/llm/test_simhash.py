import random

import pytest
import xxhash
from pyspark.sql import functions as F

from barflow.llm import simhash

SCHEMA = "doc_id long, text string, count string"


def plain_print(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints):
    label = {i: i for i in range(len(prints))}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a b c", "a b c d", "A B c D e F", "x " * 500 + "\x1c y z \x0b q", "É é " * 7])
def test_fingerprint_is_as_defined(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(str(random.Random(3).random()) for _ in range(1000)) + " tail end here"
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 7)
    assert simhash.fingerprint(text) == plain_print(text)


@pytest.mark.parametrize("cut", [1 << 21, 300])
def test_links_join_what_brute_force_joins(spark, monkeypatch, cut):
    rng = random.Random(5)
    prints = []
    for _ in range(12):
        base = rng.getrandbits(64)
        prints += [base]
        for d in (1, 2, 3, 4, 5, 6):
            x = prints[-1]
            for b in rng.sample(range(64), d):
                x ^= 1 << b
            prints.append(x)
    prints += [0, 1, 3, 2**63, 2**64 - 1]
    prints = sorted(set(prints))
    expected = plain_components(prints)
    import numpy as np

    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", cut)
    label = np.arange(len(prints))
    arr = np.array(prints, np.uint64)
    bits = 8
    bucket, who = simhash._prefixes(arr, bits, 2)
    for b in np.unique(bucket):
        own = arr[who[bucket == b]]
        u, v = simhash.spanning_links(np.sort(own), int(b), bits, 4)
        simhash._join(label, np.searchsorted(arr, u), np.searchsorted(arr, v))
    assert label.tolist() == expected


@pytest.mark.parametrize("per_bucket, radius", [(16, 4), (1 << 12, 4), (16, 2)])
def test_families_of_like_top_bits_go_deeper(spark, per_bucket, radius):
    rng = random.Random(per_bucket)
    family = rng.getrandbits(64)
    prints = {family ^ rng.getrandbits(14) for _ in range(60)} | {family ^ (1 << b) ^ (rng.getrandbits(10) << 3) for b in (63, 60, 40, 35)} | {rng.getrandbits(64) for _ in range(60)}
    prints |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in list(prints)}
    prints = sorted(prints)
    signed = [p - (p >> 63 << 64) for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed] + [(None,)], "fingerprint long"), radius=radius, variants_per_bucket=per_bucket).collect()
    label = {p: p for p in signed}
    for _ in signed:
        for r in links:
            label[r.u] = label[r.v] = min(label[r.u], label[r.v])
    groups = {}
    for p in signed:
        groups.setdefault(label[p], set()).add(p)
    expected = {}
    near = {i: [j for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= radius] for i in range(len(prints))}
    seen = {}
    for i in range(len(prints)):
        stack = [i]
        while stack:
            at = stack.pop()
            if seen.setdefault(at, i) == i and at not in expected.setdefault(i, set()):
                expected[i].add(at)
                stack += near[at]
    whole = sorted(sorted(signed[j] for j in g) for i, g in expected.items() if seen[i] == i)
    assert sorted(map(sorted, groups.values())) == whole


def test_other_columns_may_have_any_name(spark):
    rows = [(1, "some words of a text here", "x", 2, "y"), (2, "some words of a text here", "x", 3, "y"), (2, "other things are said in this one", None, 4, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id_ string, print_ long, `a.b` string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]
    assert len(simhash.near_duplicates(df).collect()) == 3


def test_components_with_nulls_ties_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base, "x"), (3, base, None), (9, base + " more", "y"), (7, "quite another text of some words", "z"), (None, base, "n"), (8, None, "e"), (2, "", "e"), (7, "quite another text of some words", "again"), (11, "a " * 30_000, "long"), (None, "lonely text without any id at all", "u")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = [plain_print(r[1]) for r in rows]
    found = plain_components(prints)
    expected = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if found[j] == found[i] and rows[j][0] is not None]
        expected.append((r[0], prints[i] - (prints[i] >> 63 << 64), min(ids, default=None)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, out), key=key) == sorted(expected, key=key)
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "count"]
    got = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert got == [-1, 2, 3, 7, 11]


def test_empty_table_and_empty_result(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.keep_one(none).collect() == []


def test_hex(spark):
    row = spark.createDataFrame([(-1,), (1,)], "x long").select(simhash.as_hex(F.col("x")).alias("h")).collect()
    assert [r.h for r in row] == ["f" * 16, "0" * 15 + "1"]
