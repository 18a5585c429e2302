"""Mixing, URL rules, vectors and components against brute-force versions."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.llm import mixing, queries, url_rules, vector_lsh
from barflow.llm.cluster import connected_components

DOCS = "doc_id long, text string, lang string, source string, tokens string"


def plain_budget(tree, budget, weights, epochs, path=()):
    """Recursive water-filling over nested dicts whose leaves are token numbers."""
    if not isinstance(tree, dict):
        return {path: int(budget + 1e-6)}
    hold = lambda t: epochs * t if not isinstance(t, dict) else sum(map(hold, t.values()))
    caps = {k: hold(v) for k, v in tree.items()}
    given = dict.fromkeys(tree, 0.0)
    open_ = {k for k in tree if weights.get((*path, k), 1) > 0}
    left = min(budget, sum(caps[k] for k in open_))
    while open_ and left > 1e-9:
        total = sum(weights.get((*path, k), 1) for k in open_)
        level = left / total
        full = {k for k in open_ if caps[k] <= level * weights.get((*path, k), 1) + 1e-9}
        if not full:
            for k in open_:
                given[k] = level * weights.get((*path, k), 1)
            break
        for k in full:
            given[k] = caps[k]
            left -= caps[k]
        open_ -= full
    out = {}
    for k, v in tree.items():
        out |= plain_budget(v, given[k], weights, epochs, (*path, k))
    return out


@pytest.mark.parametrize("total", [0, 10, 300, 1000, 2500, 100_000])
def test_budgets(spark, total):
    tree = {"a": {"en": {"s": 100, "t": 7}, "fr": {"s": 50}}, "b": {"en": {"u": 400}}, "c": {"de": {"v": 1, "w": 30}}}
    weights = {("a",): 5, ("c",): 2, ("a", "fr"): 3, ("c", "de", "v"): 0, ("a", "en", "t"): 4}
    rows = [(d, l, s, n) for d, x in tree.items() for l, y in x.items() for s, n in y.items()]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, available long")
    got = {(r.domain, r.lang, r.source): r.quota for r in mixing.budgets(leaves, total, weights, 2).collect()}
    expected = plain_budget(tree, total, weights, 2)
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) <= 1 for k in got)


def plain_mix(spark, rows, domain_of, weights, total, epochs, seed):
    import hashlib

    tree, docs = {}, {}
    for i, text, lang, source, _ in rows:
        n = len((text or "").encode().split())
        tree.setdefault(domain_of(source), {}).setdefault(lang, {}).setdefault(source, 0)
        tree[domain_of(source)][lang][source] += n
        docs.setdefault((domain_of(source), lang, source), []).append((i, n))
    quotas = plain_budget(tree, total, weights, epochs)
    out = []
    for leaf, own in docs.items():
        have, quota = sum(n for _, n in own), quotas[leaf]
        full = min(quota // have, epochs) if have else 0
        for e in range(full):
            out += [(i, *leaf, n, e) for i, n in own]
        left = quota - full * have
        if full < epochs and left > 0:
            place = lambda d: int(hashlib.md5(f"{seed}-{full}-{'null' if d[0] is None else d[0]}".encode()).hexdigest()[:15], 16)
            for i, n in sorted(own, key=lambda d: (place(d), d[0] or 0, d[1])):
                if n > left:
                    break
                left -= n
                out.append((i, *leaf, n, full))
    return out


@pytest.mark.parametrize("total", [50, 900, 4000])
def test_mix_equals_brute_force(spark, total, monkeypatch):
    rng = random.Random(total)
    rows = [(None if i % 31 == 0 else i // 2 * 2, " ".join("w" for _ in range(rng.randrange(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["p", "q", "r"]), "x") for i in range(200)]
    rows += [(1001, None, "en", "p", None), (1003, "", "xx", "only empty", None)]
    domain_of = lambda s: "odd" if s == "q" else "even"
    weights = {("odd",): 3, ("even", "en"): 5, ("even", "en", "r"): 2}
    df = spark.createDataFrame(rows, DOCS)
    domain = F.when(F.col("source") == "q", "odd").otherwise("even")
    out = mixing.mix(df, domain, weights, total=total, max_epochs=3, seed=5)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    expected = sorted(plain_mix(spark, rows, domain_of, weights, total, 3, 5), key=key)
    assert sorted((tuple(r) for r in out.collect()), key=key) == expected
    whole = mixing.mix(df, domain, weights, total=total, max_epochs=3, seed=5, keep_columns=True)
    assert whole.columns == df.columns
    assert sorted((r.doc_id for r in whole.collect()), key=lambda x: (x is None, x or 0)) == sorted((r[0] for r in expected), key=lambda x: (x is None, x or 0))


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS), F.lit("d"), {}).collect() == []


def test_mix_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = con.execute(f"SELECT doc_id, domain, lang, source, tokens, epoch FROM ({queries.ORACLES['op1_source_mixing']})").fetchall()
    assert sorted(map(tuple, queries.op1_source_mixing(spark, sf_dir).collect())) == sorted(expected)


# --- URL rules ------------------------------------------------------------------------------------

URLS = {
    None: ("", "", None), "": ("", "", None), "no scheme/en/": ("", "", None), "http://A.Example.COM/en/1?x=/#y": ("a.example.com", "/en/1", "example.com/en/"),
    "https://www.example.com/en/2": ("www.example.com", "/en/2", "www.example.com/en/"), "https://x.www.example.com/en/2": ("x.www.example.com", "/en/2", "www.example.com/en/"),
    "https://wwww.example.com/fr": ("wwww.example.com", "/fr", "com/"), "http://badexample.com/en/": ("badexample.com", "/en/", "com/"), "http://example.com": ("example.com", "", None),
    "http://example.com?/en/": ("example.com", "", None), "http://b.net/es/z": ("b.net", "/es/z", "net/es/"), "http://b.net/ES/z": ("b.net", "/ES/z", None), "x://É.net/fr/": ("É.net", "/fr/", "net/fr/"),
    "ftp://h.org/a://b/c": ("h.org", "/a://b/c", None), "://net/fr/": ("net", "/fr/", "net/fr/"), "http://c.net#/es/": ("c.net", "", None),
}


def test_urls_and_rules(spark):
    rows = [(i, u, "mine") for i, u in enumerate(URLS)] * 2
    out = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), queries.URL_RULES)
    got = out.collect()
    assert len(got) == len(rows)
    verdict = {(h + p): v for v, h, p in queries.URL_RULES}
    for r in got:
        host, path, rule = URLS[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == verdict[rule]
        assert r.verdict in ("allow", "block")
    empty = url_rules.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES)
    assert empty.collect() == [] and set(empty.columns) == {"page_id", "url", "host", "path", "rule", "verdict"}


def test_mined_rules_match_as_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        tokens = {rng.choice("abc"), rng.choice("defg"), rng.choice("hij"), "k"}
        rows.append((sorted(tokens), bool({"a", "d"} <= tokens or "j" in tokens and rng.random() < 0.95)))
    mined = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.02, 0.9)
    rules = [(set(r["items"]), r.confidence, r.support) for r in mined.collect()]
    assert any(r[0] == {"a", "d"} for r in rules) and any(r[0] == {"j"} for r in rules)
    for items, confidence, _ in rules:
        with_items = [b for t, b in rows if items <= set(t)]
        assert np.mean(with_items) == pytest.approx(confidence) and confidence >= 0.9
        assert not any(less < items and sure >= confidence for less, sure, _ in rules)
    urls = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "url_ long, tokens array<string>")
    got = {r.url_: r.confidence for r in url_rules.match(urls, mined, "url_").collect()}
    expected = {i: max(c for items, c, _ in rules if items <= set(t)) for i, (t, _) in enumerate(rows) if any(items <= set(t) for items, _, _ in rules)}
    assert got == expected


def plain_rules(rows, support, confidence):
    """All rules by trying every frequent set of items: tokens of the same rows are one item; without those that hold a rule as confident."""
    where = {}
    for i, (tokens, _) in enumerate(rows):
        for t in set(tokens or []) - {None}:
            where.setdefault(t, set()).add(i)
    groups = {}
    for t, at in where.items():
        groups.setdefault(frozenset(at), []).append(t)
    hit = {i for i, (_, b) in enumerate(rows) if b}
    items, sets, out = sorted(groups, key=lambda g: min(groups[g])), [((), frozenset(range(len(rows))))], []
    while sets:
        sets = [((*parts, g), at & g) for parts, at in sets for g in items[items.index(parts[-1]) + 1 if parts else 0 :] if len(at & g & hit) >= max(1, support * len(rows))]
        found = [(parts, len(at & hit) / len(at), len(at & hit) / len(rows)) for parts, at in sets if len(at & hit) / len(at) >= confidence]
        out += [r for r in found if not any(set(less) < set(r[0]) and sure >= r[1] for less, sure, _ in out)]
    return sorted((sorted(t for g in parts for t in groups[g]), c, s) for parts, c, s in out)


@pytest.mark.parametrize("seed", range(4))
def test_rules_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        tokens = {t for t, p in zip("abcdef", (0.9, 0.5, 0.4, 0.3, 0.2, 0.5)) if rng.random() < p}
        tokens |= {"x", "y", "z"} if "b" in tokens else set()
        rows.append((sorted(tokens) + ["w"], ("c" in tokens and "d" in tokens and rng.random() < 0.9) or {"b", "e"} <= tokens or rng.random() < 0.05))
    rows += [(None, True), ([], None), ([None, "a", "a"], False)]
    mined = url_rules.mine(spark.createDataFrame([(*r, 1) for r in rows], "tokens array<string>, blocked boolean, items int"), 0.02, 0.8).collect()
    got = sorted((list(r["items"]), r.confidence, r.support) for r in mined)
    expected = plain_rules(rows, 0.02, 0.8)
    assert [g[0] for g in got] == [e[0] for e in expected] and len(got) > 1
    for g, e in zip(got, expected):
        assert g[1:] == pytest.approx(e[1:])


@pytest.mark.parametrize("copies", [1, 300])
def test_shared_parameters_are_one_item(spark, copies):
    query = "&".join(f"utm{i}=1" for i in range(30))
    urls = [f"http://h{i % 7}.shop/{'es' if i % 3 else 'de'}/x{i}" + (f"?{query}" if i % 5 == 0 else "") for i in range(100 * copies)]
    out = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), [("block", "shop", "/es/")]).collect()
    assert len(out) == len(urls)
    assert all((r.verdict == "block") == ("/es/" in r.url) for r in out)


def test_verdicts_without_a_rule_are_those_of_brute_force(spark):
    rng = random.Random(5)
    urls = list(dict.fromkeys(f"http://{rng.choice('abc')}.{rng.choice(['shop', 'org', 'net'])}/{rng.choice(['es', 'de', 'fr'])}/{rng.choice(['cheap', 'news', 'x'])}/{i % 40}" for i in range(700)))
    policy = [("block", "shop", "/es/"), ("block", "shop", "/fr/"), ("allow", "org", "/"), ("block", "net", "/es/cheap")]
    rows = [(i, u, "x", "y", "z", "w") for i, u in enumerate(urls + urls[:50] + [None])]
    df = spark.createDataFrame(rows, "page_id long, url string, url_ string, found_ string, verdict_ string, RULE string")
    made = url_rules.judge(df, policy, min_confidence=0.5)
    assert set(made.columns) == {"page_id", "url", "url_", "found_", "verdict_", "host", "path", "rule", "verdict"}
    out = made.collect()
    assert sorted(r.page_id for r in out) == list(range(len(rows))) and all((r.url_, r.found_, r.verdict_) == ("x", "y", "z") for r in out)
    parts = spark.createDataFrame([(u,) for u in [*urls, None]], "url string").withColumn("host", url_rules.host_of()).withColumn("path", url_rules.path_of())
    tokens = {r.url: r.tokens for r in parts.withColumn("tokens", url_rules.tokens_of()).collect()}
    ruled = {r.url: r.rule for r in out}
    verdict = {h + p: v for v, h, p in policy}
    rules = plain_rules([(tokens[u], verdict.get(ruled[u]) == "block") for u in tokens], 0.01, 0.5)
    free = [r for r in out if r.rule is None]
    assert {r.verdict for r in free} == {"allow", "block"}
    for r in free:
        assert (r.verdict == "block") == any(set(items) <= set(tokens[r.url]) for items, *_ in rules)


def test_urls_without_a_rule_speak_against_mined_rules(spark):
    urls = [f"http://a.net/es/{i}" for i in range(30)] + [f"http://b.net/en/{i}" for i in range(60)] + [f"http://example.com/en/{i}" for i in range(30)]
    out = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.URL_RULES).collect()
    assert {r.verdict for r in out if r.rule is None} == {"allow"} and sum(r.rule is None for r in out) == 60
    # nine in ten .shop URLs with cheap in the path are blocked by the policy: the tenth is blocked by what they have in common
    urls = [f"http://s{i}.shop/es/cheap" for i in range(95)] + [f"http://s{i}.shop/de/cheap" for i in range(5)] + [f"http://t{i}.org/de/x" for i in range(50)]
    out = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), [("block", "shop", "/es/")]).collect()
    assert {(r.host[0], r.verdict) for r in out if r.rule is None} == {("s", "block"), ("t", "allow")}


def test_long_rules_are_mined(spark):
    rows = [(list("abcdef"), True)] * 20 + [([x for x in "abcdef" if x != y], False) for y in "abcdef"] * 10
    mined = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.02, 0.9)
    assert [("".join(r["items"]), r.confidence, r.support) for r in mined.collect()] == [("abcdef", 1.0, 0.25)]
    assert url_rules.match(spark.createDataFrame([(1, list("abcdefg")), (2, list("abcde"))], "url_ long, tokens array<string>"), mined, "url_").collect()[0].url_ == 1


# --- vectors --------------------------------------------------------------------------------------


def plain_links(vectors, cosine):
    n = len(vectors)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if o else None for v, o in zip(vectors, ok)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    near = [[i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine for j in range(n)] for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if near[i][j] and label[j] < label[i]:
                    label[i], changed = label[j], True
    return [sum(r) for r in near], label


@pytest.mark.parametrize("block, split", [(2048, 8192), (3, 8192), (3, 5)])
def test_vectors_against_brute_force(spark, monkeypatch, block, split):
    monkeypatch.setattr(vector_lsh, "BLOCK", block)
    monkeypatch.setattr(vector_lsh, "SPLIT", split)
    monkeypatch.setattr(vector_lsh, "LOOKED_AT", 1)
    rng = np.random.default_rng(6)
    vectors = []
    for _ in range(25):
        base = rng.normal(size=16)
        vectors += [(base + rng.normal(size=16) * s).tolist() for s in (0, 0.02, 0.05, 0.2)]
    vectors += [vectors[0], vectors[0], [0.0] * 16, None, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, (np.array(vectors[4]) * 1e300).tolist(), (np.array(vectors[4]) * 1e-300).tolist()]
    vectors += [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [2.0, -1.0, 0.0], [1.0, 0.0], [0.999, 0.001], [5.0], [-5.0]]
    ids = [(len(vectors) - i) * 10 for i in range(len(vectors))]
    df = spark.createDataFrame([(i, v, "x") for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_lsh.near_duplicates(df, recall=0.99999).collect()}
    links, label = plain_links(vectors, 0.95)
    for i, id_ in enumerate(ids):
        component = min(ids[j] for j in range(len(ids)) if label[j] == label[i])
        assert got[id_] == (links[i], component, id_ == component)


def test_one_bucket_of_near_copies_is_shared_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(vector_lsh, "BLOCK", 16)
    monkeypatch.setattr(vector_lsh, "SPLIT", 40)
    monkeypatch.setattr(vector_lsh, "LOOKED_AT", 2)
    rng = np.random.default_rng(8)
    hot = rng.normal(size=12)
    vectors = [(hot + rng.normal(size=12) * rng.choice([0.01, 0.15])).tolist() for _ in range(300)] + rng.normal(size=(200, 12)).tolist()
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_lsh.near_duplicates(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"), recall=0.999999).collect()}
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.95) & ~np.eye(500, dtype=bool)
    assert [got[i][0] for i in range(500)] == near.sum(axis=1).tolist()
    reach = np.arange(500)
    for _ in range(500):
        reach = np.minimum(reach, np.where(near, reach[None, :], 500).min(axis=1))
    assert [got[i][1] for i in range(500)] == reach.tolist()


def test_vector_ids_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(None, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [0.99, 0.01]), (3, [0.0, 1.0]), (5, [1.0, 2.0, 3.0]), (6, [1.0, 2.0, 3.0]), (None, None)]
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in vector_lsh.near_duplicates(spark.createDataFrame(rows, schema), recall=0.9999).collect()))
    assert got == [(0, 0, 0, False), (0, 2, 7, False), (3, 0, 3, True), (5, 1, 5, True), (6, 1, 5, False), (7, 2, 7, True), (7, 2, 7, True)]
    assert vector_lsh.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    assert vector_lsh.near_duplicates(spark.createDataFrame([(1, None)], schema)).collect()[0].kept


def test_recall_on_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = df.collect()
    unit = np.array([r.embedding for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    exact = dict(zip((r.vec_id for r in rows), ((unit @ unit.T) >= 0.95).sum(axis=1) - 1))
    got = {r.vec_id: r.n_links for r in vector_lsh.near_duplicates(df).collect()}
    assert all(got[i] <= exact[i] for i in exact) and sum(got.values()) >= 0.97 * sum(exact.values())


# --- components -----------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(9)
    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 80)], "random": [(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(45)], "none": []}[shape]
    edges += [(a, a) for a, _ in edges[:3]] + [(None, 4), (4, None)]
    label = {x: x for e in edges for x in e if None not in e}
    for _ in label:
        for a, b in edges:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    expected = {x: r for x, r in label.items() if any(x in e and e[0] != e[1] and None not in e for e in edges)}
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == expected and len(got) == len(expected)
