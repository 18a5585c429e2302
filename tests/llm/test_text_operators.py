"""Operators over texts against brute-force versions and the libraries they must agree with."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.llm import bpe, html_text, license_scan, quality, sketch, token_counts

RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
ODD_TEXTS = [
    None, "", " ", "\n\n  \t x", "a", "don't we'll  I'd", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "naïve café — 12½ ²³ ௧௨ 中文字符 🙂🙂 ​  z",
    "a" * 5000, "　 \r\n\x0b\x1c mixed \x85 space", "é" * 300 + " " * 40 + "end", "1234567890 12 3 ٣٤", "can't've 's 't",
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("count", T.StringType())])


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return ODD_TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]


# --- byte-level BPE -------------------------------------------------------------------------------


def test_round_trip(spark, texts):
    rows = bpe.round_trip_digests(frame(spark, texts), RANKS, PATTERN).orderBy("doc_id").collect()
    encoding = bpe.load(RANKS, PATTERN)
    for r, t in zip(rows, texts):
        ids = encoding.encode_ordinary(t or "")
        assert r.digest.n_tokens == len(ids)
        assert r.digest.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.digest.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_ids_and_bytes_in_slices(spark, texts, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_CHARS", 9)
    encoding = bpe.load(RANKS, PATTERN)
    rows = bpe.with_tokens(frame(spark, texts).withColumnRenamed("count", "ids"), RANKS, PATTERN, decoded="bytes")
    assert rows.columns == ["doc_id", "text", "ids", "bytes"]
    for r in rows.collect():
        assert r.ids == encoding.encode_ordinary(r.text or "") and bytes(r.bytes).decode() == (r.text or "")


def test_ids_and_bytes_as_columns(spark, texts):
    df = bpe.with_decoded(bpe.with_tokens(frame(spark, texts), RANKS, PATTERN), RANKS, PATTERN)
    assert df.columns == ["doc_id", "text", "count", "ids", "decoded"]
    for r in df.collect():
        assert bytes(r.decoded).decode() == (r.text or "")
    assert bpe.with_tokens(frame(spark, []), RANKS, PATTERN).collect() == []
    half = spark.createDataFrame([([bpe.encode("🙂", bpe.load(RANKS, PATTERN), PATTERN)[0]],), (None,)], "ids array<int>")
    assert [r.decoded and bytes(r.decoded) for r in bpe.with_decoded(half, RANKS, PATTERN).collect()] == [b"\xf0\x9f\x99\x82"[: len(bpe.load(RANKS, PATTERN).decode_single_token_bytes(half.first().ids[0]))], None]


@pytest.mark.parametrize("length", [1, 7, 50])
def test_cuts_are_starts_of_matches(length):
    rng = random.Random(length)
    alphabet = ["a", "b", " ", "  ", "\n", "'s", "1", "!", "é", "中", " ", "don't "]
    for _ in range(200):
        text = "".join(rng.choice(alphabet) for _ in range(60))
        parts = list(bpe.pieces(text, PATTERN, length))
        assert "".join(parts) == text
        assert [m for p in parts for m in regex.findall(PATTERN, p)] == regex.findall(PATTERN, text)


def test_counts_equal_the_library(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(MODEL)
    rng = random.Random(1)
    more = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x500), 0x4E2D, 32, 10])) for _ in range(200)) for _ in range(60)]
    every = texts + more
    rows = token_counts.with_token_count(frame(spark, every), MODEL).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in every]


def test_count_blocks_and_forgetting(monkeypatch):
    text = "some words of a longer text, don't  cut\n here " * 30
    plain = token_counts.Counter(MODEL).text(text)
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", 11)
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    assert token_counts.Counter(MODEL).text(text) == plain


# --- sketches -------------------------------------------------------------------------------------


def plain_shingles(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_shingle_hashes_follow_the_shingles(texts):
    seen = {}
    for t in texts:
        words = regex.findall(r"[^\x20\x09-\x0D]+", t or "")
        shingles = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
        hashes = sketch.shingle_hashes(t).tolist()
        assert len(hashes) == len(shingles)
        for h, s in zip(hashes, shingles):
            assert seen.setdefault(h, s) == s
    assert len(set(seen.values())) == len(seen)


def test_shingle_hashes_by_blocks(monkeypatch):
    text = " ".join(f"word{i}" for i in range(300)) + " " + "x" * 90 + " tail"
    plain = sketch.shingle_hashes(text)
    monkeypatch.setattr(sketch, "BLOCK_BYTES", 16)
    assert (sketch.shingle_hashes(text) == plain).all()


def test_estimates_are_near_and_exact_when_small():
    rng = random.Random(2)
    a = [str(rng.random()) for _ in range(4000)]
    b = a[:2600] + [str(rng.random()) for _ in range(1400)]
    x, y = (sketch.bottom(sketch.shingle_hashes(" ".join(t)), 512) for t in (a, b))
    sa, sb = plain_shingles(" ".join(a)), plain_shingles(" ".join(b))
    assert abs(sketch.resemblance(x, y, 512) - len(sa & sb) / len(sa | sb)) < 0.08
    assert abs(sketch.containment(x, y, 512) - len(sa & sb) / len(sa)) < 0.1
    assert abs(sketch.distinct(x, 512) / len(sa) - 1) < 0.15
    s, t = sketch.bottom(sketch.shingle_hashes("a b c d e f g")), sketch.bottom(sketch.shingle_hashes("a b c d e f x"))
    assert sketch.resemblance(s, t) == 0.5 and sketch.distinct(s) == 3 and sketch.containment(s, t) == pytest.approx(2 / 3)
    assert sketch.resemblance(sketch.bottom(sketch.shingle_hashes("")), sketch.bottom(sketch.shingle_hashes(None))) == 1.0


def test_merged_sketches(spark):
    rows = [("p", "a b c d e f"), ("p", "b c d e f g"), ("p", None), ("q", ""), (None, "u v w x y z")]
    df = sketch.with_sketch(spark.createDataFrame(rows, "part string, text string"), k=4)
    got = {r.part: r.sketch for r in sketch.merge_sketches(df, ["part"], k=4).collect()}
    p = np.concatenate([sketch.shingle_hashes(rows[0][1]), sketch.shingle_hashes(rows[1][1])])
    assert got["p"] == sketch.bottom(p, 4).astype(np.int64).tolist() and got["q"] == []
    assert got[None] == sketch.bottom(sketch.shingle_hashes(rows[4][1]), 4).astype(np.int64).tolist()
    pair = df.select("sketch", F.reverse("sketch").alias("other")).limit(1)
    assert sketch.with_estimates(pair.select("sketch", F.col("sketch").alias("other")), "sketch", "other", 4).first().resemblance == 1.0


def plain_edits(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for at, (i, t) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("ids", ["dense", "ties and nulls", "wide", "one", "none"])
def test_edited_texts(spark, texts, ids):
    rng = random.Random(4)
    number = {"dense": lambda i: i, "ties and nulls": lambda i: None if i % 9 == 0 else i // 4, "wide": lambda i: rng.randrange(-(2**62), 2**62), "one": lambda i: 5, "none": lambda i: None}[ids]
    rows = [(number(i), t) for i, t in enumerate(texts)]
    if ids == "one":
        rows = rows[5:6]
    out = sketch.half_edited(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out), key=key) == sorted(plain_edits(rows), key=key)
    for r in out:
        assert r.near_edited == sketch.resemblance(sketch.from_text(r.fingerprint), sketch.from_text(r.edited_fingerprint))
    assert sketch.half_edited(spark.createDataFrame([], SCHEMA)).collect() == []


# --- quality --------------------------------------------------------------------------------------


def test_forest_learns_and_descends():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    forest = quality.fit(x[:2000], y[:2000])
    scores = forest.score(x[2000:])
    assert ((scores >= 0.5) == y[2000:]).mean() > 0.95

    def plain(row):
        margin = forest.start
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (row[f[at]] > t[at])
            margin += leaf[at - len(f)]
        return 1 / (1 + np.exp(-margin))

    assert np.allclose([plain(r) for r in x[2000:2050]], scores[:50])


def test_forest_without_two_classes():
    assert quality.fit(np.empty((0, 3)), np.empty(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (quality.fit(np.zeros((9, 3)), np.ones(9)).score(np.zeros((2, 3))) > 0.9).all()


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.fit_on(docs, labels)
    judged = docs.join(labels, "doc_id").where(quality.held_out("doc_id"))
    rows = quality.with_score(judged, forest).select("score", "quality").collect()
    right = np.mean([(r.score >= 0.7) == (r.quality == 1) for r in rows])
    assert len(rows) > 500 and right > 0.95


def test_columns_of_other_names(spark):
    docs = spark.createDataFrame([(i, "words " * i, "x", 1, "y") for i in range(1, 9)], "doc_id long, text string, id_ string, label_ long, text_ string")
    labels = spark.createDataFrame([(i, i % 2, 9) for i in range(1, 9)], "doc_id long, quality int, id_ int")
    assert len(quality.with_score(docs, quality.fit_on(docs, labels)).collect()) == 8


def plain_statistics(text):
    """The same values word by word and byte by byte."""
    import zlib

    text = text or ""
    data, words = text.encode(), text.split()
    n, m = max(1, len(data)), max(1, len(words))
    share = lambda test: sum(map(test, data)) / n
    marks, symbols = b".,;:'\"()-", b"#$%&*+/<=>@[\\]^_`{}~"
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / len(lengths)
    lines = [x for x in text.split("\n") if x]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return dict(
        log_chars=np.log(1 + len(text)), log_words=np.log(1 + len(words)), chars_per_word=len(text) / m, longest_word=max(lengths), word_spread=(sum((x - mean) ** 2 for x in lengths) / len(lengths)) ** 0.5,
        distinct_words=len(set(words)) / m, top_word=max((words.count(w) for w in set(words)), default=0) / m, function_words=sum(w.lower().strip(".,") in quality.FUNCTION_WORDS for w in words) / m,
        capital_words=sum(w[0].isupper() for w in words) / m, shouted_words=sum(len(w) > 1 and w.isupper() for w in words) / m,
        upper=share(lambda b: 65 <= b <= 90), digits=share(lambda b: 48 <= b <= 57), marks=share(lambda b: b in marks), pipes=share(lambda b: b == 124), bangs=share(lambda b: b in b"!?"), symbols=share(lambda b: b in symbols),
        blanks=share(lambda b: 9 <= b <= 13 or b == 32), controls=share(lambda b: b < 9 or 14 <= b < 32 or b == 127), wide=share(lambda b: b > 127),
        log_lines=np.log(1 + len(lines)), chars_per_line=len(text) / max(1, len(lines)), repeated_lines=1 - len(set(lines)) / max(1, len(lines)), longest_line=max(map(len, lines), default=0) / max(1, len(text)),
        words_per_sentence=len(words) / max(1, sum(c in ".!?" for c in text)), repeated_triples=1 - len(set(triples)) / len(triples) if triples else 0.0,
        packed=sum(len(zlib.compress(data[i : i + quality.PACK_BYTES], 1)) for i in range(0, len(data), quality.PACK_BYTES)) / n,
        marked_words=sum(w[-1] in "#$%&*!|?@~^=+<>{}[]\\/_" for w in words) / m, doubled_words=sum(a == b for a, b in zip(words, words[1:])) / m, short_words=sum(x <= 2 for x in lengths) / len(lengths),
    )


def test_statistics_are_those_of_brute_force(texts):
    for t in [*texts, "WORD word word! a|b\n\nline\nline\x07 Été ÉTÉ? #x_ {y} the of 1 22"]:
        expected = plain_statistics(t)
        assert list(expected) == quality.STATISTICS
        assert quality.statistics(t) == pytest.approx([float(x) for x in expected.values()], rel=1e-9, abs=1e-12)


def test_a_tree_is_that_of_brute_force():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(60, 3)), 1)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=60) * 0.3 > 0.4).astype(float)
    forest = quality.fit(x, y, trees=2, depth=2, rate=0.3, bins=64, least=0.5, l2=1.0)
    margin = np.full(60, np.log((y.sum() + 0.5) / 61 / (1 - (y.sum() + 0.5) / 61)))

    def value(g, h):
        return g * g / (h + 1.0)

    def grown(rows, g, h, depth):
        """Leaves of the best splits at the values themselves."""
        if not depth:
            return [(rows, -0.3 * g[rows].sum() / (h[rows].sum() + 1.0))]
        best = (1e-9, None)
        for j in range(3):
            for cut in np.unique(x[:, j])[:-1]:
                low, high = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                if h[low].sum() >= 0.5 and h[high].sum() >= 0.5:
                    gain = value(g[low].sum(), h[low].sum()) + value(g[high].sum(), h[high].sum()) - value(g[rows].sum(), h[rows].sum())
                    best = max(best, (gain, (low, high)), key=lambda b: round(b[0], 9))
        if best[1] is None:
            return grown(rows, g, h, 0)
        return [leaf for side in best[1] for leaf in grown(side, g, h, depth - 1)]

    for _ in range(2):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(60)
        for rows, leaf in grown(np.arange(60), p - y, p * (1 - p), 2):
            step[rows] = leaf
        margin = margin + step
    assert np.allclose(forest.score(x), 1 / (1 + np.exp(-margin)))


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (4, 0), (5, 1)], "doc_id long, quality int")
    docs = frame(spark, ODD_TEXTS)
    scored = quality.with_score(docs, quality.fit_on(docs, labels)).collect()
    assert len(scored) == len(ODD_TEXTS) and all(0 <= r.score <= 1 for r in scored)
    assert quality.with_score(frame(spark, []), quality.fit_on(docs, labels)).collect() == []
    for t in ODD_TEXTS:
        values = quality.statistics(t)
        assert len(values) == len(quality.STATISTICS) and np.isfinite(values).all()


# --- licenses -------------------------------------------------------------------------------------


def plain_scan(text, templates, contained=0.8):
    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    sh = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    out = {}
    for name, template in templates.items():
        tw = regex.findall(r"[\p{L}\p{N}]+", template.lower())
        ordered = [tuple(tw[i : i + 5]) for i in range(len(tw) - 4)]
        own, slack = list(dict.fromkeys(ordered)), -(-len(ordered) // 4)
        starts = {i - own.index(s) for i, s in enumerate(sh) if s in own}
        kept = {s: c for s in starts if (c := len(set(own) & set(sh[max(s - slack, 0) : max(s - slack, 0) + len(ordered) + 2 * slack])) / len(own)) >= contained}
        if kept:
            out[name] = (max(kept.values()), max(min(kept), 0), len(kept))
    return out


def test_license_scan(spark, texts):
    rng = random.Random(8)
    lorem = lambda n: " ".join(rng.choice("amber brick cloud delta eager fable giant honey".split()) for _ in range(n))
    mit, gpl = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["GPL-3.0-or-later"]
    edited = mit.replace("free of charge", "without any charge").replace("publish, distribute", "print, distribute")
    odd = [lorem(50) + " " + mit + " " + lorem(30), edited, "\n".join(gpl.upper().split()), lorem(9) + " Released under the MIT License. " * 3, mit[: len(mit) // 2], lorem(20_000) + gpl, "Released under MIT License.", *license_scan.TEMPLATES.values()]
    every = ODD_TEXTS + odd + texts
    got = {}
    for r in license_scan.scan(frame(spark, every)).collect():
        got.setdefault(r.doc_id, {})[r.license] = (r.containment, r.first_word, r.places)
    assert got == {i: found for i, t in enumerate(every) if (found := plain_scan(t, license_scan.TEMPLATES))}
    with pytest.raises(ValueError):
        license_scan.scan(frame(spark, []), {"short": "too few words"})
    assert license_scan.scan(frame(spark, [])).collect() == []


def test_phrases(spark, sf_dir):
    texts = ["All rights reserved", "(c) 2020. ALL  RIGHTS\nRESERVED! all rights reserved", "all rights are reserved", "All rights", None, "", "x " * 30 + "all all rights reserved. Released under the MIT License."]
    got = sorted((r.doc_id, r.license, r.containment, r.first_word, r.places) for r in license_scan.scan(frame(spark, texts), phrases=license_scan.PHRASES).collect())
    assert got == [(0, "All rights reserved", 1.0, 0, 1), (1, "All rights reserved", 1.0, 2, 2), (6, "All rights reserved", 1.0, 31, 1), (6, "MIT notice", 1.0, 34, 1)]
    with pytest.raises(ValueError):
        license_scan.scan(frame(spark, []), phrases={"none": "..."})
    from barflow.llm import queries

    found = {r.doc_id for r in queries.op7_license_scan(spark, "/root/testdata/sf0.01").where("license = 'All rights reserved'").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    expected = {r.doc_id for r in docs if " all rights reserved " in " " + " ".join(regex.findall(r"[\p{L}\p{N}]+", (r.text or "").lower())) + " "}
    assert found == expected and expected


# --- pages ----------------------------------------------------------------------------------------

PAGES = {
    "plain": ("<html><head><title>No</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href='/'>Home</a></nav><div class=\"ad\">Buy now</div>"
              "<article><h1>A &amp; B</h1><p>First  para\n with <b>bold</b> and &#233;.</p><p>Short.</p></article><footer>&copy; x</footer></body></html>", "A & B\nFirst para with bold and é.\nShort."),
    "unclosed": ("<body><nav><ul><li><a href=x>Menu</a><li>b</ul></nav><article><h1>T</h1><p><b>One one one.<br><p>Two two two.</article><footer>f</footer>", "T\nOne one one.\nTwo two two."),
    "comments": ("<body><header><h1>Site</h1></header><main><article><header><h2>Head</h2></header><p>" + "text of it " * 20 + "</p><form><input><label>Mail</label></form><aside>See also</aside><p>End.</p></article>"
                 "<section id=\"comments\"><div class='comment'><p>" + "reader says " * 40 + "</p></div></section></main><div class='cookie-banner'>We use cookies</div>", "Head\n" + ("text of it " * 20).strip() + "\nEnd."),
    "no article": ("<body><div id='nav-menu'><a href=a>x</a></div><div><p>" + "first words here " * 9 + "</p><p>" + "more words here " * 9 + "</p></div><div role=contentinfo>foot</div>", ("first words here " * 9).strip() + "\n" + ("more words here " * 9).strip()),
    "commented": ("<body><div class='site-notice'>Closed today</div><main><div class='entry-header'><h1>T</h1></div><p>Real text here.</p><p style='display: none'>x</p></main>"
                  "<article class='comment'><p>" + "a long reader comment " * 30 + "</p></article><div id='disqus_thread'>more</div></body>", "T\nReal text here."),
    "empty": ("", ""), "null": (None, ""), "only markup": ("<html><body><nav>a</nav></body></html>", ""), "cut": ("<article><p>Half a senten", "Half a senten"),
    "bare text": ("just text &lt;3", "just text <3"), "lists": ("<article><p>Items:</p><ul><li>one<li>two</ul><table><tr><td>c1</td><td>c2</td></tr></table><pre>a\n b</pre></article>", "Items:\none\ntwo\nc1\nc2\na b"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    html, text = PAGES[name]
    assert html_text.main_text(html) == text


LONG = ("many words of a long paragraph " * 12).strip()
REGIONS = {
    "teaser beside the text": (f"<body><nav><a href=a>x</a></nav><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><article class=card><h3>Teaser</h3></article><article> </article></body>", ["T", LONG, LONG], []),
    "text around an article": (f"<main><h1>Title</h1><p>The lead of it.</p><article><p>{LONG}</p></article><p>The end.</p></main>", ["Title", "The lead of it.", LONG, "The end."], []),
    "several articles": (f"<body><article><h1>A</h1><p>{LONG}</p></article><article><p>{LONG[:200]}</p></article><article><p>{LONG[:100]}</p></article></body>", ["A", LONG, LONG[:200].strip(), LONG[:100].strip()], []),
    "skew": ("<body><header>Site</header><div><p>A short lead.</p><p>Then one.</p><p>Then two.</p><p>Then three.</p><div class=ad>Buy</div><p>Then four.</p><p>Then five.</p><p>" + LONG * 60 + "</p><p>One more.</p><p>Two more.</p><p>Three more.</p><p>Four more.</p><p>Closing.</p>"
             "</div><div><a href=a>Link one</a></div><div><a href=b>Link two</a></div><div>Imprint</div></body>", ["A short lead.", "Then four.", "Four more.", "Closing."], ["Site", "Buy", "Link one", "Imprint"]),
    "links around": (f"<main><p><a href=a>Back</a></p><article><p>{LONG}</p></article></main>", [LONG], ["Back"]),
}


@pytest.mark.parametrize("name", REGIONS)
def test_region_is_whole(name):
    html, kept, left = REGIONS[name]
    lines = html_text.main_text(html).split("\n")
    assert [x for x in lines if x in kept] == kept and not [x for x in lines if x in left]


NAMES = [
    *[f"<body><div {w}><article><p>{LONG}</p><p>{{}}</p></article></div></body>" for w in ("class='content with-sidebar'", "id=page class=no-sidebar", "class=has-banner", "class=sidebar", "id=header", "class='search menu'")],
    *[f"<article><p>{LONG}</p><div class='{w}'><p>{{}}</p></div></article>" for w in ("share-price", "search-results", "related-work", "social-science", "notice-period")],
    f"<article><p>Short.</p><div class=notice><p>{LONG} {{}}</p></div></article>", f"<div class=related><main><p>{LONG}</p><p>{{}}</p></main></div>",
]


@pytest.mark.parametrize("html", NAMES)
def test_names_of_layout_and_subjects_stay(html):
    assert html_text.main_text(html.format("kept to the last word")).endswith("kept to the last word")


@pytest.mark.parametrize("name", ["ad", "cookie-banner", "comments", "comment-body", "site-notice", "share_buttons", "related-posts", "notice"])
def test_named_parts_are_left_out(name):
    part = f"<div class='{name}'><p>left <a href=x>out</a></p></div>"
    assert html_text.main_text(f"<article><p>{LONG}</p>{part}<p>End.</p></article>") == LONG + "\nEnd."
    assert html_text.main_text(f"<body>{part}<div class=comments><article><p>{LONG}</p></article></div><main><p>{LONG}</p><p>End.</p></main></body>") == LONG + "\nEnd."


FORMS = {
    "around the page": (f"<body><form id=page><h1>T</h1><p>{LONG}</p><input name=x></form></body>", "T\n" + LONG),
    "around an article": (f"<body><form><nav>menu</nav><article><h1>T</h1><p>{LONG}</p></article><button>Go</button></form></body>", "T\n" + LONG),
    "beside it": (f"<body><form><label>Mail</label><input></form><div><p>{LONG}</p></div><form class=search-form><p>{LONG}</p></form></body>", LONG),
    "inside it": (f"<article><p>{LONG}</p><form><p>{LONG}</p></form></article>", LONG),
    "formula": (f"<article><p>{LONG} where <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>\\x</annotation></math> holds</p></article>", LONG + " where x=2 holds"),
    "quote": (f"<article><p>{LONG}</p><article class=quote><p>quoted words</p></article></article>", LONG + "\nquoted words"),
    "title above links": (f"<body><h1>T</h1><ul><li><a href=a>1</a><li><a href=b>2</a><li><a href=c>3</a></ul><p>{LONG}</p><p>End.</p></body>", f"T\n{LONG}\nEnd."),
}


@pytest.mark.parametrize("name", FORMS)
def test_forms_formulas_and_titles(name):
    html, text = FORMS[name]
    assert html_text.main_text(html) == text


def random_page(rng):
    """Blocks (article number or 0, text, whether it is a link), and their page."""
    blocks, html, article = [], "<body>", 0
    for _ in range(rng.randrange(1, 6)):
        own = 0
        if rng.random() < 0.5:
            article += 1
            own = article
            html += "<article>"
        kind = rng.random()
        for _ in range(rng.randrange(0, 9)):
            link = rng.random() < (0.9 if kind < 0.4 else 0.1)
            text = "x" * rng.choice([1, 3, 9, 30] if link or rng.random() < 0.4 else [80, 200, 900]) + str(len(blocks))
            blocks.append((own, text, link))
            html += f"<div><a href=a>{text}</a></div>" if link else f"<p>{text}</p>"
        html += "</article>" if own else ""
    return blocks, html


def plain_region(blocks, flat=False):
    """The content region by its definition: an end tag a paragraph, three tags a link."""
    import math

    ratios = [0.0 if link else float(len(text)) for _, text, link in blocks]
    if flat:
        ratios = [1.0] * len(blocks)
    weight = lambda d: math.exp(-d * d / 2) if abs(d) <= 3 else 0.0
    level = [sum(weight(i - j) * r for j, r in enumerate(ratios)) / sum(weight(i - j) for j in range(len(ratios))) for i in range(len(ratios))]
    mean = sum(level) / max(1, len(level))
    threshold = max(math.sqrt(sum((x - mean) ** 2 for x in level) / max(1, len(level))) / 2, 1e-9)
    content = [x >= threshold and r > 0 for x, r in zip(level, ratios)]
    if not any(content):
        content = [r > 0 for r in ratios]
    if not any(content):
        return []
    inside = {}
    for (own, text, _), c in zip(blocks, content):
        inside[own] = inside.get(own, 0) + (len(text) if c else 0)
    if any(own and 2 * n > sum(inside.values()) for own, n in inside.items()):
        return [text for own, text, _ in blocks if own and inside[own]]
    links = [link for *_, link in blocks]
    low, high = content.index(True), len(content) - 1 - content[::-1].index(True)
    runs = [i for i in range(len(links) - 1) if links[i] and links[i + 1]]
    first = max([i + 2 for i in runs if i + 1 < low], default=0)
    last = min([i - 1 for i in runs if i > high], default=len(links) - 1)
    first = min([i for i in range(first, low) if not links[i]], default=low)
    last = max([i for i in range(high + 1, last + 1) if not links[i]], default=high)
    return [text for _, text, _ in blocks[first : last + 1]]


def test_clusters_decide_the_region(monkeypatch):
    rng = random.Random(12)
    pages = [random_page(rng) for _ in range(600)]
    for blocks, html in pages:
        assert html_text.main_text(html).split("\n") == (plain_region(blocks) or [""])
    moved = [any(own for own, *_ in blocks) for blocks, _ in pages if plain_region(blocks) != plain_region(blocks, flat=True)]
    assert sum(moved) > 50 and sum(not x for x in moved) > 5  # pages with article elements and without
    listing = "<article>" + "<div><a href=a>a link to another page</a></div>" * 60 + "</article>"
    assert html_text.main_text(f"<body>{listing}<div><p>{LONG}</p><p>{LONG}</p></div></body>") == f"{LONG}\n{LONG}"
    monkeypatch.setattr(html_text, "smoothed", lambda x: np.ones(len(x)))
    assert any(html_text.main_text(html).split("\n") != (plain_region(blocks) or [""]) for blocks, html in pages)


def test_clusters_judge_parts_within_the_articles_of_the_table(spark, sf_dir, monkeypatch):
    box, section = "<div class='share'><p>Tell a friend</p><p>Like it</p></div>", "<section id='related'><h2>Related work</h2><p>" + LONG + "</p></section>"
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect() if r.html and "</p>" in r.html]
    assert len(pages) >= 50
    whole = [html_text.main_text(h) for h in pages]
    mixed = [h.replace("</article>", box + section + "</article>") for h in pages]
    want = [w + "\nRelated work\n" + LONG for w in whole]
    right = [html_text.main_text(h) == w for h, w in zip(mixed, want)]
    assert all(right), right.count(False)
    monkeypatch.setattr(html_text, "smoothed", lambda x: np.ones(len(x)))
    assert all("Tell a friend" in html_text.main_text(h) for h in mixed)


def test_parts_of_articles_that_stay_and_lines_beside_them_that_go():
    assert html_text.main_text(f"<article><p>{LONG}</p><fieldset><legend>Box</legend><p>{LONG}</p></fieldset></article>") == f"{LONG}\nBox\n{LONG}"
    assert html_text.main_text(f"<article><p>{LONG}</p><div class=search><p>{LONG[:150].strip()}</p></div></article>") == f"{LONG}\n{LONG[:150].strip()}"
    assert html_text.main_text(f"<div><p>{LONG}</p></div><div class=copyright>All rights</div>") == LONG


def test_deep_nesting_takes_linear_time():
    import time

    n = 100_000
    for html in ("<div>" * n + "<p>text", "<b>" * n + "</i>" * n + "text", "<b><div>" * (n // 2) + "</b>" * n + "text", "<form><section class=search>" * (n // 2) + "text", "<ul><li>" * (n // 2) + "text" + "</li></ul>" * (n // 2)):
        began = time.process_time()
        html_text.main_text(html)
        assert time.process_time() - began < 4
    assert html_text.main_text("<article><p>" + "word " * 400_000 + "</p></article>") == ("word " * 400_000).strip()


def test_main_text_of_rows(spark, sf_dir):
    df = spark.createDataFrame([(1, None, "kept"), (2, PAGES["plain"][0], None)], "page_id long, html string, text string")
    assert [(r.page_id, r.text) for r in html_text.with_main_text(df).orderBy("page_id").collect()] == [(1, ""), (2, PAGES["plain"][1])]
    assert html_text.with_main_text(df.limit(0)).collect() == []
    import html as entities

    for r in html_text.with_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect():
        body = regex.search(r"<article>(.*?)(</article>|$)", r.html, regex.S)[1]
        blocks = regex.split(r"</?(?:p|h1)>", body)
        cleaned = [" ".join(entities.unescape(regex.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in blocks]
        assert r.text == "\n".join(b for b in cleaned if b)
