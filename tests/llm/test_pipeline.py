"""The pipeline's stages against brute-force versions on a small fixture."""

from collections import Counter

import numpy as np
import pytest
import tiktoken  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from barflow.llm import quality, queries, simhash
from test_table_operators import plain_mix


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
    return out


def test_quality_stage(spark, sf_dir, stages):
    docs, kept = stages[:2]
    assert kept.columns == docs.columns
    forest = quality.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.collect()
    scores = forest.score(np.array([quality.statistics(r.text) for r in rows]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r, s in zip(rows, scores) if s >= queries.ACCEPT)


def test_near_duplicate_stage(stages):
    before, after = stages[1].collect(), stages[2].collect()
    prints = [simhash.fingerprint(r.text) for r in before]
    label = {r.doc_id: r.doc_id for r in before}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(before):
            for j in range(i):
                b = before[j]
                if (prints[i] ^ prints[j]).bit_count() <= 4 and label[a.doc_id] != label[b.doc_id]:
                    label[a.doc_id] = label[b.doc_id] = min(label[a.doc_id], label[b.doc_id])
                    changed = True
    assert sorted(r.doc_id for r in after) == sorted(i for i, root in label.items() if i == root)
    assert stages[2].columns == stages[0].columns


def test_mixing_stage(spark, stages):
    assert stages[3].columns == stages[0].columns
    kept = stages[3].groupBy("doc_id").count()
    assert kept.agg(F.max("count")).first()[0] <= queries.MIX_EPOCHS
    assert stages[3].select("doc_id").subtract(stages[2].select("doc_id")).isEmpty()
    rows = [(r.doc_id, r.text, r.lang, r.source, None) for r in stages[2].collect()]
    number = lambda s: int(s[3:]) if s and s.startswith("src") and s[3:].isdigit() else None
    domain = lambda s: "other" if number(s) is None else next(d for d, end in (("web", 10), ("books", 14), ("code", 17), ("reference", 10**9)) if number(s) < end)
    total = sum(len((r[1] or "").encode().split()) for r in rows)
    expected = Counter(r[0] for r in plain_mix(spark, rows, domain, queries.MIX_WEIGHTS, total, queries.MIX_EPOCHS, queries.MIX_SEED))
    assert Counter(r.doc_id for r in stages[3].collect()) == expected


def test_encoding_stage(stages):
    import public_tokenizers

    from barflow.llm import bpe

    encoding = bpe.load(public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    rows = stages[4].collect()
    assert len(rows) == stages[3].count()
    for r in rows:
        assert r.ids == encoding.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def test_run_has_the_rows_of_its_stages(spark, sf_dir, stages):
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.decoded_sha256, tuple(r.ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages[4])


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score_", F.lit("s")).withColumn("id_", F.lit(1)).withColumn("label_", F.lit(None).cast("string"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns and kept.where("score_ <> 's' OR id_ <> 1 OR label_ IS NOT NULL").isEmpty() and not kept.isEmpty()
