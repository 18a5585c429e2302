"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm import bpe, conversation_repair, html_text, katz, license_scan, mixing, quality, simhash, sketch, spelling, token_counts, url_rules, vector_lsh

RANKS, MODEL = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
ACCEPT = 0.7
TOKEN_LIMIT = 1024

#: (verdict, host, path) of the URL policy.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

MIX_WEIGHTS = {
    ("web",): 50, ("books",): 25, ("code",): 15, ("reference",): 10,
    ("web", "en"): 4, ("web", "de"): 2, ("books", "en"): 3, ("reference", "en"): 2,
    ("web", "en", "src0"): 3, ("books", "en", "src11"): 2,
}
MIX_EPOCHS, MIX_SEED = 4, 7
#: One occurring (document, run) in so many loses a letter before words are counted.
SPELLING_DAMAGE = 199


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_domain(source: str = "source") -> F.Column:
    """Domain of a source by its number: below 10 web, below 14 books, below 17 code, else reference; other where it has none."""
    number = F.regexp_extract(F.col(source), r"^src([0-9]{1,9})$", 1).try_cast("int")
    return F.coalesce(F.when(number < 10, "web").when(number < 14, "books").when(number < 17, "code").when(number >= 17, "reference"), F.lit("other"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), source_domain(), MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return near.withColumn("fingerprint", simhash.as_hex("fingerprint"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    forest = quality.fit_on(docs, _table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs.select("doc_id", "text"), forest)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip_digests(docs, partial(public_tokenizers.path, RANKS), public_tokenizers.PATTERN).select("doc_id", "digest.*")


def op5_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.half_edited(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_count(docs, partial(public_tokenizers.path, MODEL))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"), phrases=license_scan.PHRASES)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_lsh.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.with_main_text(_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(_table(spark, sf_dir, "documents"), damage=SPELLING_DAMAGE))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(_table(spark, sf_dir, "conversations")), times="times")


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return katz.score(_table(spark, sf_dir, "documents"), unseen)


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_bottom_k_fingerprints": op5_bottom_k_fingerprints,
    "op6_token_counts": op6_token_counts,
    "op7_license_scan": op7_license_scan,
    "op8_url_rules": op8_url_rules,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_html_main_text": op10_html_main_text,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_lm_scoring": op13_lm_scoring,
}


def _node_sql(depth: int) -> str:
    """One level of the budget tree: water-filling among the children of each parent, by a running sum over their need."""
    path = mixing.LEVELS[: depth + 1]
    cols, parent = ", ".join(path), mixing.LEVELS[:depth]
    weights = {k: v for k, v in MIX_WEIGHTS.items() if len(k) == depth + 1}
    cases = " ".join(f"WHEN {' AND '.join(f"{c} = '{p}'" for c, p in zip(path, k))} THEN {float(v)}" for k, v in weights.items())
    weight = f"CASE {cases} ELSE 1.0::DOUBLE END" if cases else "1.0::DOUBLE"
    source = "available.*, (SELECT CAST(sum(available) AS DOUBLE) FROM available) AS have" if not depth else "available.*, s.have"
    joined = "available" if not depth else f"available JOIN share{depth - 1} s USING ({', '.join(parent)})"
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    return f"""
nodes{depth} AS (SELECT {cols}, sum(CAST(available AS DOUBLE)) * {MIX_EPOCHS} AS cap, any_value(have) AS have, {weight} AS weight
  FROM (SELECT {source} FROM {joined}) GROUP BY {cols}),
levels{depth} AS (SELECT *, (have - coalesce(sum(cap) OVER ({part} ORDER BY cap / weight, {cols} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER ({part} ORDER BY cap / weight, {cols} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM nodes{depth}),
share{depth} AS (SELECT {cols}, least(cap, weight * greatest(0.0, max(level) OVER ({part}))) AS have FROM levels{depth}),"""


ORACLES: dict[str, str] = {
    "op1_source_mixing": rf"""
WITH docs AS (SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens,
    CAST(regexp_extract(source, '^src([0-9]{{1,9}})$', 1) AS VARCHAR) AS number FROM documents),
named AS (SELECT doc_id, lang, source, tokens, CASE WHEN TRY_CAST(number AS INTEGER) < 10 THEN 'web' WHEN TRY_CAST(number AS INTEGER) < 14 THEN 'books'
    WHEN TRY_CAST(number AS INTEGER) < 17 THEN 'code' WHEN TRY_CAST(number AS INTEGER) >= 17 THEN 'reference' ELSE 'other' END AS domain FROM docs),
available AS (SELECT domain, lang, source, sum(tokens) AS available FROM named GROUP BY ALL),{''.join(map(_node_sql, range(3)))}
quotas AS (SELECT *, CAST(floor(have + 1e-6) AS BIGINT) AS quota FROM share2 JOIN available USING (domain, lang, source) WHERE available > 0),
plan AS (SELECT *, CAST(least(quota // available, {MIX_EPOCHS}) AS INTEGER) AS full_epochs FROM quotas),
offered AS (SELECT doc_id, domain, lang, source, tokens, epoch, full_epochs, quota - full_epochs * available AS rest,
    ('0x' || substr(md5('{MIX_SEED}-' || epoch || '-' || doc_id), 1, 15))::BIGINT AS place
  FROM named JOIN plan USING (domain, lang, source), (SELECT unnest(range({MIX_EPOCHS})) AS epoch) WHERE epoch <= full_epochs),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY place, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM offered)
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(epoch AS INTEGER) AS epoch FROM run
WHERE epoch < full_epochs OR (rest > 0 AND upto <= rest)""",
}
