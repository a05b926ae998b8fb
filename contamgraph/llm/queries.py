"""The registered queries of this subpackage: one thin query for each operator."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contamgraph.plans.lineage import read_table


def op2_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contamgraph.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"))


def held_out(modulus: int) -> Column:
    """Rows of the contract's held-out part: crc32 of the id as text leaves 2."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == 2


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contamgraph.llm.decontaminate import leaks

    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contamgraph.llm.katz_lm import katz_scores

    out = katz_scores(read_table(spark, sf_dir, "documents"), ~held_out(7))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", (F.col("score") / F.col("n_tokens")).alias("mean_score"))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contamgraph.llm.language_id import identify

    return identify(read_table(spark, sf_dir, "documents"), held_out(4))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contamgraph.llm.jaccard_join import near_duplicate_components

    return near_duplicate_components(read_table(spark, sf_dir, "documents"))


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contamgraph.llm.cotrain import classify

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), flag_col="toxic")


def op7_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contamgraph.llm.maxscore import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"))


#: The contract's rules: (host, path, action).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op8_rarest_token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contamgraph.llm.url_rules import filter_urls

    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contamgraph.llm.substring_dedup import repeated_spans

    out = repeated_spans(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("n_passage").alias("n_passage_bytes"))


def op10_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contamgraph.llm.secret_scan import scan, span_text

    out = scan(read_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(span_text(F.col("secret_spans"), ("assign", "access", "hex")), 256).alias("base_sha256"),
        span_text(F.col("secret_spans")).alias("spans"), of("random").alias("n_random"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_template_decontamination, op2_linear_grouping, op3_katz_backoff, op4_language_mixture, op5_ngram_jaccard_join,
        op6_cotraining, op7_maxscore_top_k, op8_rarest_token_rules, op9_suffix_array_dedup, op10_token_efficiency,
    )
    return {f.__name__: f for f in every}


_OP7_SQL = """
WITH q AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_OP8_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(raw) + 1) AS after FROM h),
t AS (SELECT page_id, host, regexp_extract(after, '^[^?#]*') AS path, '.' || host AS dotted, lower(host || after) AS whole FROM p),
r AS (SELECT *, CASE
    WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ends_with(dotted, '.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ends_with(dotted, '.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ends_with(dotted, '.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ends_with(dotted, '.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM t)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(whole, '^([^/?#]*\.)?example\.org([^a-z0-9_.%-]|$)about([^a-z0-9_.%-]|$)') THEN 'allow'
    WHEN regexp_matches(whole, '^([^/?#]*\.)?(spam-farm\.example\.org|doubleclick\.net)([^a-z0-9_.%-]|$)')
      OR regexp_matches(whole, '^([^/?#]*\.)?adservice\..*/ads/') OR regexp_matches(whole, '/(wp-login|xmlrpc)\.php([^a-z0-9_.%-]|$)')
      OR regexp_matches(whole, '/cgi-bin/.*\.exe') OR contains(whole, '/phishing/')
      OR regexp_matches(whole, '[^a-z0-9_.%-](casino|viagra)([^a-z0-9_.%-]|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""


def oracle_sql() -> dict[str, str]:
    """SQL on whole tables; the other operators are tested against brute force."""
    return {"op7_maxscore_top_k": _OP7_SQL, "op8_rarest_token_rules": _OP8_SQL}
