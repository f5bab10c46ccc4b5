"""The queries of these operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import bounded
from grainmill.llm.decontaminate import hits
from grainmill.llm.language_id import language_id
from grainmill.llm.line_dedup import line_dedup
from grainmill.llm.partenum import jaccard_join
from grainmill.llm.pii import personal_data
from grainmill.llm.quality_rules import quality_rules
from grainmill.llm import sentence_piece
from grainmill.llm.token_file import token_ids
from grainmill.llm.url_filter import url_filter
from grainmill.llm.warc import warc

#: Fixed values of the URL query: (verdict, host, path) of each rule, and the blocked domains.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
URL_BLOCKED = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets") for top in ("com", "net", "org")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_found")


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"), words=4, percent=85)[0].select("doc_id", "n_shingles", "component_id")


def op6_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_piece.encode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"), least=1).select("doc_id", "text", "n_chars")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), URL_RULES, URL_BLOCKED)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc(_table(spark, sf_dir, "pages"), least_bytes=0).drop("target_uri")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict:
    return {f.__name__: f for f in (op1_personal_data, op2_token_file, op3_language_id, op4_decontaminate, op5_jaccard_join, op6_sentence_piece, op7_line_dedup, op8_url_filter, op9_warc, op10_quality_rules, pipeline)}


def _op8_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    listed = ", ".join(f"('{h}')" for h in URL_BLOCKED)
    fits = "(u.host = {0} OR suffix(u.host, '.' || {0}))"
    return f"""
WITH rules(verdict, h, p) AS (VALUES {rules}), listed(h) AS (VALUES {listed}),
r AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
best AS (SELECT u.page_id, arg_max(rules.h || rules.p, length(rules.h || rules.p)) AS rule, arg_max(rules.verdict, length(rules.h || rules.p)) AS verdict
  FROM u JOIN rules ON {fits.format("rules.h")} AND starts_with(u.path, rules.p) GROUP BY 1),
bad AS (SELECT DISTINCT u.page_id FROM u JOIN listed ON {fits.format("listed.h")})
SELECT u.page_id, u.host, u.path, best.rule, coalesce(best.verdict, CASE WHEN bad.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (page_id) LEFT JOIN bad USING (page_id)"""


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
k AS (SELECT hex, max(page_id) AS keeper FROM p GROUP BY 1)
SELECT page_id, strlen(body) AS payload_bytes,
  {" || ".join(f"substr('{_ALPHABET}', (((('0x' || substr(hex, {5 * g + 1}, 5))::BIGINT >> {15 - 5 * j}) & 31) + 1)::BIGINT, 1)" for g in range(8) for j in range(4))} AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM p JOIN k USING (hex)"""


_OP5_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM t),
n AS (SELECT doc_id, len(g) AS n, g FROM s),
x AS (SELECT doc_id, n, unnest(g) AS f FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM x a JOIN x b ON a.f = b.f AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
l AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) m ON m.a = n.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": _OP5_SQL, "op8_url_filter": _op8_sql(), "op9_warc": _OP9_SQL}
