"""The registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators import clean, convert, decontaminate, dedup, documents, filters, generate, quality, stats, templates, tokens
from grainmill.operators import vocabulary as V
from grainmill.schema import MESSAGES, from_documents, from_turns
from grainmill.sources.export import Export, rows


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def conv_quality_scores(spark, sf_dir):
    out = quality.analyze(_conversations(spark, sf_dir))
    return out.select("id", "score", "completeness", "formatting", "length_balance", "content_quality", F.size("issues").alias("n_issues"))


def conv_quality_summary(spark, sf_dir):
    return quality.summary(quality.analyze(_conversations(spark, sf_dir)))


def conv_issue_counts(spark, sf_dir):
    return quality.issue_table(quality.analyze(_conversations(spark, sf_dir)))


def doc_issue_counts(spark, sf_dir):
    return quality.issue_table(quality.analyze(_documents(spark, sf_dir)))


def conv_role_counts(spark, sf_dir):
    return stats.role_counts(_conversations(spark, sf_dir))


def conv_overview(spark, sf_dir):
    return stats.overview(_conversations(spark, sf_dir)).select("n", "with_reasoning", "avg_turns", "estimated_tokens")


def split_counts(spark, sf_dir):
    return stats.counts(filters.auto_split(_documents(spark, sf_dir), 0.1, 0.05), "split")


def split_members(spark, sf_dir):
    return filters.auto_split(_documents(spark, sf_dir), 0.1, 0.05).select("id", "split")


def filter_search_page(spark, sf_dir):
    found = filters.matching(_conversations(spark, sf_dir), filters.Filter(split="train", type="sft", search=" THE "))
    return filters.ordered(found).offset(5).limit(20).select("id")


def token_estimates(spark, sf_dir):
    return _documents(spark, sf_dir).select("id", tokens.estimated_tokens().alias("tokens"), tokens.approximate(F.col("messages")[0]["content"]).alias("approximate"))


def token_histogram(spark, sf_dir):
    return stats.token_histogram(_documents(spark, sf_dir))


def exact_dup_groups(spark, sf_dir):
    return dedup.exact_groups(_documents(spark, sf_dir)).select("keep_id", "n")


def exact_dup_kept(spark, sf_dir):
    df = _documents(spark, sf_dir)
    return dedup.without(df, dedup.exact_drops(df)).select("id")


def near_dup_pairs(spark, sf_dir):
    """Pairs of class representatives, over whole texts; near_dup_members tells whom they stand for."""
    return dedup.exact_pairs(_documents(spark, sf_dir), prefix=None)


def near_dup_members(spark, sf_dir):
    return dedup.classes(_documents(spark, sf_dir), prefix=None)


def near_dup_groups(spark, sf_dir):
    return dedup.near_groups(_documents(spark, sf_dir), prefix=None)


def _items(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.lit("benchmark").alias("benchmark"), "text")


def decontam_hits(spark, sf_dir):
    return decontaminate.hits(_documents(spark, sf_dir), _items(spark, sf_dir))


def pii_flags(spark, sf_dir):
    t = F.col("messages")[0]["content"]
    return _documents(spark, sf_dir).select("id", *(t.rlike(p).alias(n) for n, (_, _, p) in zip(("email", "ssn", "card", "ip", "phone"), V.PII, strict=True)))


def pii_masked(spark, sf_dir):
    return _documents(spark, sf_dir).select("id", F.md5(clean.mask_pii(F.col("messages")[0]["content"])).alias("masked"))


def refusal_flags(spark, sf_dir):
    t = F.col("messages")[0]["content"]
    return _documents(spark, sf_dir).select("id", t.rlike("(?i)" + "|".join(V.REFUSALS)).alias("refusal"), t.rlike(V.ENCODING_ERROR).alias("broken"))


def clean_whitespace(spark, sf_dir):
    return _documents(spark, sf_dir).select("id", F.md5(clean.normalize_whitespace(F.col("messages")[0]["content"])).alias("cleaned"))


def clean_all(spark, sf_dir):
    out = clean.clean(_documents(spark, sf_dir))
    return out.select("id", "changed", F.md5(F.coalesce(F.get("messages", F.lit(0))["content"], F.lit(""))).alias("cleaned"))


def quality_label_agreement(spark, sf_dir):
    """How far record scores go with the labels table (an addition of this library)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("string").alias("id"), "quality")
    return quality.analyze(_documents(spark, sf_dir)).join(labels, "id").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


def text_chunks(spark, sf_dir):
    return documents.chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def qa_pairs(spark, sf_dir):
    """Pairs of the conversations written as Q: and A: lines."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role <> 'system'")
    line = F.concat(F.when(F.col("role") == "user", "Q: ").otherwise("A: "), "text")
    docs = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda r: r["line"]), "\n").alias("text"))
    return documents.question_answers(docs, "conv_id")


def _raw(spark, sf_dir, **fields):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("seq"), F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))).alias("raw"))


def _converted(raw):
    good, _ = convert.convert(raw)
    return good.select("seq", "type", F.size("messages").alias("n"), F.md5(F.array_join(F.transform(F.concat("messages", F.coalesce("chosen", F.expr(f"cast(array() as {MESSAGES})")), F.coalesce("rejected", F.expr(f"cast(array() as {MESSAGES})")), F.coalesce("completion", F.expr(f"cast(array() as {MESSAGES})"))), lambda m: F.concat_ws("|", m["role"], m["content"])), "~")).alias("said"), "label")


def convert_alpaca(spark, sf_dir):
    return _converted(_raw(spark, sf_dir, instruction=F.lit("Continue."), input=F.left("text", F.lit(50)), output=F.col("text"), system=F.col("lang")))


def convert_dpo(spark, sf_dir):
    return _converted(_raw(spark, sf_dir, prompt=F.col("source"), chosen=F.col("text"), rejected=F.lit("no")))


def convert_kto(spark, sf_dir):
    return _converted(_raw(spark, sf_dir, prompt=F.col("source"), completion=F.col("text"), label=F.col("doc_id") % 2 == 0))


def convert_sharegpt(spark, sf_dir):
    turn = lambda who, said: F.struct(F.lit(who).alias("from"), said.alias("value"))
    return _converted(_raw(spark, sf_dir, conversations=F.array(turn("human", F.col("source")), turn("gpt", F.col("text"))), system=F.col("lang")))


def detect_formats(spark, sf_dir):
    """Rows of each layout among documents that take turns in four of them."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.col("doc_id") % 4
    raw = (
        F.when(k == 0, F.to_json(F.struct(F.col("source").alias("prompt"), F.col("text").alias("output")))).when(k == 1, F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"))))
        .when(k == 2, F.to_json(F.struct("text"))).otherwise(F.to_json(F.struct("lang", "source")))
    )
    return d.select(convert.classify(raw).alias("format")).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


def _export(framework: str):
    def run(spark, sf_dir):
        return rows(_conversations(spark, sf_dir), Export(framework)).select("id", F.md5("line").alias("line"))

    run.__name__ = "export_" + framework.replace("-", "_")
    return run


def llm_judge_fake(spark, sf_dir):
    """Verdicts of a deterministic stand-in for a model."""

    def chat(messages):
        marks = [len(messages[0]["content"]) // k % 10 + 1 for k in (1, 3, 7)]
        return '```json\n{"helpfulness": %d, "correctness": %d, "clarity": %d, "verdict": "pass"}\n```' % tuple(marks)

    requests = generate.judge_requests(_conversations(spark, sf_dir))
    return generate.judged(requests, generate.run_batch(requests, chat))


def _render(family: str):
    def run(spark, sf_dir):
        return _conversations(spark, sf_dir).select("id", F.md5(templates.render(F.col("messages"), family)).alias("rendered"))

    run.__name__ = "render_" + family.replace("-", "_")
    return run


RENDER = [_render(f) for f in V.CONTROL_TOKENS]
EXPORT = [_export(f) for f in ("canonical", "axolotl", "trl", "llama-factory", "ms-swift", "openai-ft", "alpaca", "sharegpt")]


def queries() -> dict:
    plain = (
        conv_quality_scores, conv_quality_summary, conv_issue_counts, doc_issue_counts, conv_role_counts, conv_overview, split_counts, split_members, filter_search_page, token_estimates,
        token_histogram, exact_dup_groups, exact_dup_kept, near_dup_pairs, near_dup_members, near_dup_groups, decontam_hits, pii_flags, pii_masked, refusal_flags, clean_whitespace, clean_all, quality_label_agreement,
        text_chunks, qa_pairs, convert_alpaca, convert_dpo, convert_kto, convert_sharegpt, detect_formats, llm_judge_fake,
    )
    return {f.__name__: f for f in (*plain, *RENDER, *EXPORT)}


_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_B = r"\b"
_PII = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "ssn": _B + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _B,
    "card": _B + r"[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}" + _B,
    "ip": _B + r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}" + _B,
    "phone": r"(\+[0-9]{1,3}[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
}
_REFUSAL = "|".join(V.REFUSALS).replace("'", "''")
_BROKEN = "â[\u0080€]|Ã[¢©]|�|\\\\x[0-9a-fA-F]{2}"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _tokens_sql(text: str) -> str:
    return " OR ".join(f"contains({text}, '{t}')" for t in V.ALL_CONTROL_TOKENS)


def _turn_issues(source: str, text: str) -> str:
    """(id, at, role, kind, severity) of the checks of plain messages."""
    talk = f"role IN ('user', 'assistant') AND length({text}) "
    rules = [
        ("missing_role", "critical", "role = ''"), ("invalid_role", "high", "role NOT IN ('', 'system', 'developer', 'user', 'assistant', 'tool')"),
        ("empty_field", "critical", f"NOT regexp_matches({text}, '[^' || '{_WS[1:-1]}' || ']')"), ("too_short", "medium", talk + "< 10"), ("too_long", "high", talk + "> 32000"),
        ("refusal_pattern", "high", f"role = 'assistant' AND regexp_matches({text}, '(?i){_REFUSAL}')"),
        *(("pii_detected", "high", f"regexp_matches({text}, '{p}')") for p in _PII.values()),
        ("encoding_error", "medium", f"(regexp_matches({text}, '{_BROKEN}') OR contains({text}, chr(0)))"), ("special_token_conflict", "medium", f"({_tokens_sql(text)})"),
        ("malformed_tool_call", "high", "role = 'tool'"),
    ]
    return " UNION ALL ".join(f"SELECT id, '{kind}' AS type, '{severity}' AS severity FROM {source} WHERE {rule}" for kind, severity, rule in rules)


def _norm(text: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({text}, '')), '{_WS}+', ' ', 'g'))"


def _quality_sql(turns: str) -> str:
    """CTEs up to s (one row per record with its scores) and i (issues), from turns(id, seq, n, role, text)."""
    return f"""
t AS ({turns}),
c AS (SELECT id, any_value(seq) AS seq, count(n) AS turns, coalesce(sum(CASE WHEN role = 'user' THEN length(text) END), 0) AS u, coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS a,
  min(CASE WHEN role = 'user' THEN n END) AS fu, min(CASE WHEN role = 'assistant' THEN n END) AS fa, string_agg(role || chr(2) || {_norm("text")}, chr(1) ORDER BY n) AS key FROM t GROUP BY id),
i AS ({_turn_issues("t", "text")}
  UNION ALL SELECT id, 'incoherent_turn_order', 'medium' FROM c WHERE fa IS NOT NULL AND (fu IS NULL OR fa < fu)
  UNION ALL SELECT id, 'incoherent_turn_order', 'medium' FROM (SELECT id, role, lag(role) OVER (PARTITION BY id ORDER BY n) AS before FROM t) WHERE role = 'user' AND before = 'user'
  UNION ALL SELECT id, 'missing_role', 'high' FROM c WHERE fu IS NULL
  UNION ALL SELECT id, 'missing_role', 'high' FROM c WHERE fa IS NULL
  UNION ALL SELECT id, 'imbalanced_ratio', 'medium' FROM c WHERE u > 0 AND a::DOUBLE / u < 0.1::DOUBLE
  UNION ALL SELECT id, 'imbalanced_ratio', 'low' FROM c WHERE u > 0 AND a::DOUBLE / u > 50
  UNION ALL SELECT id, 'duplicate', 'high' FROM (SELECT id, row_number() OVER (PARTITION BY key ORDER BY seq, id) AS k FROM c) WHERE k > 1),
k AS (SELECT c.*, count(i.id) AS n_issues, count(i.id) FILTER (severity = 'critical') AS n4, count(i.id) FILTER (severity = 'high') AS n3, count(i.id) FILTER (severity = 'medium') AS n2, count(i.id) FILTER (severity = 'low') AS n1
  FROM c LEFT JOIN i ON c.id = i.id GROUP BY ALL),
p AS (SELECT *, (CASE WHEN fu IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END) + (CASE WHEN fa IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END) AS pc,
  greatest(0::DOUBLE, 1::DOUBLE - n4 * 0.3::DOUBLE - n3 * 0.1::DOUBLE) AS pf, greatest(0::DOUBLE, 1::DOUBLE - n2 * 0.15::DOUBLE - n1 * 0.05::DOUBLE) AS pq,
  CASE WHEN u = 0 THEN CASE WHEN a > 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END ELSE
   (CASE WHEN a::DOUBLE / u BETWEEN 1 AND 5 THEN 1::DOUBLE WHEN a::DOUBLE / u < 1 THEN greatest(0.1::DOUBLE, a::DOUBLE / u) ELSE greatest(0.3::DOUBLE, 1::DOUBLE - (a::DOUBLE / u - 5::DOUBLE) / 10::DOUBLE) END)
   * (CASE WHEN u + a < 50 THEN 0.5::DOUBLE WHEN u + a < 100 THEN 0.8::DOUBLE ELSE 1::DOUBLE END) END AS pb FROM k),
s AS (SELECT id, floor((CASE WHEN pb < 0.5::DOUBLE OR n_issues > 0 THEN pc * 0.2::DOUBLE + pf * 0.2::DOUBLE + pb * 0.35::DOUBLE + pq * 0.25::DOUBLE ELSE (pc + pf + pb + pq) / 4::DOUBLE END) * 100::DOUBLE + 0.5::DOUBLE)::INT AS score,
  floor(pc * 1000::DOUBLE + 0.5::DOUBLE) / 10::DOUBLE AS completeness, floor(pf * 1000::DOUBLE + 0.5::DOUBLE) / 10::DOUBLE AS formatting,
  floor(pb * 1000::DOUBLE + 0.5::DOUBLE) / 10::DOUBLE AS length_balance, floor(pq * 1000::DOUBLE + 0.5::DOUBLE) / 10::DOUBLE AS content_quality, n_issues::INT AS n_issues FROM p)"""


_TURNS = "SELECT conv_id::VARCHAR AS id, conv_id AS seq, turn AS n, role, text FROM conversations"
_DOCS = "SELECT doc_id::VARCHAR AS id, doc_id AS seq, 0 AS n, 'user' AS role, coalesce(text, '') AS text FROM documents"
_TABLE = "SELECT type, count(*) AS n, CASE max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity FROM i GROUP BY 1"
_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_SPLIT = """WITH r AS (SELECT doc_id::VARCHAR AS id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id::VARCHAR) AS k, count(*) OVER () AS n FROM documents),
m AS (SELECT id, CASE WHEN k <= greatest(1, floor(n * 0.1::DOUBLE + 0.5::DOUBLE)) THEN 'validation' WHEN k <= greatest(1, floor(n * 0.1::DOUBLE + 0.5::DOUBLE)) + greatest(1, floor(n * 0.05::DOUBLE + 0.5::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM r) """
_GRAM = "list_transform(range(1, len(w) - {0} + 2), lambda i: array_to_string(w[i:i + {0} - 1], ' '))"


def _masked(text: str) -> str:
    for pattern, (_, mask, _) in zip(_PII.values(), V.PII, strict=True):
        text = f"regexp_replace({text}, '{pattern}', '{mask}', 'g')"
    return text


def _fixed(text: str) -> str:
    text = f"replace({text}, chr(0), '')"
    for bad, good in V.ENCODING_FIXES:
        text = f"replace({text}, '{_q(bad)}', '{_q(good)}')"
    return text


def _squeezed(text: str) -> str:
    lines = rf"regexp_replace(regexp_replace({text}, '[ \t]+(\r?\n)', '\1', 'g'), '\n{{3,}}', E'\n\n', 'g')"
    return f"regexp_replace(regexp_replace({lines}, '^{_WS}+', ''), '{_WS}+$', '')"


def oracle_sql() -> dict[str, str]:
    q, d = _quality_sql(_TURNS), _quality_sql(_DOCS)
    out = {
        "conv_quality_scores": f"WITH {q} SELECT * FROM s",
        "conv_quality_summary": f"WITH {q} SELECT count(*) AS scored, floor(avg(score) * 10 + 0.5) / 10 AS mean_score, count(*) FILTER (score >= 90) AS excellent, count(*) FILTER (score >= 70 AND score < 90) AS good, count(*) FILTER (score >= 50 AND score < 70) AS fair, count(*) FILTER (score < 50) AS poor FROM s",
        "conv_issue_counts": f"WITH {q} {_TABLE}",
        "doc_issue_counts": f"WITH {d} {_TABLE}",
        "quality_label_agreement": f"WITH {d} SELECT quality, count(*) AS n, sum(score)::BIGINT AS score FROM s JOIN labels ON s.id = labels.doc_id::VARCHAR GROUP BY 1",
        "conv_role_counts": "SELECT role, count(*) AS n FROM conversations GROUP BY 1",
        "conv_overview": "SELECT count(DISTINCT conv_id) AS n, 0::BIGINT AS with_reasoning, count(*)::DOUBLE / count(DISTINCT conv_id) AS avg_turns, (SELECT sum(e)::BIGINT FROM (SELECT 4 * count(*) + ceil(sum(length(text)) / 4.0) AS e FROM conversations GROUP BY conv_id)) AS estimated_tokens FROM conversations",
        "split_members": _SPLIT + "SELECT * FROM m",
        "split_counts": _SPLIT + "SELECT split, count(*) AS n FROM m GROUP BY 1",
        "filter_search_page": "SELECT conv_id::VARCHAR AS id FROM conversations GROUP BY conv_id HAVING contains(lower(string_agg(text, chr(10) ORDER BY turn)), 'the') ORDER BY id LIMIT 20 OFFSET 5",
        "token_estimates": "SELECT doc_id::VARCHAR AS id, (4 + ceil(length(coalesce(text, '')) / 4.0))::INT AS tokens, ceil(length(coalesce(text, '')) / 3.5)::BIGINT AS approximate FROM documents",
        "token_histogram": "WITH e(edge, low) AS (VALUES (256, -1), (512, 256), (1024, 512), (2048, 1024), (4096, 2048), (8192, 4096), (NULL, 8192)), t AS (SELECT 4 + ceil(length(coalesce(text, '')) / 4.0) AS k FROM documents) SELECT e.edge, count(t.k) AS n FROM e LEFT JOIN t ON t.k > e.low AND (e.edge IS NULL OR t.k <= e.edge) GROUP BY 1",
        "exact_dup_groups": f"SELECT min(doc_id)::VARCHAR AS keep_id, count(*) AS n FROM (SELECT doc_id, {_norm('text')} AS t FROM documents) WHERE t <> '' GROUP BY t HAVING count(*) > 1",
        "exact_dup_kept": f"SELECT doc_id::VARCHAR AS id FROM (SELECT doc_id, t, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS k FROM (SELECT doc_id, {_norm('text')} AS t FROM documents)) WHERE t = '' OR k = 1",
        "near_dup_pairs": f"""WITH t AS (SELECT doc_id, {_WORDS.format(_norm("text"))} AS w FROM documents),
s AS (SELECT min(doc_id) AS id, g FROM (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN {_GRAM.format(3)} ELSE [array_to_string(w, ' ')] END)) AS g FROM t WHERE len(w) > 0) GROUP BY g),
x AS (SELECT id, len(g) AS n, unnest(g) AS f FROM s), p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.f = b.f AND a.id < b.id GROUP BY ALL)
SELECT least(a::VARCHAR, b::VARCHAR) AS a, greatest(a::VARCHAR, b::VARCHAR) AS b, k::DOUBLE / (na + nb - k) AS similarity FROM p WHERE k::DOUBLE / (na + nb - k) >= 0.85""",
        "near_dup_members": f"""WITH t AS (SELECT doc_id, {_WORDS.format(_norm("text"))} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN {_GRAM.format(3)} ELSE [array_to_string(w, ' ')] END)) AS g FROM t WHERE len(w) > 0)
SELECT doc_id::VARCHAR AS id, min(doc_id) OVER (PARTITION BY g)::VARCHAR AS class_id FROM s""",
        "decontam_hits": f"""WITH b AS (SELECT {_WORDS.format("text")} AS w FROM benchmark), bg AS (SELECT DISTINCT unnest({_GRAM.format(13)}) AS gram FROM b WHERE len(w) >= 13),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), dg AS (SELECT doc_id, unnest({_GRAM.format(13)}) AS gram, unnest(range(0, len(w) - 12)) AS pos FROM d WHERE len(w) >= 13)
SELECT doc_id::VARCHAR AS id, 'benchmark' AS benchmark, arg_min(gram, pos) AS gram, min(pos)::INT AS "at" FROM dg JOIN bg USING (gram) GROUP BY doc_id""",
        "pii_flags": "SELECT doc_id::VARCHAR AS id, " + ", ".join(f"regexp_matches(text, '{p}') AS {n}" for n, p in _PII.items()) + " FROM documents",
        "pii_masked": f"SELECT doc_id::VARCHAR AS id, md5({_masked('text')}) AS masked FROM documents",
        "refusal_flags": f"SELECT doc_id::VARCHAR AS id, regexp_matches(text, '(?i){_REFUSAL}') AS refusal, regexp_matches(text, '{_BROKEN}') OR contains(text, chr(0)) AS broken FROM documents",
        "clean_whitespace": f"SELECT doc_id::VARCHAR AS id, md5({_squeezed('text')}) AS cleaned FROM documents",
        "clean_all": f"SELECT id, cleaned <> text AS changed, md5(cleaned) AS cleaned FROM (SELECT doc_id::VARCHAR AS id, text, {_squeezed(_masked(_fixed('text')))} AS cleaned FROM documents)",
    }
    said = "SELECT doc_id AS seq, '{0}' AS type, {1}::INT AS n, md5({2}) AS said, {3}::BOOLEAN AS label FROM documents WHERE regexp_matches(text, '\\S')"
    out |= {
        "convert_alpaca": said.format("sft", 3, "'system|' || lang || '~user|Continue.' || chr(10) || substr(text, 1, 50) || '~assistant|' || text", "NULL"),
        "convert_dpo": said.format("preference", 1, "'user|' || source || '~assistant|' || text || '~assistant|no'", "NULL"),
        "convert_kto": said.format("kto", 1, "'user|' || source || '~assistant|' || text", "(doc_id % 2 = 0)"),
        "convert_sharegpt": said.format("sft", 3, "'system|' || lang || '~user|' || source || '~assistant|' || text", "NULL"),
        "detect_formats": "SELECT CASE doc_id % 4 WHEN 0 THEN 'alpaca' WHEN 1 THEN 'openai-messages' WHEN 2 THEN 'text' END AS format, count(*) AS n FROM documents GROUP BY 1",
        "export_alpaca": "SELECT id, md5('{' || coalesce('\"system\":' || to_json(sys) || ',', '') || '\"instruction\":' || to_json(coalesce(usr, '')) || ',\"output\":' || to_json(coalesce(ast, '')) || '}') AS line FROM (SELECT conv_id::VARCHAR AS id, arg_min(text, turn) FILTER (role = 'system') AS sys, arg_min(text, turn) FILTER (role = 'user') AS usr, arg_min(text, turn) FILTER (role = 'assistant') AS ast FROM conversations GROUP BY 1)",
        "export_sharegpt": "SELECT conv_id::VARCHAR AS id, md5('{\"conversations\":[' || string_agg('{\"from\":\"' || CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END || '\",\"value\":' || to_json(text) || '}', ',' ORDER BY turn) || ']}') AS line FROM conversations GROUP BY 1",
        **{f"export_{f}": "SELECT conv_id::VARCHAR AS id, md5('{\"messages\":[' || string_agg('{\"role\":\"' || role || '\",\"content\":' || to_json(text) || '}', ',' ORDER BY turn) || ']}') AS line FROM conversations GROUP BY 1" for f in ("canonical", "axolotl", "trl", "llama_factory", "ms_swift", "openai_ft")},
    }
    plain = {
        "chatml": ("'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)", "''"),
        "llama3": ("'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>'", "'<|begin_of_text|>'"),
        "llama4": ("'<|header_start|>' || role || '<|header_end|>' || chr(10) || chr(10) || text || '<|eot|>'", "'<|begin_of_text|>'"),
        "kimi_chatml": ("'<|im_' || role || '|>' || role || '<|im_middle|>' || text || '<|im_end|>'", "''"),
        "mistral_tekken": ("CASE role WHEN 'system' THEN '[SYSTEM_PROMPT]' || text || '[/SYSTEM_PROMPT]' WHEN 'user' THEN '[INST]' || text || '[/INST]' ELSE text || '</s>' END", "'<s>'"),
        "deepseek": ("CASE role WHEN 'system' THEN text WHEN 'user' THEN '<｜User｜>' || text ELSE '<｜Assistant｜>' || text || '<｜end▁of▁sentence｜>' END", "'<｜begin▁of▁sentence｜>'"),
        "glm": ("'<|' || role || '|>' || chr(10) || text", "'[gMASK]<sop>'"),
        "granite": ("'<|start_of_role|>' || role || '<|end_of_role|>' || text || '<|end_of_text|>' || chr(10)", "''"),
        "phi4": ("'<|im_start|>' || role || '<|im_sep|>' || text || '<|im_end|>'", "''"),
        "phi4_mini": ("'<|' || role || '|>' || text || '<|end|>'", "''"),
        "harmony": ("CASE WHEN role = 'assistant' THEN '<|start|>assistant<|channel|>final<|message|>' || text || CASE WHEN turn = last THEN '<|return|>' ELSE '<|end|>' END ELSE '<|start|>' || role || '<|message|>' || text || '<|end|>' END", "''"),
        "gemma": ("CASE WHEN role = 'system' THEN '' ELSE '<start_of_turn>' || CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END || chr(10) || CASE WHEN turn = fu AND sys IS NOT NULL THEN sys || chr(10) || chr(10) ELSE '' END || text || '<end_of_turn>' || chr(10) END", "'<bos>'"),
    }
    for name, (turn, before) in plain.items():
        out[f"render_{name}"] = f"WITH x AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS fu, max(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id) AS sys FROM conversations) SELECT conv_id::VARCHAR AS id, md5({before} || string_agg({turn}, '' ORDER BY turn)) AS rendered FROM x GROUP BY conv_id"
    return out
