"""Explainable quality: issues of each record, component scores, duplicates and summaries, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import blank, half_up, normalize, text, trim
from grainmill.operators import vocabulary as V
from grainmill.operators.tokens import estimated_tokens
from grainmill.schema import ISSUE, LISTS, MESSAGES

SEVERITIES = ("low", "medium", "high", "critical")


def _issue(when: Column, kind: str, severity: str, message: Column | str, index: Column | None = None, field: str | None = None, fix: bool | Column = False) -> Column:
    """An issue, or null where the condition doesn't hold."""
    made = F.struct(
        F.lit(kind), F.lit(severity), message if isinstance(message, Column) else F.lit(message), index if index is not None else F.lit(None), F.lit(field), fix if isinstance(fix, Column) else F.lit(fix)
    ).cast(ISSUE)
    return F.when(when, made)


def _some(*issues: Column) -> Column:
    return F.filter(F.array(*issues), lambda x: x.isNotNull())


def role(m: Column) -> Column:
    return F.lower(trim(text(m["role"])))


def _calls(m: Column) -> Column:
    return F.coalesce(m["tool_calls"], F.expr("cast(array() as array<struct<id:string,name:string,arguments:string>>)"))


def nonempty(m: Column) -> Column:
    """A message with content, tool calls or reasoning."""
    return ~blank(m["content"]) | (F.size(_calls(m)) > 0) | ~blank(m["reasoning"])


def full(messages: Column) -> Column:
    """A list with a message that isn't empty."""
    return F.coalesce(F.exists(messages, nonempty), F.lit(False))


def _either(m: Column, pattern: str) -> Column:
    return text(m["content"]).rlike(pattern) | text(m["reasoning"]).rlike(pattern)


def _ids(messages: Column) -> Column:
    return F.flatten(F.transform(F.filter(messages, lambda m: role(m) == "assistant"), lambda m: F.transform(_calls(m), lambda c: c["id"])))


def _message_issues(field: str, tokens: tuple[str, ...], severity: str) -> Column:
    own = F.coalesce(F.col(field), F.expr(f"cast(array() as {MESSAGES})"))

    def check(m: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{field}["), i.cast("string"), F.lit("]"))
        r, body = role(m), text(m["content"])
        talk = r.isin("user", "assistant")
        refusal = reduce(lambda a, b: a | b, (body.rlike(f"(?i){p}") for p in V.REFUSALS))
        held = F.filter(F.array(*(F.lit(t) for t in tokens)), lambda t: F.contains(body, t) | F.contains(text(m["reasoning"]), t))
        known = _ids(F.slice(own, F.lit(1), i))
        if field != "messages":
            known = F.concat(_ids(F.col("messages")), known)
        call_id = trim(text(m["tool_call_id"]))
        checks = [
            _issue(r == "", "missing_role", "critical", F.concat(F.lit("Missing role in "), at), i, field),
            _issue((r != "") & ~r.isin(*V.ROLES), "invalid_role", "high", F.concat(F.lit('Invalid role "'), r, F.lit('" in '), at), i, field, r.isin(*V.ROLE_ALIASES)),
            _issue(~nonempty(m), "empty_field", "critical", F.concat(F.lit("Empty content in "), at), i, field, True),
            _issue(talk & (F.length(body) < V.TOO_SHORT) & (F.size(_calls(m)) == 0), "too_short", "medium", F.concat(F.lit("Very short text in "), at), i, field),
            _issue(talk & (F.length(body) > V.TOO_LONG), "too_long", "high", F.concat(F.lit("Very long text in "), at), i, field),
            _issue((r == "assistant") & F.lit(field != "rejected") & refusal, "refusal_pattern", "high", F.concat(F.lit("Refusal in "), at), i, field, True),
            *(_issue(_either(m, p), "pii_detected", "high", F.concat(F.lit(f"Possible {name} in "), at), i, field, True) for name, _, p in V.PII),
            _issue(_either(m, V.ENCODING_ERROR), "encoding_error", "medium", F.concat(F.lit("Broken encoding in "), at), i, field, True),
            _issue(F.size(held) > 0, "special_token_conflict", severity, F.concat(F.lit("Control tokens "), F.array_join(held, ", "), F.lit(" in "), at), i, field, True),
            _issue((r == "tool") & (call_id == ""), "malformed_tool_call", "high", F.concat(F.lit("Tool result without a call id in "), at), i, field),
            _issue((r == "tool") & (call_id != "") & ~F.coalesce(F.array_contains(known, call_id), F.lit(False)), "orphan_tool_result", "high", F.concat(F.lit("Tool result of an unknown call in "), at), i, field),
        ]
        bad = F.filter(_calls(m), lambda c: F.try_parse_json(text(c["arguments"])).isNull())
        return F.concat(_some(*checks), F.transform(bad, lambda c: _issue(F.lit(True), "malformed_tool_call", "high", F.concat(F.lit("Arguments aren't JSON in "), at), i, field)))

    return F.flatten(F.transform(own, check))


def _lengths() -> tuple[Column, Column]:
    def total(lists: tuple[str, ...], who: str) -> Column:
        each = (F.aggregate(F.coalesce(F.col(c), F.expr(f"cast(array() as {MESSAGES})")), F.lit(0), lambda n, m: n + F.when(role(m) == who, F.length(text(m["content"]))).otherwise(0)) for c in lists)
        return reduce(lambda a, b: a + b, each)

    return total(("messages",), "user"), total(("messages", "chosen", "completion"), "assistant")


def issues(target: dict | None = None) -> Column:
    """All issues of a record; target: a model's `name`, `family` and `seq_len` for the checks that need one."""
    tokens = V.CONTROL_TOKENS[target["family"]] if target else V.ALL_CONTROL_TOKENS
    per_message = [_message_issues(f, tokens, "high" if target else "medium") for f in LISTS]
    m = F.coalesce(F.col("messages"), F.expr(f"cast(array() as {MESSAGES})"))
    roles = F.transform(m, role)
    user, assistant = F.array_position(roles, "user"), F.array_position(roles, "assistant")
    user_len, assistant_len = _lengths()
    ratio = F.when(user_len > 0, assistant_len.cast("double") / user_len)
    double = F.filter(F.sequence(F.lit(0), F.size(m)), lambda i: (i > 0) & (F.get(roles, i) == "user") & (F.get(roles, i - 1) == "user"))
    kind = F.col("type")
    rest = _some(
        _issue((assistant > 0) & ((user == 0) | (assistant < user)), "incoherent_turn_order", "medium", "Assistant turn before any user turn", (assistant - 1).cast("int"), "messages"),
        _issue(user == 0, "missing_role", "high", "No user message", None, "messages"),
        _issue((kind == "sft") & (assistant == 0), "missing_role", "high", "No assistant message", None, "messages"),
        _issue((kind != "rl") & (ratio < F.lit(0.1)), "imbalanced_ratio", "medium", "Very short response for its prompt"),
        _issue((kind != "rl") & (ratio > 50), "imbalanced_ratio", "low", "Very long response for its prompt"),
        _issue((kind == "preference") & ~full(F.col("chosen")), "empty_field", "critical", "No chosen continuation", None, "chosen"),
        _issue((kind == "preference") & ~full(F.col("rejected")), "empty_field", "critical", "No rejected continuation", None, "rejected"),
        _issue((kind == "preference") & (F.size(m) > 0) & (F.try_element_at(roles, F.lit(-1)) != "user"), "incoherent_turn_order", "high", "The prompt must end with a user turn", F.size(m) - 1, "messages"),
        _issue((kind == "kto") & ~full(F.col("completion")), "empty_field", "critical", "No completion", None, "completion"),
        _issue((kind == "kto") & F.col("label").isNull(), "empty_field", "critical", "No label"),
        _issue((kind == "rl") & blank(F.col("answer")), "empty_field", "critical", "No answer"),
        *([_issue(estimated_tokens() > target["seq_len"], "context_overflow", "critical", f"Longer than {target['name']} trains at")] if target else []),
    )
    return F.concat(
        _some(_issue(F.size(m) == 0, "empty_field", "critical", "No messages", None, "messages")),
        *per_message,
        rest,
        F.transform(double, lambda i: _issue(F.lit(True), "incoherent_turn_order", "medium", "Consecutive user turns", i, "messages")),
    )


def _clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def scored(df: DataFrame, found: str = "issues") -> DataFrame:
    """df with completeness, formatting, length_balance, content_quality (0 to 100) and score, from an issues column."""
    user_len, assistant_len = _lengths()
    roles = F.transform(F.coalesce(F.col("messages"), F.expr(f"cast(array() as {MESSAGES})")), role)
    has = lambda r: F.array_contains(roles, r)
    part = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    n = {s: F.aggregate(found, F.lit(0), _counter(s)) for s in SEVERITIES}
    complete = part(has("user"), 0.5) + (
        F.when(F.col("type") == "preference", part(full(F.col("chosen")), 0.25) + part(full(F.col("rejected")), 0.25))
        .when(F.col("type") == "kto", part(full(F.col("completion")), 0.25) + part(F.col("label").isNotNull(), 0.25))
        .when(F.col("type") == "rl", part(~blank(F.col("answer")), 0.5))
        .otherwise(part(has("assistant"), 0.5))
    )
    ratio, total = assistant_len.cast("double") / F.when(user_len > 0, user_len), user_len + assistant_len
    balance = F.when(ratio.between(1, 5), F.lit(1.0)).when(ratio < 1, F.greatest(F.lit(0.1), ratio)).otherwise(F.greatest(F.lit(0.3), F.lit(1.0) - (ratio - F.lit(5.0)) / F.lit(10.0)))
    balance = balance * F.when(total < 50, F.lit(0.5)).when(total < 100, F.lit(0.8)).otherwise(F.lit(1.0))
    balance = (
        F.when(F.col("type") == "rl", F.when(user_len < 50, F.lit(0.5)).when(user_len < 100, F.lit(0.8)).otherwise(F.lit(1.0)))
        .when(user_len == 0, F.when(assistant_len > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
        .otherwise(balance)
    )
    df = df.withColumns({"_c": _clamp(complete), "_f": _clamp(F.lit(1.0) - n["critical"] * F.lit(0.3) - n["high"] * F.lit(0.1)), "_b": _clamp(balance), "_q": _clamp(F.lit(1.0) - n["medium"] * F.lit(0.15) - n["low"] * F.lit(0.05))})
    c, f, b, q = (F.col(k) for k in ("_c", "_f", "_b", "_q"))
    overall = F.when((b < 0.5) | (F.size(found) > 0), c * F.lit(0.2) + f * F.lit(0.2) + b * F.lit(0.35) + q * F.lit(0.25)).otherwise((c + f + b + q) / F.lit(4.0))
    percent = lambda x: half_up(x * F.lit(1000.0)) / F.lit(10.0)
    return df.withColumns({"completeness": percent(c), "formatting": percent(f), "length_balance": percent(b), "content_quality": percent(q), "score": half_up(_clamp(overall) * F.lit(100.0)).cast("int")}).drop("_c", "_f", "_b", "_q")


def _counter(severity: str):
    return lambda n, x: n + F.when(x["severity"] == severity, 1).otherwise(0)


def duplicate_key() -> Column:
    """What makes two records equal: type, field, role, normalised texts, tool calls, answer and label."""

    def of(field: str) -> Column:
        one = lambda m: F.concat_ws("\x02", F.lit(field), role(m), normalize(m["content"]), normalize(m["reasoning"]), F.array_join(F.transform(_calls(m), lambda c: F.concat_ws("\x03", c["name"], normalize(c["arguments"]))), "\x04"))
        return F.array_join(F.transform(F.coalesce(F.col(field), F.expr(f"cast(array() as {MESSAGES})")), one), "\x01")

    return F.sha2(F.concat_ws("\x05", F.col("type"), *(of(f) for f in LISTS), F.when(F.col("answer").isNotNull(), F.concat(F.lit("a"), normalize(F.col("answer")))), F.col("label").cast("string")), 256)


def analyze(df: DataFrame, target: dict | None = None) -> DataFrame:
    """Records with issues, component scores and score. Without a target model, later copies of a record (by seq) get a duplicate issue.

    Whether a record is a copy needs only its key and order: the least (seq, id) of each key is a partial aggregate, and
    the join back moves one long row a record, so a key of many copies is split as a skewed join.
    """
    df = df.withColumn("issues", issues(target))
    if target is None:
        df = df.withColumn("_key", duplicate_key())
        first = df.groupBy("_key").agg(F.min(F.struct("seq", "id")).alias("_first"))
        df = df.join(first, "_key").withColumn("issues", F.concat("issues", _some(_issue(F.struct("seq", "id") > F.col("_first"), "duplicate", "high", "Same as an earlier example")))).drop("_key", "_first")
    return scored(df)


def summary(reports: DataFrame) -> DataFrame:
    """Scored records, mean score and four score classes, in one row."""
    bucket = lambda low, high, name: F.count_if((F.col("score") >= low) & (F.col("score") < high)).alias(name)
    mean = half_up(F.avg("score") * F.lit(10.0)) / F.lit(10.0)
    return reports.agg(F.count("score").alias("scored"), mean.alias("mean_score"), bucket(90, 101, "excellent"), bucket(70, 90, "good"), bucket(50, 70, "fair"), bucket(0, 50, "poor"))


def issue_table(reports: DataFrame) -> DataFrame:
    """Count and highest severity of each issue type, worst first."""
    rank = F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), F.col("i.severity"))
    each = reports.select(F.explode("issues").alias("i")).groupBy(F.col("i.type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("rank"))
    return each.select("type", "n", F.element_at(F.array(*(F.lit(s) for s in SEVERITIES)), F.col("rank").cast("int")).alias("severity")).orderBy(F.desc(F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), F.col("severity"))), F.desc("n"), "type")


def score_class(score: Column) -> Column:
    """The five classes of the score histogram."""
    return F.when(score < 35, 0).when(score < 55, 1).when(score < 75, 2).when(score < 90, 3).otherwise(4)
