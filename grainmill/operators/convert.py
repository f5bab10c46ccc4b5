"""Recognise the layout of raw JSON rows and convert them to records, and back.

Rows are JSON text in a column `raw`, with `seq` for their order; they need share no schema, so fields are read from a
VARIANT. Nothing is collected but the counts of a bounded sample for detection.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import blank, text, trim
from grainmill.operators.vocabulary import ROLE_ALIASES
from grainmill.schema import MESSAGE, MESSAGES, TOOLS, examples

FORMATS = ("dpo-pairs", "kto-unpaired", "openai-messages", "sharegpt", "alpaca", "text")  # in order of precedence
ALIASES = {
    "instruction": ("instruction", "prompt", "question", "query"),
    "input": ("input", "context"),
    "output": ("output", "response", "completion", "answer"),
    "system": ("system", "system_prompt", "system_message"),
}
PROMPTS = ("prompt", "question", "messages", "input")
REASONING = ("reasoning", "reasoning_content", "thinking")
WEIGHTS = {"dpo-pairs": 0.98, "kto-unpaired": 0.97, "openai-messages": 0.95, "sharegpt": 0.95, "alpaca": 0.8, "text": 0.7}
SAMPLE = 200


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _string(v: Column) -> Column:
    """The value if it is a string."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _is(v: Column, start: str) -> Column:
    return F.startswith(_kind(v), F.lit(start))


def _items(v: Column) -> Column:
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def _first(v: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(_string(_get(v, k)) for k in keys))


def _label(v: Column) -> Column:
    """A boolean, 0, 1, or their words."""
    x = _get(v, "label")
    word = F.lower(F.try_variant_get(x, "$", "string"))
    return F.when(_is(x, "BOOLEAN"), F.try_variant_get(x, "$", "boolean")).when(word.isin("1", "true"), True).when(word.isin("0", "false"), False)


def _messages_like(v: Column) -> Column:
    has = lambda m, k: _get(m, k).isNotNull()
    one = lambda m: _string(_get(m, "role")).isNotNull() & (has(m, "content") | has(m, "tool_calls") | has(m, "toolCalls"))
    own = _items(v)
    return F.coalesce((F.size(own) > 0) & F.forall(own, one), F.lit(False))


def classify(raw: Column) -> Column:
    """The format of a row of JSON text, or null."""
    return _format(F.try_parse_json(raw))


def _format(v: Column) -> Column:
    turns = _items(_get(v, "conversations"))
    prompt = reduce(lambda a, b: a | b, (_is(_get(v, k), "STRING") | _is(_get(v, k), "ARRAY") for k in PROMPTS))
    single = F.size(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))) == 1
    only = F.element_at(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), 1)
    there = lambda k: _get(v, k).isNotNull()
    return (
        F.when(there("chosen") & there("rejected") & prompt, "dpo-pairs")
        .when(there("completion") & _label(v).isNotNull() & (_is(_get(v, "prompt"), "STRING") | _messages_like(_get(v, "messages"))), "kto-unpaired")
        .when(_messages_like(_get(v, "messages")), "openai-messages")
        .when((F.size(turns) > 0) & F.forall(turns, lambda t: _string(_get(t, "from")).isNotNull() & _get(t, "value").isNotNull()), "sharegpt")
        .when(_first(v, ALIASES["instruction"]).isNotNull() & _first(v, ALIASES["output"]).isNotNull(), "alpaca")
        .when((_is(v, "STRING") & ~blank(_string(v))) | (single & _is(only, "STRING")), "text")
    )


@dataclass
class Detected:
    """The dataset's format, how sure that is, and what else was seen."""

    format: str
    confidence: float
    mapping: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def detect(rows: DataFrame) -> Detected:
    """From the first 200 rows by seq: the format with the best share of rows times its specificity, if half the rows have it."""
    head = rows.orderBy("seq").limit(SAMPLE).withColumn("format", classify(F.col("raw")))
    counts = {r.format: r.n for r in head.groupBy("format").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return Detected("unknown", 0.0, warnings=["No rows"])
    weights = dict(WEIGHTS)
    if counts.get("alpaca"):
        v = F.try_parse_json("raw")
        canonical = head.filter("format = 'alpaca'").filter(_string(_get(v, "instruction")).isNotNull() & _string(_get(v, "output")).isNotNull()).count()
        weights["alpaca"] += 0.1 * canonical / counts["alpaca"]
    scores = {f: counts.get(f, 0) / total * weights[f] for f in FORMATS}
    able = [f for f in FORMATS if counts.get(f, 0) / total >= 0.5]
    best = max(able, key=lambda f: scores[f], default=None)
    warnings = [f"{counts[None]} of {total} rows have no known format"] if counts.get(None) else []
    if len([f for f in FORMATS if counts.get(f)]) > 1:
        warnings.append("Rows of several formats")
    mapping = {}
    if best == "alpaca":
        v = F.try_parse_json("raw")
        for name, keys in ALIASES.items():
            used = F.coalesce(*(F.when(_string(_get(v, k)).isNotNull(), k) for k in keys))
            top = head.groupBy(used.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("s")).filter("k is not null").orderBy(F.desc("n"), "s").limit(1).collect()
            mapping |= {r.k: name for r in top}
    return Detected(best or "unknown", round(scores[best] if best else max(scores.values()), 4), mapping, warnings[:8])


def _thought(content: Column) -> tuple[Column, Column]:
    """(content, reasoning) with <think> blocks taken out, unless none holds anything."""
    blocks = F.filter(F.transform(F.regexp_extract_all(content, F.lit(r"(?is)<think>(.*?)</think>"), F.lit(1)), trim), lambda b: b != "")
    return F.when(F.size(blocks) > 0, trim(F.regexp_replace(content, r"(?is)<think>.*?</think>", ""))).otherwise(content), F.when(F.size(blocks) > 0, F.array_join(blocks, "\n\n"))


def _content(v: Column) -> Column:
    """Text of a content value; null if it has none."""
    part = lambda p: F.coalesce(_string(p), F.when(_is(p, "OBJECT"), _string(_get(p, "text"))))
    parts = F.transform(_items(v), part)
    return F.when(_kind(v) == "VOID", "").when(_is(v, "STRING"), _string(v)).when(F.forall(parts, lambda p: p.isNotNull()), F.array_join(parts, ""))


def normalize_role(r: Column) -> Column:
    """The canonical role, or null."""
    known = F.create_map(*(F.lit(x) for pair in ROLE_ALIASES.items() for x in pair))
    return F.try_element_at(known, F.lower(trim(text(r))))


def _calls(v: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        own = F.when(_is(_get(c, "function"), "OBJECT"), _get(c, "function")).otherwise(c)
        args = _get(own, "arguments")
        id_ = F.coalesce(_string(_get(c, "id")), F.concat(F.lit("call_"), F.left(F.md5(F.concat(F.to_json(c), i.cast("string"))), F.lit(12))))
        return F.struct(id_, _string(_get(own, "name")), F.when(_kind(args) == "VOID", "{}").when(_is(args, "STRING"), _string(args)).otherwise(F.to_json(args)))

    return F.transform(_items(v), one)


def _message(role: Column, content: Column, reasoning: Column | None = None, *rest: Column) -> Column:
    """A message, its <think> blocks taken out of assistant content; null where role or content is."""
    said, thought = _thought(content)
    is_assistant = role == "assistant"
    given = reasoning if reasoning is not None else F.lit(None).cast("string")
    why = F.when(is_assistant & thought.isNotNull(), F.concat_ws("\n\n", given, thought)).otherwise(given)
    made = F.struct(role, F.when(is_assistant, said).otherwise(content), why, *(rest or [F.lit(None)] * 4)).cast(MESSAGE)
    return F.when(role.isNotNull() & content.isNotNull(), made)


_BASIC = "struct<role:string,content:string,reasoning:string,calls:array<struct<id:string,name:string,arguments:string>>,call_id:string,name:string,weight:int>"


def _open(items: Column) -> Column:
    """Messages of role/content objects: read each field once, then build."""
    some = lambda m, *keys: F.coalesce(*(F.nullif(_string(_get(m, k)), F.lit("")) for k in keys))

    def basic(m: Column) -> Column:
        weight = F.try_variant_get(_get(m, "weight"), "$", "int")
        return F.struct(
            normalize_role(_string(_get(m, "role"))), _content(_get(m, "content")), _first(m, REASONING), _calls(F.coalesce(_get(m, "tool_calls"), _get(m, "toolCalls"))),
            some(m, "tool_call_id", "toolCallId"), some(m, "name"), F.when(weight.isin(0, 1), weight),
        ).cast(_BASIC)

    return F.transform(F.transform(items, basic), lambda x: _message(x["role"], x["content"], x["reasoning"], x["calls"], x["call_id"], x["name"], x["weight"]))


def _continuation(v: Column) -> Column:
    """Messages of a string, a message or a list of messages."""
    said = F.array(_message(F.lit("assistant"), F.when(~blank(_string(v)), _string(v))))
    items = F.when(F.size(_items(v)) > 0, _items(v)).when(_is(v, "OBJECT"), F.array(v))
    return F.when(_is(v, "STRING"), said).otherwise(_open(items))


def _reasoned(messages: Column, given: Column) -> Column:
    """A row's own reasoning goes to its last assistant message, if that has none."""
    last = F.size(messages) - F.array_position(F.reverse(F.transform(messages, lambda m: m["role"])), "assistant").cast("int")
    return F.when(given.isNull(), messages).otherwise(F.transform(messages, lambda m, i: F.when((i == last) & m["reasoning"].isNull(), m.withField("reasoning", given)).otherwise(m)))


def _tools(v: Column) -> Column:
    def one(t: Column) -> Column:
        own = F.when(_is(_get(t, "function"), "OBJECT"), _get(t, "function")).otherwise(t)
        return F.struct(_string(_get(own, "name")), _string(_get(own, "description")), F.coalesce(F.to_json(_get(own, "parameters")), F.lit("{}")))

    found = F.filter(F.transform(_items(_get(v, "tools")), one).cast(TOOLS), lambda t: t["name"].isNotNull())
    return F.when(F.size(found) > 0, found)


def convert(rows: DataFrame, format: str = "unknown", project_id: str = "", mapping: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, errors): errors have seq, raw and what is wrong. `unknown` takes each row by its own format; mapping gives source fields of an alpaca layout."""
    # an id bars the optimizer from inlining what parses and builds a row into each of its uses, as long as something reads it: the last filter does
    barred = F.monotonically_increasing_id().alias("_row")
    rows = rows.select("seq", "raw", F.try_parse_json("raw").alias("_v"), barred)
    rows = rows.select("*", (_format(F.col("_v")) if format == "unknown" else F.lit(format)).alias("_kind"), F.monotonically_increasing_id().alias("_again"))
    v, kind = F.col("_v"), F.col("_kind")
    mapped = lambda name: F.coalesce(*[_string(_get(v, k)) for k, n in (mapping or {}).items() if n == name], _first(v, ALIASES[name]))
    usable = lambda p: F.when((F.size(_items(p)) > 0) | ~blank(_string(p)), p)
    given = F.when(kind.isin("dpo-pairs", "kto-unpaired"), F.coalesce(*(usable(_get(v, k)) for k in PROMPTS))).when(kind == "openai-messages", _get(v, "messages"))
    turns = F.transform(_items(_get(v, "conversations")), lambda t: F.struct(normalize_role(_string(_get(t, "from"))).alias("role"), _content(_get(t, "value")).alias("content")))
    rows = rows.select(
        "*", given.alias("_given"), F.when(kind == "sharegpt", turns).alias("_turns"), _first(v, ALIASES["system"]).alias("_system"),
        *(F.when(kind == "alpaca", mapped(n)).alias(f"_{n}") for n in ("instruction", "input", "output")), F.monotonically_increasing_id().alias("_third"),
    )
    rows = rows.select("*", _open(_items(F.col("_given"))).alias("_opened"), F.transform("_turns", lambda t: _message(t["role"], t["content"])).alias("_talk"), F.monotonically_increasing_id().alias("_fourth"))
    opened, talk, system = F.col("_opened"), F.col("_talk"), F.when(F.col("_system").isNotNull(), F.array(_message(F.lit("system"), F.col("_system")))).otherwise(F.expr(f"cast(array() as {MESSAGES})"))
    with_system = F.when(F.exists(talk, lambda m: m["role"] == "system"), talk).otherwise(F.concat(system, talk))
    asked = F.when(blank(F.col("_input")), F.col("_instruction")).otherwise(F.concat("_instruction", F.lit("\n"), "_input"))
    alpaca = F.concat(system, F.array(_message(F.lit("user"), F.when(~blank(F.col("_instruction")), asked)), _message(F.lit("assistant"), F.when(~blank(F.col("_output")), F.col("_output")))))
    prompt = F.when(F.size(_items(F.col("_given"))) > 0, opened).otherwise(F.concat(system, F.array(_message(F.lit("user"), _string(F.col("_given"))))))
    only = F.coalesce(_string(v), _string(F.element_at(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), 1)))
    answer = _string(_get(v, "answer"))
    is_rl = (kind == "openai-messages") & answer.isNotNull() & ~F.exists(opened, lambda m: m["role"] == "assistant")
    messages = (
        F.when(kind == "openai-messages", opened).when(kind == "sharegpt", with_system).when(kind == "alpaca", alpaca)
        .when(kind.isin("dpo-pairs", "kto-unpaired"), F.when(F.col("_given").isNotNull(), prompt)).when(kind == "text", F.array(_message(F.lit("user"), F.when(~blank(only), only))))
    )
    out = rows.select(
        barred, "seq", "raw", _first(v, REASONING).alias("_thought"), kind.alias("format"), messages.alias("messages"),
        F.when(kind == "dpo-pairs", _continuation(_get(v, "chosen"))).alias("chosen"), F.when(kind == "dpo-pairs", _continuation(_get(v, "rejected"))).alias("rejected"),
        F.when(kind == "kto-unpaired", _continuation(_get(v, "completion"))).alias("completion"), F.when(kind == "kto-unpaired", _label(v)).alias("label"),
        F.when(is_rl, answer).alias("answer"), F.when(kind == "openai-messages", _tools(v)).alias("tools"),
        F.when(kind == "dpo-pairs", "preference").when(kind == "kto-unpaired", "kto").when(is_rl, "rl").otherwise("sft").alias("type"),
    )
    broken = lambda c: F.coalesce(F.exists(c, lambda m: m.isNull()), F.lit(False))
    missing = lambda c, k: (F.col("format") == k) & F.col(c).isNull()
    error = (
        F.when(F.col("format").isNull(), "no known format").when(F.col("messages").isNull(), "no messages").when(broken("messages"), "a message without a known role or content")
        .when(missing("chosen", "dpo-pairs") | missing("rejected", "dpo-pairs") | broken("chosen") | broken("rejected"), "no usable chosen or rejected continuation")
        .when(missing("completion", "kto-unpaired") | broken("completion"), "no usable completion").when(missing("label", "kto-unpaired"), "no label")
    )
    reasoned = F.when(F.col("format").isin("openai-messages", "sharegpt", "alpaca"), _reasoned(F.col("messages"), F.col("_thought"))).otherwise(F.col("messages"))
    out = out.withColumns({"error": error, "messages": reasoned, "_row": F.monotonically_increasing_id()})
    made = F.col("_row") >= 0  # of every row; without it the filter would be moved to the scan, with all of the above in it hundreds of times
    good = out.filter(made & F.col("error").isNull()).select(F.sha2(F.concat_ws("|", "seq", "raw"), 256).alias("id"), F.lit(project_id).alias("project_id"), "seq", "type", "messages", "chosen", "rejected", "completion", "label", "answer", "tools")
    return examples(good), out.filter(made & F.col("error").isNotNull()).select("seq", "raw", F.concat(F.lit("Row "), F.col("seq").cast("string"), F.lit(": "), "error").alias("error"))
