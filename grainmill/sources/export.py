"""Rows for trainers, as JSON text columns, and bundles of files."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import text
from grainmill.operators.templates import _arguments, _c, _json, tool_call_text
from grainmill.schema import MESSAGES

UNSUPPORTED = {"llama-factory": ("rl",), "openai-ft": ("kto", "rl"), "alpaca": ("kto", "rl"), "sharegpt": ("preference", "kto", "rl")}
FRAMEWORKS = ("canonical", "axolotl", "trl", "unsloth", "llama-factory", "ms-swift", "openai-ft", "alpaca", "sharegpt")


@dataclass(frozen=True)
class Export:
    """Options of an export; open and close are the model's reasoning delimiters, field_reasoning puts it in a field of its own."""

    framework: str = "canonical"
    type: str = "sft"
    include_reasoning: bool = True
    strip_prior_thinking: bool = False
    include_system: bool = True
    split_files: bool = True
    open: str = "<think>"
    close: str = "</think>"
    field_reasoning: bool = False
    tool_style: str = "hermes"


def supported(framework: str, type_: str) -> bool:
    return framework in FRAMEWORKS and type_ not in UNSUPPORTED.get(framework, ())


def _own(c: str) -> Column:
    return F.coalesce(F.col(c), F.expr(f"cast(array() as {MESSAGES})"))


def prepared(messages: Column, o: Export, final: bool = True) -> Column:
    """Without system messages if so asked, reasoning only where it is kept; a prompt has no final turn."""
    kept = messages if o.include_system else F.filter(messages, lambda m: ~m["role"].isin("system", "developer"))
    last = F.size(kept) - F.array_position(F.reverse(F.transform(kept, lambda m: m["role"])), "assistant").cast("int") if final else F.lit(-1)
    keep = lambda m, i: (m["role"] == "assistant") & F.lit(o.include_reasoning) & ((i == last) if o.strip_prior_thinking else F.lit(True))
    return F.transform(kept, lambda m, i: m.withField("reasoning", F.when(keep(m, i) & (text(m["reasoning"]) != ""), m["reasoning"])))


def _inline(m: Column, o: Export) -> Column:
    body = text(m["content"])
    if o.open.startswith("["):
        said = _c(o.open, text(m["reasoning"]), o.close, body)
    else:
        block = _c(o.open, "\n", text(m["reasoning"]), "\n", o.close)
        said = F.when(body == "", block).otherwise(_c(block, "\n\n", body))
    return F.when(m["reasoning"].isNotNull(), said).otherwise(body)


def _call(c: Column) -> Column:
    return F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function"))


def canonical(messages: Column, o: Export, final: bool = True, weight: str = "all") -> Column:
    """Messages as structs of the chat format; nulls vanish in JSON."""

    def one(m: Column) -> Column:
        kept = m["weight"] if weight == "all" else F.when((m["role"] == "assistant") & F.lit(weight == "assistant"), m["weight"])
        return F.struct(
            m["role"].alias("role"), (text(m["content"]) if o.field_reasoning else _inline(m, o)).alias("content"), F.when(F.lit(o.field_reasoning), m["reasoning"]).alias("thinking"),
            F.when(F.size(m["tool_calls"]) > 0, F.transform(m["tool_calls"], _call)).alias("tool_calls"), m["tool_call_id"].alias("tool_call_id"), m["name"].alias("name"), kept.alias("weight"),
        )

    return F.transform(prepared(messages, o, final), one)


def flat(messages: Column, o: Export, final: bool = True) -> Column:
    """All turns as one text, empty ones left out."""
    style = "hermes" if o.tool_style == "none" else o.tool_style

    def one(m: Column) -> Column:
        called = F.coalesce(tool_call_text(m["tool_calls"], style), F.lit(""))
        return F.when(called == "", _inline(m, o)).when(_inline(m, o) == "", called).otherwise(_c(_inline(m, o), "\n", called))

    return F.array_join(F.filter(F.transform(prepared(messages, o, final), one), lambda t: t != ""), "\n\n")


def _tools_json(name_only: bool = False) -> Column:
    """Tool definitions as JSON text, their parameters spliced in as they are."""
    one = lambda t: _c('{"name":', _json(text(t["name"])), *(["," + '"description":', _json(text(t["description"]))] if name_only else [F.when(t["description"].isNotNull(), _c(',"description":', _json(text(t["description"])))).otherwise("")]), ',"parameters":', _arguments(text(t["parameters"])), "}")
    whole = lambda t: one(t) if name_only else _c('{"type":"function","function":', one(t), "}")
    return F.when(F.size("tools") > 0, _c("[", F.array_join(F.transform("tools", whole), ","), "]"))


def _object(*fields: tuple[str, Column]) -> Column:
    """A JSON object of (key, JSON text); null values are left out."""
    return _c("{", F.concat_ws(",", *(_c(f'"{k}":', v) for k, v in fields)), "}")


def _lf(messages: Column, o: Export, final: bool = True) -> Column:
    def one(m: Column) -> Column:
        calls = F.transform(m["tool_calls"], lambda c: _c('{"name":', _json(text(c["name"])), ',"arguments":', _arguments(text(c["arguments"])), "}"))
        joined = F.when(F.size(calls) == 1, F.get(calls, F.lit(0))).otherwise(_c("[", F.array_join(calls, ","), "]"))
        called = (m["role"] == "assistant") & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0)
        role = F.when(called, "function_call").when(m["role"] == "developer", "system").when(m["role"] == "tool", "observation").otherwise(m["role"])
        return F.struct(role.alias("role"), F.when(called, joined).otherwise(_inline(m, o)).alias("content"))

    return F.transform(prepared(messages, o, final), one)


def _legacy(m: Column) -> Column:
    body = text(m["content"])
    block = _c("<think>", text(m["reasoning"]), "</think>")
    return F.when(text(m["reasoning"]) == "", body).when(body == "", block).otherwise(_c(block, "\n", body))


def row(o: Export) -> Column:
    """A record of the chosen type as one line of JSON for the framework."""
    if not supported(o.framework, o.type):
        raise ValueError(f"{o.framework} has no {o.type} format")
    js = lambda c: F.to_json(c)
    prompt, label, answer = _own("messages"), F.coalesce(F.col("label"), F.lit(True)).cast("string"), _json(text(F.col("answer")))
    tools = ("tools", _tools_json())
    if o.framework == "canonical":
        some = lambda c: (c, F.when(F.size(c) > 0, js(canonical(_own(c), o))))
        return _object(("messages", js(canonical(prompt, o, o.type == "sft"))), some("chosen"), some("rejected"), some("completion"), ("label", F.col("label").cast("string")), ("answer", F.when(F.col("answer").isNotNull(), answer)), tools)
    if o.framework in ("axolotl", "trl", "unsloth"):
        if o.type == "sft":
            return _object(("messages", js(canonical(prompt, o))), tools)
        form = (lambda m, final=True: _json(flat(m, o, final))) if o.framework == "axolotl" else (lambda m, final=True: js(canonical(m, o, final)))
        rest = {"preference": [("chosen", form(_own("chosen"))), ("rejected", form(_own("rejected")))], "kto": [("completion", form(_own("completion"))), ("label", label)], "rl": [("answer", answer)]}
        return _object(("prompt", form(prompt, False)), *rest[o.type])
    if o.framework == "llama-factory":
        said = lambda c: js(F.struct(F.lit("assistant").alias("role"), flat(_own(c), o).alias("content")))
        own = ("tools", _json(_tools_json(True)))
        if o.type == "sft":
            return _object(("messages", js(_lf(prompt, o))), own)
        if o.type == "preference":
            return _object(("messages", js(_lf(prompt, o, False))), ("chosen", said("chosen")), ("rejected", said("rejected")), own)
        return _object(("messages", js(F.concat(_lf(prompt, o, False), _lf(_own("completion"), o)))), ("label", label), own)
    if o.framework == "ms-swift":
        o = Export(**{**o.__dict__, "open": "<think>", "close": "</think>", "field_reasoning": False})
        both = lambda c: js(F.concat(canonical(prompt, o, False), canonical(_own(c), o)))
        fields = {"sft": [("messages", js(canonical(prompt, o)))], "preference": [("messages", both("chosen")), ("rejected_response", _json(flat(_own("rejected"), o)))], "kto": [("messages", both("completion")), ("label", label)], "rl": [("messages", js(canonical(prompt, o, False))), ("solution", answer)]}
        return _object(*fields[o.type], ("tools", _json(_tools_json())))
    if o.framework == "openai-ft":
        o = Export(**{**o.__dict__, "field_reasoning": False})
        if o.type == "sft":
            parallel = F.exists("messages", lambda m: F.size(m["tool_calls"]) > 1)
            return _object(("messages", js(canonical(prompt, o, True, "assistant"))), tools, ("parallel_tool_calls", F.when((F.size("tools") > 0) & ~F.coalesce(parallel, F.lit(False)), "false")))

        def last(c: str) -> Column:
            all_ = canonical(_own(c), o, True, "none")
            chosen = F.coalesce(F.try_element_at(F.filter(all_, lambda m: m["role"] == "assistant"), F.lit(-1)), F.try_element_at(all_, F.lit(-1)))
            return F.when(chosen.isNull(), '[{"role":"assistant","content":""}]').otherwise(js(F.array(chosen.withField("role", F.lit("assistant")))))

        return _object(("input", _object(("messages", js(canonical(prompt, o, False, "none"))), tools)), ("preferred_output", last("chosen")), ("non_preferred_output", last("rejected")))
    kept = prepared(prompt, o)
    if o.framework == "sharegpt":
        who = lambda m: F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").when(m["role"] == "developer", "system").otherwise(m["role"])
        return _object(("conversations", js(F.transform(kept, lambda m: F.struct(who(m).alias("from"), _legacy(m).alias("value"))))))
    first = lambda ms, r: F.get(F.filter(ms, lambda m: m["role"] == r), F.lit(0))
    spoken = F.coalesce(first(kept, "assistant"), first(prepared(_own("chosen"), o), "assistant"), first(prepared(_own("completion"), o), "assistant"))
    return _object(("system", _json(first(kept, "system")["content"])), ("instruction", _json(text(first(kept, "user")["content"]))), ("output", _json(F.when(spoken.isNotNull(), _legacy(spoken)).otherwise(""))))


def rows(df: DataFrame, o: Export) -> DataFrame:
    """id, split and line of the records of the export's type."""
    return df.filter(F.col("type") == o.type).select("id", "split", row(o).alias("line"))


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "dataset"


def bundle(df: DataFrame, o: Export, path: str, name: str = "dataset") -> dict:
    """Write the lines below path, a folder for each split if so asked, and return the counts that go with them."""
    out = rows(df, o)
    if o.split_files:
        out.select("split", "line").write.partitionBy("split").text(path)
    else:
        out.select("line").write.text(path)
    by = lambda frame, c: {r[c]: r.n for r in frame.groupBy(c).agg(F.count(F.lit(1)).alias("n")).collect()}
    types, splits = by(df, "type"), by(out, "split")
    return {"name": slug(name), "framework": o.framework, "type": o.type, "provided": sum(types.values()), "exported": sum(splits.values()), "byType": types, "bySplit": splits}


def dataset_info(o: Export, name: str) -> str:
    """The dataset entry that describes a LLaMA-Factory file."""
    columns = {"messages": "messages", "tools": "tools"} | ({"chosen": "chosen", "rejected": "rejected"} if o.type == "preference" else {"kto_tag": "label"} if o.type == "kto" else {})
    tags = {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant", "observation_tag": "observation", "function_tag": "function_call", "system_tag": "system"}
    return json.dumps({slug(name): {"file_name": f"{slug(name)}_train.jsonl", "formatting": "sharegpt", **({"ranking": True} if o.type == "preference" else {}), "columns": columns, "tags": tags}}, indent=2)
