"""Chat templates: a conversation as the text that each model family reads, as one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions.text import text
from grainmill.schema import MESSAGES

TOOL_STYLE = {
    "chatml": "hermes", "kimi-chatml": "hermes", "llama3": "llama-ipython", "llama4": "llama-ipython", "gemma": "hermes", "mistral-tekken": "mistral",
    "deepseek": "openai", "harmony": "harmony-ts", "glm": "glm", "granite": "openai", "phi4": "openai", "phi4-mini": "openai",
}


def _c(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _json(c: Column) -> Column:
    """A string as JSON text; null stays null."""
    quoted = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def _arguments(c: Column) -> Column:
    """Arguments that are JSON go in as they are, without white space between; others as a string."""
    parsed = F.try_parse_json(c)
    return F.when(parsed.isNotNull(), F.to_json(parsed)).otherwise(_json(c))


def tool_call_text(calls: Column, style: str) -> Column:
    """Tool calls in one of seven styles; empty for none."""
    name, args, id_ = (lambda c: text(c["name"])), (lambda c: text(c["arguments"])), (lambda c: text(c["id"]))
    forms: dict[str, tuple[Callable[[Column], Column], str, str, str]] = {
        "hermes": (lambda c: _c('<tool_call>\n{"name":', _json(name(c)), ',"arguments":', _arguments(args(c)), "}\n</tool_call>"), "\n", "", ""),
        "mistral": (lambda c: _c('{"name":', _json(name(c)), ',"arguments":', _arguments(args(c)), ',"id":', _json(id_(c)), "}"), ",", "[TOOL_CALLS][", "]"),
        "openai": (lambda c: _c('{"id":', _json(id_(c)), ',"type":"function","function":{"name":', _json(name(c)), ',"arguments":', _json(args(c)), "}}"), ",", "[", "]"),
        "glm": (lambda c: _c(name(c), "\n", args(c)), "\n", "", ""),
        "llama-ipython": (lambda c: _c('{"name":', _json(name(c)), ',"parameters":', _arguments(args(c)), "}"), "\n", "", ""),
        "harmony-ts": (lambda c: _c("<|channel|>commentary to=functions.", name(c), "<|message|>", args(c)), "\n", "", ""),
    }
    if style == "none":
        return F.lit("")
    one, between, before, after = forms[style]
    return F.when(F.size(calls) > 0, _c(before, F.array_join(F.transform(calls, one), between), after)).otherwise("")


def think(family: str, reasoning: Column) -> Column:
    """Reasoning in a family's inline delimiters."""
    return _c("[THINK]", reasoning, "[/THINK]") if family == "mistral-tekken" else _c("<think>\n", reasoning, "\n</think>\n\n")


def inline_reasoning(m: Column, family: str) -> Column:
    """Content with the reasoning in front, if there is any."""
    return F.when(text(m["reasoning"]) != "", _c(think(family, m["reasoning"]), text(m["content"]))).otherwise(text(m["content"]))


def _body(m: Column, family: str) -> Column:
    said = inline_reasoning(m, family)
    called = tool_call_text(m["tool_calls"], TOOL_STYLE[family])
    with_calls = F.when(F.size(F.coalesce(m["tool_calls"], F.array())) == 0, said).when(said == "", called).otherwise(_c(said, "\n", called))
    return F.when(m["role"] == "assistant", with_calls).otherwise(text(m["content"]))


def _label(m: Column, tool: str) -> Column:
    return F.when(m["role"] == "developer", "system").when(m["role"] == "tool", tool).otherwise(m["role"])


def _folded(messages: Column) -> Column:
    """System texts in front of the first user message, or as one of their own."""
    system = F.filter(messages, lambda m: m["role"].isin("system", "developer"))
    rest = F.filter(messages, lambda m: ~m["role"].isin("system", "developer"))
    said = F.array_join(F.transform(system, lambda m: text(m["content"])), "\n\n")
    at = F.array_position(F.transform(rest, lambda m: m["role"]), "user")
    own = F.array(F.struct(F.lit("user"), said, *([F.lit(None)] * 5))).cast(MESSAGES)
    joined = F.transform(rest, lambda m, i: F.when(i == at - 1, m.withField("content", _c(said, "\n\n", text(m["content"])))).otherwise(m))
    return F.when(F.size(system) == 0, messages).when(at == 0, F.concat(own, rest)).otherwise(joined)


def _harmony(m: Column, last: Column) -> Column:
    head = F.when(m["role"] == "tool", _c("functions.", F.coalesce(m["name"], F.lit("tool")))).otherwise(m["role"])
    reasoning = F.when(text(m["reasoning"]) != "", _c("<|start|>assistant<|channel|>analysis<|message|>", m["reasoning"], "<|end|>")).otherwise("")
    calls = F.coalesce(F.array_join(F.transform(m["tool_calls"], lambda c: _c("<|start|>assistant<|channel|>commentary to=functions.", text(c["name"]), "<|message|>", text(c["arguments"]), "<|end|>")), ""), F.lit(""))
    final = F.when(text(m["content"]) != "", _c("<|start|>assistant<|channel|>final<|message|>", m["content"], F.when(last, "<|return|>").otherwise("<|end|>"))).otherwise("")
    return F.when(m["role"] == "assistant", F.concat(reasoning, calls, final)).otherwise(_c("<|start|>", head, "<|message|>", text(m["content"]), "<|end|>"))


def render(messages: Column, family: str, *, include_reasoning: bool = True, strip_prior_thinking: bool = False, generation_prompt: bool = False) -> Column:
    """The conversation in the family's format."""
    none = F.expr(f"cast(array() as {MESSAGES})")
    messages = F.coalesce(messages, none)
    n = F.size(messages)
    last = n - F.array_position(F.reverse(F.transform(messages, lambda m: m["role"])), "assistant").cast("int")
    keep = lambda m, i: (m["role"] == "assistant") & F.lit(include_reasoning) & ((i == last) if strip_prior_thinking else F.lit(True))
    messages = F.transform(messages, lambda m, i: m.withField("reasoning", F.when(keep(m, i), m["reasoning"])))

    def turns(one: Callable[..., Column], of: Column = messages) -> Column:
        return F.array_join(F.transform(of, one), "")

    def plain(before: str, between: str, after: str, tool: str) -> Column:
        return turns(lambda m: _c(before, _label(m, tool), between, _body(m, family), after))

    if family == "chatml":
        out, prompt = plain("<|im_start|>", "\n", "<|im_end|>\n", "tool"), "<|im_start|>assistant\n"
    elif family == "kimi-chatml":
        head = lambda m: F.when(m["role"] == "user", "<|im_user|>user").when(m["role"] == "assistant", "<|im_assistant|>assistant").when(m["role"] == "tool", "<|im_system|>tool").otherwise("<|im_system|>system")
        out, prompt = turns(lambda m: _c(head(m), "<|im_middle|>", _body(m, family), "<|im_end|>")), "<|im_assistant|>assistant<|im_middle|>"
    elif family in ("llama3", "llama4"):
        start, end, stop = ("<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>") if family == "llama3" else ("<|header_start|>", "<|header_end|>", "<|eot|>")
        out, prompt = _c("<|begin_of_text|>", plain(start, f"{end}\n\n", stop, "ipython")), f"{start}assistant{end}\n\n"
    elif family == "gemma":
        label = lambda m: F.when(m["role"] == "assistant", "model").otherwise("user")
        out, prompt = _c("<bos>", turns(lambda m: _c("<start_of_turn>", label(m), "\n", _body(m, family), "<end_of_turn>\n"), _folded(messages))), "<start_of_turn>model\n"
    elif family == "mistral-tekken":
        out, prompt = _c("<s>", turns(lambda m: F.when(m["role"] == "user", _c("[INST]", text(m["content"]), "[/INST]")).when(m["role"] == "assistant", _c(_body(m, family), "</s>")).when(m["role"] == "tool", _c("[TOOL_RESULTS]", text(m["content"]), "[/TOOL_RESULTS]")).otherwise(_c("[SYSTEM_PROMPT]", text(m["content"]), "[/SYSTEM_PROMPT]")))), ""
    elif family == "deepseek":
        out = _c("<｜begin▁of▁sentence｜>", turns(lambda m: F.when(m["role"].isin("user", "tool"), _c("<｜User｜>", text(m["content"]))).when(m["role"] == "assistant", _c("<｜Assistant｜>", _body(m, family), "<｜end▁of▁sentence｜>")).otherwise(text(m["content"]))))
        prompt = "<｜Assistant｜>"
    elif family == "harmony":
        out, prompt = turns(lambda m, i: _harmony(m, (i == n - 1) & F.lit(not generation_prompt))), "<|start|>assistant"
    elif family == "glm":
        out, prompt = _c("[gMASK]<sop>", plain("<|", "|>\n", "", "observation")), "<|assistant|>"
    elif family == "granite":
        out, prompt = plain("<|start_of_role|>", "<|end_of_role|>", "<|end_of_text|>\n", "tool_response"), "<|start_of_role|>assistant<|end_of_role|>"
    elif family == "phi4":
        out, prompt = plain("<|im_start|>", "<|im_sep|>", "<|im_end|>", "tool"), "<|im_start|>assistant<|im_sep|>"
    elif family == "phi4-mini":
        who = lambda m: F.when(m["role"] == "assistant", "assistant").when(m["role"].isin("user", "tool"), "user").otherwise("system")
        out, prompt = turns(lambda m: _c("<|", who(m), "|>", _body(m, family), "<|end|>")), "<|assistant|>"
    else:
        raise ValueError(f"unknown family: {family}")
    return _c(out, prompt) if generation_prompt else out
