"""Fixed values of the record format: roles, control tokens, rules. They are data that results depend on."""

ROLES = ("system", "developer", "user", "assistant", "tool")
ROLE_ALIASES = {
    "system": "system", "developer": "developer", "user": "user", "human": "user", "assistant": "assistant", "gpt": "assistant",
    "ai": "assistant", "bot": "assistant", "model": "assistant", "tool": "tool", "observation": "tool", "function": "tool",
}
CONTROL_TOKENS = {
    "chatml": ("<|im_start|>", "<|im_end|>"),
    "kimi-chatml": ("<|im_system|>", "<|im_user|>", "<|im_assistant|>", "<|im_middle|>", "<|im_end|>"),
    "llama3": ("<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"),
    "llama4": ("<|begin_of_text|>", "<|header_start|>", "<|header_end|>", "<|eot|>"),
    "gemma": ("<start_of_turn>", "<end_of_turn>", "<bos>"),
    "mistral-tekken": ("[INST]", "[/INST]", "[SYSTEM_PROMPT]", "[/SYSTEM_PROMPT]", "[TOOL_CALLS]", "[THINK]", "[/THINK]", "<s>", "</s>"),
    "deepseek": ("<｜begin▁of▁sentence｜>", "<｜User｜>", "<｜Assistant｜>", "<｜end▁of▁sentence｜>", "<think>", "</think>"),
    "harmony": ("<|start|>", "<|channel|>", "<|message|>", "<|end|>", "<|return|>"),
    "glm": ("[gMASK]", "<sop>", "<|system|>", "<|user|>", "<|assistant|>", "<|observation|>"),
    "granite": ("<|start_of_role|>", "<|end_of_role|>", "<|end_of_text|>"),
    "phi4": ("<|im_start|>", "<|im_sep|>", "<|im_end|>"),
    "phi4-mini": ("<|system|>", "<|user|>", "<|assistant|>", "<|end|>"),
}
ALL_CONTROL_TOKENS = tuple(dict.fromkeys(t for own in CONTROL_TOKENS.values() for t in own))
REFUSALS = (
    r"as an ai( language model)?",
    r"i('m| am) (not able|unable|cannot)",
    r"i (can't|cannot|won't|will not) (help|assist|provide)",
    r"i('m| am) sorry,? (but )?i (can't|cannot)",
    r"it('s| is) (not |in)appropriate",
    r"i (don't|do not) have (the ability|access)",
    r"i('m| am) (just )?a(n)? (ai|language model|llm)",
    r"my (programming|guidelines|training)",
)
#: (name, mask, pattern); word boundaries are ASCII, as look-arounds.
_B, _E = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
PII = (
    ("email address", "[EMAIL]", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("SSN", "[SSN]", rf"{_B}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_E}"),
    ("credit card number", "[CARD]", rf"{_B}[0-9]{{4}}[-\s]?[0-9]{{4}}[-\s]?[0-9]{{4}}[-\s]?[0-9]{{4}}{_E}"),
    ("IP address", "[IP]", rf"{_B}[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}{_E}"),
    ("phone number", "[PHONE]", r"(\+[0-9]{1,3}[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"),
)
ENCODING_ERROR = "â[\u0080€]|Ã[¢©]|�|\\x00|\\\\x[0-9a-fA-F]{2}"
ENCODING_FIXES = (
    ("â\u0080\u0099", "'"), ("â€™", "'"), ("â\u0080\u009c", '"'), ("â€œ", '"'), ("â\u0080\u009d", '"'),
    ("â€\u009d", '"'), ("â\u0080\u0094", "—"), ("â€”", "—"), ("â\u0080\u0093", "–"),
    ("â€“", "–"), ("Ã¢", "â"), ("Ã©", "é"), ("�", ""),
)
TOO_SHORT, TOO_LONG = 10, 32000
