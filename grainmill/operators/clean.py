"""Cleaning of records: roles, encoding, refusals, personal data, control tokens, white space, empty messages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import text, trim
from grainmill.operators import vocabulary as V
from grainmill.operators.quality import nonempty, role
from grainmill.schema import LISTS, MESSAGE


@dataclass(frozen=True)
class Cleaning:
    """Which steps run."""

    normalize_roles: bool = True
    fix_encoding: bool = True
    remove_refusals: bool = False
    mask_pii: bool = True
    remove_control_tokens: bool = False
    normalize_whitespace: bool = True
    remove_empty: bool = True


def fix_encoding(c: Column) -> Column:
    """NULs go; doubly encoded characters are repaired, in up to four passes."""
    for _ in range(4):
        c = reduce(lambda x, fix: F.replace(x, F.lit(fix[0]), F.lit(fix[1])), V.ENCODING_FIXES, c)
    return c


def strip_refusals(c: Column) -> Column:
    """Refusal openers with the rest of their sentence; trimmed if anything went."""
    out = reduce(lambda x, p: F.regexp_replace(x, rf"(?i){p}[^.]*\.", ""), V.REFUSALS, c)
    return F.when(out == c, c).otherwise(trim(out))


def mask_pii(c: Column) -> Column:
    """Each rule in turn on what the ones before it left."""
    return reduce(lambda x, rule: F.regexp_replace(x, rule[2], rule[1]), V.PII, c)


def strip_tokens(c: Column) -> Column:
    return reduce(lambda x, t: F.replace(x, F.lit(t), F.lit("")), V.ALL_CONTROL_TOKENS, c)


def normalize_whitespace(c: Column) -> Column:
    """No blanks before a line's end, at most two line ends in a row, no white space around."""
    return trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+(?=\r?\n)", ""), r"\n{3,}", "\n\n"))


def clean_text(c: Column, o: Cleaning, refusals: Column | None = None) -> Column:
    if o.fix_encoding:
        c = fix_encoding(F.replace(c, F.lit("\x00"), F.lit("")))
    if o.remove_refusals and refusals is not None:
        c = F.when(refusals, strip_refusals(c)).otherwise(c)
    if o.mask_pii:
        c = mask_pii(c)
    if o.remove_control_tokens:
        c = strip_tokens(c)
    return normalize_whitespace(c) if o.normalize_whitespace else c


def clean(df: DataFrame, o: Cleaning = Cleaning()) -> DataFrame:  # noqa: B008
    """Records with all lists cleaned; `changed` tells whether any message differs."""
    alias = F.create_map(*(F.lit(x) for pair in V.ROLE_ALIASES.items() for x in pair))

    def cleaned(field: str) -> Column:
        def one(m: Column) -> Column:
            named = F.coalesce(F.try_element_at(alias, role(m)), m["role"]) if o.normalize_roles else m["role"]
            speaks = (F.lower(trim(text(named))) == "assistant") & F.lit(field != "rejected")
            return F.struct(named, clean_text(text(m["content"]), o, speaks), F.when(m["reasoning"].isNotNull(), clean_text(m["reasoning"], o)), m["tool_calls"], m["tool_call_id"], m["name"], m["weight"]).cast(MESSAGE)

        out = F.transform(field, one)
        return F.filter(out, nonempty) if o.remove_empty else out

    out = df.select(*df.columns, *(cleaned(f).alias(f"_{f}") for f in LISTS))
    changed = reduce(lambda a, b: a | b, (~F.col(f"_{f}").eqNullSafe(F.col(f)) for f in LISTS))
    return out.withColumn("changed", changed).withColumns({f: F.col(f"_{f}") for f in LISTS}).drop(*(f"_{f}" for f in LISTS))
