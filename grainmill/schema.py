"""The record that all operators share: messages of a dataset example, and adapters that make it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOOL_CALL = "struct<id:string,name:string,arguments:string>"
MESSAGE = f"struct<role:string,content:string,reasoning:string,tool_calls:array<{TOOL_CALL}>,tool_call_id:string,name:string,weight:int>"
MESSAGES = f"array<{MESSAGE}>"
TOOLS = "array<struct<name:string,description:string,parameters:string>>"
ISSUE = "struct<type:string,severity:string,message:string,message_index:int,field:string,auto_fixable:boolean>"
#: Columns of a record, with their types and defaults as SQL; `seq` gives the order that "first" refers to.
EXAMPLE = {
    "id": ("string", "uuid()"), "project_id": ("string", "''"), "type": ("string", "'sft'"), "messages": (MESSAGES, "array()"), "chosen": (MESSAGES, "null"),
    "rejected": (MESSAGES, "null"), "completion": (MESSAGES, "null"), "label": ("boolean", "null"), "answer": ("string", "null"), "tools": (TOOLS, "null"),
    "split": ("string", "'train'"), "tags": ("array<string>", "array()"), "flagged": ("boolean", "false"), "reviewed": ("boolean", "false"),
    "quality_score": ("int", "null"), "quality_issues": (f"array<{ISSUE}>", "array()"), "token_count": ("int", "null"), "created_at": ("bigint", "0"),
    "updated_at": ("bigint", "0"), "meta": ("map<string,string>", "map()"), "seq": ("bigint", "0"),
}
LISTS = ("messages", "chosen", "rejected", "completion")


def message(role: Column, content: Column) -> Column:
    """A message of role and content alone."""
    none = [F.lit(None)] * 5
    return F.struct(role, content, *none).cast(MESSAGE)


def examples(df: DataFrame) -> DataFrame:
    """df with every column of a record: what it lacks gets the default, what it has is cast."""
    out = []
    for name, (kind, default) in EXAMPLE.items():
        value = F.expr(f"cast({default} as {kind})")
        out.append((F.coalesce(F.col(name).cast(kind), value) if name in df.columns and default != "null" else F.col(name).cast(kind) if name in df.columns else value).alias(name))
    return df.select(*out)


def from_turns(turns: DataFrame) -> DataFrame:
    """Records of a table of turns (conv_id, turn, role, text)."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    grouped = turns.groupBy("conv_id").agg(rows.alias("rows"))
    return examples(grouped.select(F.col("conv_id").cast("string").alias("id"), F.col("conv_id").alias("seq"), F.transform("rows", lambda r: message(r["role"], r["text"])).alias("messages")))


def from_documents(docs: DataFrame) -> DataFrame:
    """A record of one user message for each document."""
    return examples(docs.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("seq"), F.array(message(F.lit("user"), F.col("text"))).alias("messages")))


def lists() -> Column:
    """All messages of a record, list after list."""
    return F.flatten(F.array(*(F.coalesce(c, F.expr(f"cast(array() as {MESSAGES})")) for c in LISTS)))
