"""Chunks and question-answer pairs of long texts. Both scan a text in order, so they are Arrow UDFs a document."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP = 4000, 200
_ENDS = (". ", ".\n", "! ", "? ")


def chunk_text(body: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Overlapping pieces that end at a paragraph, else a sentence, if one lies past the middle of the window."""
    most = max(1, most)
    overlap = min(max(0, overlap), most - 1)
    if not body.strip():
        return []
    if len(body) <= most:
        return [body.strip()]
    out, start = [], 0
    while start < len(body):
        end = min(start + most, len(body))
        if end < len(body):
            middle = start + most // 2
            paragraph = body.rfind("\n\n", 0, end)
            sentence = max(body.rfind(e, 0, end + 1) for e in _ENDS)
            end = paragraph if paragraph > middle else sentence + 1 if sentence > middle else end
        if piece := body[start:end].strip():
            out.append(piece)
        if end >= len(body):
            break
        start = max(end - overlap, start + 1)
    return out


def _markers(letter: str, word: str) -> re.Pattern:
    head, bold = r"#{1,6}\s*", r"\*\*\s*"
    close = r"(?::\s*\*\*|\*\*\s*:)\s*(.*)"
    forms = (
        rf"{head}{letter}\s*\d*\s*[:.)]\s*(.*)", rf"{head}{letter}\s*\d*\s*", rf"{head}{word}\b\s*\d*\s*[:.)]?\s*(.*)",
        rf"{bold}{letter}\s*\d*\s*{close}", rf"{bold}{word}\s*\d*\s*{close}", rf"{letter}\s*\d*\s*:\s*(.*)", rf"{word}\s*\d*\s*:\s*(.*)",
    )
    return re.compile("|".join(f"(?:{f})$" for f in forms), re.I)


_QUESTION, _ANSWER = _markers("q", "question"), _markers("a", "answer")


def qa_pairs(body: str) -> list[tuple[str, str]]:
    """Questions with their answers; an answer without a question, and a pair with an empty side, don't count."""
    pairs: list[tuple[str, str]] = []
    sides: list[list[str] | None] = [None, None]

    def close() -> None:
        if sides[0] is not None and sides[1] is not None:
            q, a = ("\n".join(s).strip() for s in sides)
            if q and a:
                pairs.append((q, a))
        sides[:] = [None, None]

    for line in body.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n").strip().split("\n"):
        asked, answered = _QUESTION.match(line.strip()), _ANSWER.match(line.strip())
        if asked:
            close()
            sides[0] = [x for x in asked.groups() if x and x.strip()]
        elif answered:
            if sides[0] is not None:
                sides[1] = [x for x in answered.groups() if x and x.strip()]
        elif sides[1] is not None:
            sides[1].append(line)
        elif sides[0] is not None:
            sides[0].append(line)
    close()
    return pairs


def chunks(df: DataFrame, id_column: str = "doc_id", most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """A row for each chunk, with its place."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t or "", most, overlap))

    return df.select(id_column, F.posexplode(cut("text")).alias("place", "chunk"))


def question_answers(df: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """A row for each pair."""

    @F.pandas_udf("array<struct<instruction:string,output:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"instruction": q, "output": a} for q, a in qa_pairs(t or "")])

    return df.select(id_column, F.explode(found("text")).alias("p")).select(id_column, "p.*")
