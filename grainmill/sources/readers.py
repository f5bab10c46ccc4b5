"""Readers that give raw rows (seq, raw JSON) or documents, whatever the file."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from pathlib import PurePosixPath
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.text import blank, text, trim

EXTENSIONS = {
    "jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "csv": "csv", "tsv": "csv", "parquet": "parquet", "pq": "parquet", "xlsx": "xlsx", "xls": "xlsx",
    "pdf": "pdf", "docx": "docx", "md": "text", "markdown": "text", "txt": "text",
}


def sniff(name: str, head: bytes) -> str:
    """The format of a file by its extension, or else by its first bytes."""
    known = EXTENSIONS.get(PurePosixPath(name).suffix.lower().lstrip("."))
    if known:
        return known
    if head[:4] == b"%PDF":
        return "pdf"
    if head[:4] == b"PAR1":
        return "parquet"
    if head[:2] == b"PK":
        return "docx" if b"word/" in head else "xlsx" if b"xl/" in head else "text"
    body = head.decode("utf-8", "replace").lstrip("﻿").strip()
    if body[:1] in ("{", "["):
        lines = [x for x in body.splitlines() if x.strip()]
        return "jsonl" if len(lines) > 1 and all(x.lstrip().startswith("{") for x in lines[:5]) else "json"
    return "text"


def _numbered(df: DataFrame) -> DataFrame:
    """seq in the order of files and lines, which needs no exchange."""
    return df.withColumn("seq", F.monotonically_increasing_id())


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of files with a JSON value a line; byte order marks, CRLF and blank lines are fine."""
    lines = _numbered(spark.read.text(path)).select("seq", F.regexp_replace(trim(F.col("value")), "^﻿", "").alias("raw")).filter(~blank(F.col("raw")))
    good = F.try_parse_json("raw").isNotNull()
    return lines.filter(good), lines.filter(~good).select("seq", F.concat(F.lit("not JSON: "), F.left("raw", F.lit(80))).alias("error"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of whole-file JSON: an array, {"data": [...]}, or one object; a file of a scalar is an error."""
    v = F.try_parse_json(F.regexp_replace("value", "^﻿", ""))
    data = F.try_variant_get(v, "$.data", "array<variant>")
    rows = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), data, F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.array(v)))
    rows = F.when(rows.isNull(), F.raise_error(F.lit("the file is neither an array nor an object"))).otherwise(rows)
    return _numbered(spark.read.text(path, wholetext=True).select(F.explode(rows).alias("v"))).select("seq", F.to_json("v").alias("raw"))


def guess_delimiter(line: str) -> str:
    return max(",\t;|", key=lambda d: len(next(csv.reader(io.StringIO(line), delimiter=d), [])))


def revived(c):
    """A cell that holds a JSON object or array as that; others as strings."""
    shaped = trim(c).rlike(r"(?s)^(\{.*\}|\[.*\])$")
    return F.coalesce(F.when(shaped, F.try_parse_json(trim(c))), c.cast("variant"))


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Rows of CSV with a header; the delimiter is guessed from the first line."""
    if sep is None:
        first = spark.read.text(path).limit(1).collect()
        sep = guess_delimiter(first[0].value) if first else ","
    df = spark.read.csv(path, header=True, multiLine=True, sep=sep, escape='"', quote='"')
    names = [c.strip().lstrip("﻿") for c in df.columns]
    df = df.toDF(*names).dropna("all")
    return _numbered(df.select(F.to_json(F.struct(*(revived(F.col(f"`{n}`")).alias(n) for n in names))).alias("raw"))).select("seq", "raw")


def read_parquet(spark: SparkSession, path: str | list[str], most: int | None = None) -> DataFrame:
    """Rows of Parquet files, of shards in order up to `most` rows."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    df = df if most is None else df.limit(most)
    return _numbered(df.select(F.to_json(F.struct("*")).alias("raw"))).select("seq", "raw")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path and text of text and markdown files: no byte order mark, LF line ends, trimmed."""
    body = trim(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"\r\n?", "\n"))
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), body.alias("text"))


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file, a blank line between."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p")).strip()


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.udf(docx_text, "string")("content").alias("text"))


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a workbook's first sheet; pandas needs an Excel engine for it."""
    import pandas as pd

    try:
        frame = pd.read_excel(path, sheet_name=0, dtype=object)
    except ImportError as error:
        raise RuntimeError("reading Excel files needs openpyxl") from error
    rows = [(i, json.dumps({k: None if pd.isna(x) else x for k, x in r.items()}, default=str)) for i, r in enumerate(frame.to_dict("records"))]
    return spark.createDataFrame(rows, "seq long, raw string")


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """path and text of PDF files, with pypdf where it is installed."""
    try:
        import pypdf
    except ImportError as error:
        raise RuntimeError("reading PDF files needs pypdf") from error
    text_of = lambda data: "\n\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages)
    return spark.read.format("binaryFile").load(path).select("path", F.udf(text_of, "string")("content").alias("text"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Rows or documents of a file or pattern, by its format."""
    first = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 4096).alias("head")).limit(1).collect()
    if not first:
        raise FileNotFoundError(path)
    readers = {"jsonl": lambda *a: read_jsonl(*a)[0], "json": read_json, "csv": read_csv, "parquet": read_parquet, "xlsx": read_excel, "pdf": read_pdf, "docx": read_docx, "text": read_documents}
    return readers[sniff(first[0].path, bytes(first[0].head))](spark, path)


def benchmark_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """benchmark and text of a file with an item a line; blank lines don't count."""
    return spark.read.text(path).select(F.lit(name).alias("benchmark"), trim(text(F.col("value"))).alias("text")).filter(~blank(F.col("text")))
