"""Filter, order, page, change and split records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions.text import SPACE, text, trim
from grainmill.schema import LISTS, MESSAGES


@dataclass(frozen=True)
class Filter:
    """All conditions that are set must hold; a null score fails max_score."""

    split: str | None = None
    type: str | None = None
    flagged_only: bool = False
    unreviewed_only: bool = False
    max_score: int | None = None
    with_issues_only: bool = False
    tag: str | None = None
    search: str = ""


def search_text() -> Column:
    """What search looks at: contents of all lists, answer and tags."""
    contents = (F.array_join(F.transform(F.coalesce(F.col(c), F.expr(f"cast(array() as {MESSAGES})")), lambda m: text(m["content"])), "\n") for c in LISTS)
    return F.lower(F.concat_ws("\n", *contents, "answer", F.array_join("tags", "\n")))


def matching(df: DataFrame, f: Filter) -> DataFrame:
    if f.split:
        df = df.filter(F.col("split") == f.split)
    if f.type:
        df = df.filter(F.col("type") == f.type)
    if f.flagged_only:
        df = df.filter("flagged")
    if f.unreviewed_only:
        df = df.filter("not reviewed")
    if f.max_score is not None:
        df = df.filter(F.col("quality_score") <= f.max_score)
    if f.with_issues_only:
        df = df.filter(F.size("quality_issues") > 0)
    if f.tag:
        df = df.filter(F.array_contains("tags", f.tag))
    query = f.search.strip().lower()
    return df.filter(F.contains(search_text(), F.lit(query))) if query else df


def ordered(df: DataFrame) -> DataFrame:
    """Newest first, then by id."""
    return df.orderBy(F.desc("created_at"), "id")


def page(df: DataFrame, f: Filter, offset: int, limit: int) -> tuple[DataFrame, int, int]:
    """A page, and how many records match and exist."""
    found = matching(df, f)
    return ordered(found).offset(offset).limit(limit), found.count(), df.count()


def changed(df: DataFrame, ids: DataFrame, values: dict[str, Column], now: int) -> DataFrame:
    """Set columns, and updated_at, of the records whose id is listed."""
    out = df.join(ids.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left")
    return out.withColumns({k: F.when(F.col("_in"), v).otherwise(F.col(k)) for k, v in {**values, "updated_at": F.lit(now)}.items()}).select(df.columns)


def tagged(df: DataFrame, ids: DataFrame, tag: str, now: int) -> DataFrame:
    """Add a tag where it is absent; a blank tag changes nothing."""
    tag = tag.strip()
    return changed(df, ids, {"tags": F.array_union("tags", F.array(F.lit(tag)))}, now) if tag else df


def deleted(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_anti")


def upserted(df: DataFrame, rows: DataFrame) -> DataFrame:
    """rows in place of the records with the same id."""
    return deleted(df, rows).unionByName(rows)


def duplicated(df: DataFrame, id_: str, new_id: str, now: int) -> DataFrame:
    """df with a copy of one record that names its origin."""
    copy = df.filter(F.col("id") == id_).withColumns({"id": F.lit(new_id), "created_at": F.lit(now), "updated_at": F.lit(now), "meta": F.map_concat("meta", F.create_map(F.lit("duplicatedFrom"), F.lit(id_)))})
    return df.unionByName(copy.select(df.columns))


def project_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


def split_sizes(total: int, validation: float, test: float) -> tuple[int, int]:
    """Records of the validation and test splits: rounded, one at least of more than two records where the ratio isn't 0."""
    least = 1 if total > 2 else 0
    return tuple(max(least, int(total * r + 0.5)) if r > 0 else 0 for r in (validation, test))


def auto_split(df: DataFrame, validation: float, test: float, seed: int = 42) -> DataFrame:
    """Assign splits in the order of a seeded hash of the id: validation, test, then train.

    Counts of the hash's first four digits place the cuts; only records of the two groups that a cut falls in are ranked.
    A null id counts as an empty one; records that repeat an id each keep their row, in any order among themselves.
    """
    total = df.count()
    n_val, n_test = split_sizes(total, validation, test)
    key, group, rank = "__grainmill_key", "__grainmill_group", "__grainmill_rank"  # names of our own beside the record's columns
    keyed = df.withColumn(key, F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f"|{seed}")))).withColumn(group, F.left(key, F.lit(4)))
    before, cuts = 0, {}
    for row in sorted(keyed.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()):  # at most 65536 rows
        for cut in (n_val, n_val + n_test):
            if before < cut <= before + row.n:
                cuts[cut] = (row[group], cut - before)
        before += row.n

    def below(cut: int) -> Column:
        if cut <= 0:
            return F.lit(False)
        at, last = cuts[cut]
        return (F.col(group) < at) | ((F.col(group) == at) & (F.col(rank) <= last))

    edge = F.col(group).isin(*{g for g, _ in cuts.values()}) if cuts else F.lit(False)
    ranked = keyed.filter(edge).withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(key, "id")))
    out = keyed.filter(~edge).withColumn(rank, F.lit(0)).unionByName(ranked)
    return out.withColumn("split", F.when(below(n_val), "validation").when(below(n_val + n_test), "test").otherwise("train")).select(df.columns)


def preview(limit: int = 110) -> tuple[Column, Column]:
    """One-line previews of the first user (else first) and the first assistant message."""
    lists_ = F.concat(*(F.coalesce(F.col(c), F.expr(f"cast(array() as {MESSAGES})")) for c in ("messages", "chosen", "completion")))
    first = lambda r: F.get(F.filter(F.col("messages") if r == "user" else lists_, lambda m: m["role"] == r), F.lit(0))
    clip = lambda c: F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…"))).otherwise(c)
    line = lambda c: clip(trim(F.regexp_replace(text(c), f"[{SPACE}]+", " ")))
    return line(F.coalesce(first("user")["content"], F.get("messages", F.lit(0))["content"])), line(first("assistant")["content"])
