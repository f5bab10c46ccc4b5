"""Personal data by fixed patterns and by bootstrapped contextual extraction, in DataFrame functions alone.

The fixed (base) patterns find e-mail addresses, IP addresses, card numbers and phone numbers: leftmost and not
overlapping within a kind, a match that fails its check (octets, Luhn, digits) is dropped and not retried. These are
the seeds. The words around a seed and its own written form (digits as 9, runs of letters as a) make lexical patterns, and
all identifier-like tokens that fit one are instances: edges of a pattern-instance graph. In each round a (pattern, kind) scores the share of its distinct
instances, of those that pass the kind's check, that are known to be of the kind; those with support and confidence are trusted, an unknown instance scores
1 - prod(1 - confidence) over the trusted patterns it stands in, and accepted instances count as known in the next
round, until a round accepts nothing new. At last every occurrence of an accepted identifier is a span of its kind, with
or without words before it: two words since the match before are needed only to learn and score patterns of context.
An accepted instance must also pass its kind's check (octets, Luhn) or, as a phone, have 7 digits or more. So numbers are
found that a base match swallowed and dropped, as two cards in a row, or that are written as no base pattern allows.

An instance is a token without blanks or, for numbers written in groups ('555 123 4567'), several tokens between spaces.
No kind has more than MOST digits, and a number is written in at most GROUPS groups. A whole run of groups, none of which could be a
number on its own, is learned and scored as one instance; any part of a run can be an occurrence.

Regular expressions are possessive or anchored at the start of a run, positions are summed in groups, and tokens that
overlap a seed are found by windows over sorted rows, so the work grows in proportion to a text's length. Null text counts as empty. Rows that repeat a doc_id and text get equal rows; an empty table
gives an empty result; other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with starts bound to the first character of a run or the end of the match before.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TOKEN, TOKEN_HINT = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+", r"[0-9@]"
#: A group of digits that another can follow, and one that can follow another.
INNER, OUTER = r"^[+(]{0,2}[0-9](?:[0-9().-]*[0-9)])?$", r"^\(?[0-9](?:[0-9().-]*[0-9)])?[\p{Punct}&&[^@+(-]]*$"
NEAR, GROUP, LEAST_DIGITS, MOST, GROUPS = 80, 64, 7, 19, 6
_SPAN = "array<struct<start:long,kind:int,end:long>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc + F.element_at(F.when(i % 2 == 0, F.array(*(F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))).otherwise(F.array(*(F.lit(v) for v in range(10)))), F.substring(back, i, F.lit(1)).cast("int") + 1),
    )
    return total % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return F.when(F.length(_digits(x)).between(14, 19), _luhn(_digits(x))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def _checked(kind: str) -> Column:
    return F.filter(kind, lambda s: _valid(kind, s["token"]))


def _located(found: Column, pieces: Column) -> Column:
    """Of matches and the text between them: array of (token, left, right, start, end), left and right the text near by."""
    steps = F.transform(
        found,
        lambda m, i: F.struct(m.alias("token"), F.element_at(pieces, i + 1).alias("before"), F.element_at(pieces, i + 2).alias("after")),
    )
    steps = F.transform(
        steps,
        lambda s: F.struct(
            s["token"].alias("token"), F.substring(s["before"], -NEAR, NEAR).alias("left"), F.substring(s["after"], 1, NEAR).alias("right"),
            F.length(s["before"]).cast("long").alias("gap"), F.length(s["token"]).cast("long").alias("size"),
        ),
    )
    return steps


def _grouped(steps: Column) -> Column:
    # get() takes an element at once, where slice() would copy the whole array each time
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / GROUP).cast("int")), lambda g: F.transform(F.sequence(g * GROUP, F.least(g * GROUP + GROUP, F.size(steps)) - 1), lambda i: F.get(steps, i)))


def _placed(groups: Column) -> Column:
    """Positions by sums within groups of bounded size and over the groups."""
    none = F.array().cast("array<long>")
    ends = F.aggregate(
        groups,
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")),
        lambda acc, g: F.struct(F.aggregate(g, acc["at"], lambda n, s: n + s["gap"] + s["size"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
    )["out"]
    kind = "array<struct<token:string,left:string,right:string,start:long,end:long>>"
    return F.flatten(
        F.zip_with(
            groups,
            ends,
            lambda g, base: F.aggregate(
                g,
                F.struct(base.alias("at"), F.array().cast(kind).alias("out")),
                lambda acc, s: F.struct(
                    (acc["at"] + s["gap"] + s["size"]).alias("at"),
                    F.concat(acc["out"], F.array(F.struct(s["token"].alias("token"), s["left"].alias("left"), s["right"].alias("right"), (acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["size"]).alias("end")))).alias("out"),
                ),
            )["out"],
        )
    )


def _found(docs: DataFrame, name: str, pattern: str, hint: str) -> DataFrame:
    """docs with a column of the located matches of a pattern; each step is a column so that it is evaluated once."""
    empty = F.array().cast("array<string>")
    kind = "array<struct<token:string,left:string,right:string,start:long,end:long>>"
    docs = docs.withColumn(f"_f_{name}", F.when(F.col("text").rlike(hint), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(empty))
    docs = docs.withColumn(f"_p_{name}", F.when(F.size(f"_f_{name}") > 0, F.split("text", pattern, -1)).otherwise(empty))
    docs = docs.withColumn(f"_l_{name}", _located(F.col(f"_f_{name}"), F.col(f"_p_{name}")))
    docs = docs.withColumn(f"_s_{name}", F.when(F.size(f"_f_{name}") > 0, _grouped(F.col(f"_l_{name}"))))
    return docs.withColumn(name, F.when(F.col(f"_s_{name}").isNotNull(), _placed(F.col(f"_s_{name}"))).otherwise(F.array().cast(kind))).drop(f"_f_{name}", f"_p_{name}", f"_l_{name}", f"_s_{name}")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the row), an array of valid matches for each kind, and the identifier-like tokens."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    for kind in KINDS:
        out = _found(out, kind, BASE[kind], HINT[kind])
        out = out.withColumn(kind, _checked(kind))
    return _found(out, "tokens", TOKEN, TOKEN_HINT).drop("text")


def _spans(*kinds: str) -> Column:
    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"))).cast(_SPAN)

    return F.concat(*(of(k) for k in kinds))


def _text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _plausible(instance: Column, kind: Column) -> Column:
    """Whether a token could be an identifier of the kind at all."""
    digits = F.length(_digits(instance))
    return (
        F.when(kind == 0, F.contains(instance, F.lit("@")) & (F.length(instance) >= 5))
        .when(kind == 1, instance.rlike(r"^[0-9]++(?:\.[0-9]++){3}$") & _valid("ip", instance))
        .when(kind == 2, _valid("card", instance))
        .otherwise(digits.between(LEAST_DIGITS, 15))
    )


def _joined(tokens: str) -> Column:
    """The tokens with their digits and whether each goes on with the number of the one before."""
    return F.transform(
        tokens,
        lambda t, i: F.struct(
            t["token"].alias("token"), t["left"].alias("left"), t["right"].alias("right"), t["start"].alias("start"), t["end"].alias("end"),
            F.length(_digits(t["token"])).alias("digits"),
            (t["left"].rlike(r"^\x20+$") & t["token"].rlike(OUTER) & F.coalesce(F.get(tokens, i - 1)["token"].rlike(INNER), F.lit(False))).alias("goes_on"),
        ),
    )


def _parts(joined: str, fields: str) -> Column:
    """The parts of two or more tokens of runs of digit groups; whole is true for a run that is learned as one instance."""
    next_on = lambda i: F.coalesce(F.get(joined, i)["goes_on"], F.lit(False))

    def of(t: Column, i: Column) -> Column:
        def part(k: Column) -> Column:
            own = F.transform(F.sequence(F.lit(0), k - 1), lambda x: F.get(joined, i + x))
            digits = F.aggregate(own, F.lit(0), lambda n, x: n + x["digits"])
            alone = F.exists(own, lambda x: x["digits"] >= LEAST_DIGITS)
            last = F.get(joined, i + k - 1)
            whole = ~t["goes_on"] & ~next_on(i + k) & ~alone
            return F.struct(F.array_join(F.transform(own, lambda x: x["token"]), " "), t["left"], last["right"], t["start"], last["end"], F.lit(None).cast("int"), whole, digits)

        # a part ends where the run does, or after GROUPS groups
        length = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.lit(GROUPS)), lambda k: ~next_on(i + k))), F.lit(GROUPS))
        parts = F.transform(F.sequence(F.lit(2), length), part)
        kept = F.filter(parts.cast(f"array<{fields[:-1]},digits:int>>"), lambda x: x["digits"].between(LEAST_DIGITS, MOST))
        return F.when(next_on(i + 1), kept.cast(f"array<{fields[:-1]},digits:int>>"))

    return F.flatten(F.filter(F.transform(joined, of), lambda x: x.isNotNull()))


def occurrences(found: DataFrame) -> DataFrame:
    """A row for each seed and for each identifier-like instance beside them: doc_id, row, start, end, instance, kind, patterns.

    patterns has no context where fewer than two words stand between the match before and this one.
    """
    fields = "struct<token:string,left:string,right:string,start:long,end:long,kind:int,whole:boolean>"

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["token"], s["left"], s["right"], s["start"], s["end"], F.lit(KINDS.index(kind)), F.lit(True)).cast(fields))

    seeds = F.concat(*(of(k) for k in KINDS))
    some = found.filter(F.size("tokens") > 0).withColumn("seeds", seeds).withColumn("joined", _joined("tokens"))
    some = some.withColumn("parts", _parts("joined", fields))
    parts = F.transform("parts", lambda t: t.dropFields("digits").cast(fields))
    free = F.transform("tokens", lambda t: F.struct(t["token"], t["left"], t["right"], t["start"], t["end"], F.lit(None).cast("int"), F.lit(True)).cast(fields))
    each = some.select("doc_id", "row", F.explode(F.concat("seeds", free, parts)).alias("o")).select("doc_id", "row", "o.*")
    # of the others, those that overlap no seed: the seeds up to a start end before it, the next one starts at its end or later
    text = Window.partitionBy("doc_id", "row")
    seed = F.col("kind").isNotNull()
    each = each.withColumn("to", F.max(F.when(seed, F.col("end"))).over(text.orderBy("start").rangeBetween(Window.unboundedPreceding, 0)))
    each = each.withColumn("next", F.min(F.when(seed, F.col("start"))).over(text.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)))
    each = each.filter(seed | ((F.coalesce("to", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")))).drop("to", "next")
    edge = r"[\p{Punct}]"
    own = F.lower(F.regexp_replace("token", rf"^(?!\+){edge}+|(?<!{edge}){edge}++$", ""))
    before = F.regexp_extract_all(F.lower("left"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    after = F.regexp_extract(F.lower("right"), r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1)
    last = F.try_element_at("b", F.lit(-1))
    patterns = F.array(F.concat_ws(" ", F.try_element_at("b", F.lit(-2)), last, F.lit("_")), F.concat_ws(" ", last, F.lit("_"), after))
    patterns = F.when((F.size("b") > 1) & F.col("whole"), patterns).otherwise(F.array().cast("array<string>"))
    form = F.regexp_replace(F.regexp_replace("instance", "[0-9]", "9"), r"\p{L}++", "a")
    # the form of a long token says nothing, and that of a token of few digits says too little
    formed = (F.length("instance") <= 40) & (F.length(_digits(F.col("instance"))) >= LEAST_DIGITS)
    patterns = F.concat(patterns, F.when(formed, F.array(F.concat(F.lit("form "), form))).otherwise(F.array().cast("array<string>")))
    return each.withColumn("instance", own).withColumn("b", before).filter(F.col("instance") != "").select("doc_id", "row", "start", "end", "kind", "instance", patterns.alias("patterns"))


def bootstrap(seen: DataFrame, *, rounds: int | None = None, support: int = 5, confidence: float = 0.8, accept: float = 0.9) -> DataFrame:
    """(instance, kind) of identifiers that trusted patterns discover, in as many rounds as accept a new one.

    The graph's edges are distinct rows, counted by partial aggregates. Trusted patterns are joined back by pattern;
    Spark broadcasts them only below its size threshold and else splits a hot pattern as a skewed join. An accepted
    instance keeps its kind, so confidences only rise and the rounds end.
    """
    edges = written(seen.select(F.explode("patterns").alias("pattern"), "instance", "kind").distinct(), "edges")
    seeds = seen.filter("kind is not null").select("instance").distinct()
    graph = written(edges.filter("kind is null").select("pattern", "instance").join(seeds, "instance", "left_anti"), "graph")
    first = edges.filter("kind is not null").select("pattern", "instance", "kind")
    # against a kind stand only instances that could be of it: a number that fails Luhn says nothing about cards
    nodes = first.select("pattern", "instance").unionByName(graph).distinct()
    could = nodes.select("*", F.explode(F.array(*(F.lit(k) for k in range(len(KINDS))))).alias("kind")).filter(_plausible(F.col("instance"), F.col("kind")))
    total = written(could.unionByName(first).distinct().groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n")), "total")
    accepted = seen.sparkSession.createDataFrame([], "instance string, kind int")
    while rounds is None or rounds > 0:
        known = first.unionByName(graph.join(accepted, "instance").select("pattern", "instance", "kind"))
        right = known.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= support)
        trusted = right.join(total, ["pattern", "kind"]).withColumn("conf", F.col("hits") / F.col("n")).filter(F.col("conf") >= confidence).select("pattern", "kind", "conf")
        open_ = graph.join(accepted.select("instance"), "instance", "left_anti")
        scored = open_.join(trusted, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-6)))))).alias("score"))
        scored = scored.filter((F.col("score") >= accept) & _plausible(F.col("instance"), F.col("kind")))
        new = written(scored.groupBy("instance").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind")), "found")
        if new.isEmpty():
            break
        accepted = written(accepted.unionByName(new), "accepted")
        rounds = None if rounds is None else rounds - 1
    return accepted


def personal_data(docs: DataFrame, *, rounds: int | None = None, support: int = 5, confidence: float = 0.8, accept: float = 0.9) -> DataFrame:
    """A row per document: base counts by kind, base_spans and spans as text (kind:start:end, by start and then kind), and n_found, the spans that the method adds."""
    found = written(base_spans(docs), "spans")
    seen = written(occurrences(found), "occurrences")
    new = bootstrap(seen, rounds=rounds, support=support, confidence=confidence, accept=accept)
    more = seen.filter("kind is null").drop("kind").join(new, "instance")
    more = more.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    both = found.withColumn("base", _spans(*KINDS)).join(more.select(F.col("doc_id").alias("d2"), F.col("row").alias("r2"), "more"), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("row") == F.col("r2")), "left")
    more = F.coalesce(F.col("more").cast(_SPAN), F.array().cast(_SPAN))
    return both.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        _text(F.col("base")).alias("base_spans"),
        _text(F.concat("base", more)).alias("spans"),
        F.size(more).cast("long").alias("n_found"),
    )
