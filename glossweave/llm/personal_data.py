"""Personal data: fixed patterns, and identifiers discovered by their contexts.

The base patterns find e-mail addresses, IP addresses, card and phone numbers.  Their
values are seeds.  The words around a value form lexical patterns: the word before it,
the two words before it, and the words on both sides.  Values and patterns form a
graph.  In each round a pattern is scored by the trust in the values it surrounds,
against all identifier-like values it surrounds, and a value by the confident patterns
around it; values trusted enough count in the next round.  Values that are trusted at
the end and no base match are added to the spans.

All of it is DataFrame work: texts are read once, candidates and patterns are joined by
hash, and what a pattern or a value gathers is summed on the map side first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from glossweave.llm.common import text_of
from glossweave.session import stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
#: The base patterns.  Runs are possessive and begin where no earlier start can match, so
#: that long runs cost no more than their length; the matches are the contract's.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Identifier-like stretches: words with an @, runs of groups of digits parted by single
#: blanks, dots, hyphens or parentheses, and words that hold a digit.  Runs are possessive.
_GROUP = r"(?:[\x20.-]|\)[\x20.-]?|[\x20.-]?\()[0-9]++"
CANDIDATE = (
    r"(?<![\w@.%+-])(?:"
    r"[\w.%+-]++@[\w-]++(?:\.[\w-]++)*+"
    rf"|\+?\(?[0-9]++(?:{_GROUP})*+(?![\w@%+])"
    r"|[A-Za-z_@.%+-]*+[0-9](?:[\w@.%+-]*\w)?)"
)
#: Which kinds a candidate may become.
SHAPES = {
    "email": r"\A[^@]++@[^@]++\z",
    "ip": r"\A[0-9]++(?:\.[0-9]++){2,}+\z",
    "card": r"\A[0-9](?:[\x20-]?[0-9]){11,18}\z",
    "phone": r"\A\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}\z",
}
#: Characters of context on either side.
CONTEXT = 40
CHUNK = 256
ROUNDS = 3
#: A pattern is confident with this share of trust and so many trusted values.
PATTERN_SHARE, PATTERN_VALUES = 0.7, 3
VALUE_SCORE = 0.9
#: Weight against a pattern of a value that has the right shape but is not trusted.
UNSURE = 0.25

_SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def all_matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with code point offsets and context.

    The pieces between the matches give the offsets: text is the first piece, the first
    match, the second piece and so on.  Lengths are summed in chunks of the pieces and
    then over the chunks, so a text of many matches takes no quadratic time.
    """

    def with_next(gaps: Column) -> Column:
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        pairs = F.zip_with(matches, gaps, lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
        later = F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(1)))
        return F.zip_with(
            pairs,
            later,
            lambda p, after: F.struct(
                p["m"].alias("m"),
                F.length(p["gap"]).alias("skip"),
                F.coalesce(F.length(p["m"]), F.lit(0)).alias("size"),
                F.substring(p["gap"], -CONTEXT, CONTEXT).alias("before"),
                F.substring(after, 1, CONTEXT).alias("after"),
            ),
        )

    def sums(lengths: Column) -> Column:
        """Sums before each element."""
        start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            lengths,
            start,
            lambda acc, n: F.struct((acc["pos"] + n).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")),
            lambda acc: acc["out"],
        )

    def placed(part: Column, before: Column) -> Column:
        first = before + part["skip"]
        return F.struct(
            first.alias("start"),
            (first + part["size"]).alias("end"),
            part["m"].alias("value"),
            part["before"].alias("before"),
            part["after"].alias("after"),
        )

    def length_of(part: Column) -> Column:
        return part["skip"] + part["size"]

    def in_chunks(parts: Column) -> Column:
        last = F.floor((F.size(parts) - 1) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(parts, c * CHUNK + 1, F.lit(CHUNK)))
        return _let(chunks, over_chunks)

    def over_chunks(chunks: Column) -> Column:
        whole = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + length_of(p)))
        return F.flatten(
            F.zip_with(
                chunks,
                sums(whole),
                lambda c, base: F.zip_with(c, sums(F.transform(c, length_of)), lambda p, n: placed(p, base + n)),
            )
        )

    parts = _let(F.split(text, pattern, -1), with_next)
    return F.filter(_let(parts, in_chunks), lambda s: s["value"].isNotNull())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    figures = F.filter(F.split(F.reverse(_digits(value)), ""), lambda c: c != "")
    doubled = F.transform(figures, lambda c, i: c.cast("int") * (1 + i % 2))
    total = F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d).cast("int"))
    return total % 10 == 0


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(13, 19), _luhn(value)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _valid_matches(text: Column, kind: str) -> Column:
    return F.filter(all_matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))


def base_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, row_hash, the valid matches of each kind, and the candidates."""
    text = F.col("text")
    none = F.array().cast(_SPAN)
    digit = text.rlike("[0-9]")
    gates = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    return docs.select(F.col(id_col).alias("doc_id"), text_of(docs, text_col).alias("text")).select(
        "doc_id",
        F.xxhash64(text).alias("row_hash"),
        *[F.when(gates[k], _valid_matches(text, k)).otherwise(none).alias(k) for k in KINDS],
        F.when(digit | gates["email"], all_matches(text, CANDIDATE)).otherwise(none).alias("candidates"),
    )


def _words(span: Column) -> Column:
    """Hashes of the lexical patterns around a span."""
    before = F.filter(F.split(F.lower(span["before"]), r"\s+"), lambda w: w != "")
    after = F.filter(F.split(F.lower(span["after"]), r"\s+"), lambda w: w != "")
    one = F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit(""))
    two = F.coalesce(F.try_element_at(before, F.lit(-2)), F.lit(""))
    next_ = F.coalesce(F.try_element_at(after, F.lit(1)), F.lit(""))
    return F.array(
        F.xxhash64(F.lit("1"), one), F.xxhash64(F.lit("2"), two, one), F.xxhash64(F.lit("3"), one, next_)
    )


def trusted_values(found: DataFrame) -> DataFrame:
    """(value, kind) hashes of discovered values, from the stored result of ``base_matches``.

    Each round keeps only sums per pattern and per value; all tables of a round are
    written to the shared folder.
    """

    def nodes(column: str, seed: Column) -> DataFrame:
        span = F.col("span")
        return found.select(F.explode(column).alias("span")).select(
            F.xxhash64(span["value"]).alias("value"),
            F.explode(_words(span)).alias("pattern"),
            *[
                F.coalesce(span["value"].rlike(SHAPES[k]) | (seed == k), F.lit(False)).alias(k) for k in KINDS
            ],
            seed.alias("seed"),
        )

    every = nodes("candidates", F.lit(None).cast("string"))
    for kind in KINDS:
        every = every.unionByName(nodes(kind, F.lit(kind)))
    edges = stored(
        every.groupBy("pattern", "value").agg(
            *[F.max(k).alias(k) for k in KINDS], F.max("seed").alias("seed")
        ),
        "edges",
    )
    around = stored(edges.groupBy("pattern").agg(F.count("value").alias("n")).filter(f"n >= {PATTERN_VALUES}"), "patterns")
    typed = edges.select(
        "pattern", "value", "seed",
        F.explode(F.filter(F.array(*[F.when(F.col(k), F.lit(k)) for k in KINDS]), lambda k: k.isNotNull())).alias("kind"),
    )
    # patterns around fewer values than a confident one needs can be left out from here on
    typed = stored(typed.join(around, "pattern"), "typed")
    seeds = typed.filter("seed = kind").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    trusted = seeds = stored(seeds, "seeds")
    # trust, values of another shape, and values of the right shape that are not trusted yet
    trust, fit, n = F.col("trust"), F.col("fit"), F.col("n")
    against = trust + (n - fit) + UNSURE * (fit - trust)
    for _ in range(ROUNDS):
        confident = stored(
            typed.join(trusted, ["value", "kind"], "left")
            .groupBy("pattern", "kind")
            .agg(
                F.sum(F.coalesce("score", F.lit(0.0))).alias("trust"),
                F.count("score").alias("support"),
                F.count("value").alias("fit"),
                F.max("n").alias("n"),
            )
            .withColumn("share", F.col("trust") / against)
            .filter((F.col("support") >= PATTERN_VALUES) & (F.col("share") >= PATTERN_SHARE))
            .select("pattern", "kind", F.log1p(-0.99 * F.col("share")).alias("doubt")),
            "confident",
        )
        grown = (
            typed.join(confident, ["pattern", "kind"])
            .groupBy("value", "kind")
            .agg((1 - F.exp(F.sum("doubt"))).alias("score"))
            .filter(F.col("score") >= VALUE_SCORE)
        )
        both = grown.unionByName(seeds)
        trusted = stored(both.groupBy("value", "kind").agg(F.max("score").alias("score")), "trusted")
    return trusted.join(seeds.select("value", "kind"), ["value", "kind"], "left_anti").select("value", "kind")


def _clear_of_base(spans: DataFrame, found: DataFrame) -> DataFrame:
    """The added spans of a text that overlap none of its base matches.

    Base and added spans of a text are gone through in the order of their starts: an added
    one is clear if no base match before it reaches into it, and the next one starts at its
    end at the earliest.  Only texts with added spans are looked at.
    """
    ids = spans.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash"))
    base = (
        found.join(ids, same, "left_semi")
        .select("doc_id", "row_hash", F.explode(F.concat(*KINDS)).alias("b"))
        .select("doc_id", "row_hash", F.lit(None).cast("string").alias("kind"), "b.start", "b.end")
        .distinct()
    )
    order = Window.partitionBy("doc_id", "row_hash").orderBy("start", F.col("kind").isNotNull(), "end", "kind")
    is_base = F.col("kind").isNull()
    reached = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    placed = spans.unionByName(base).withColumns({"_reached": reached, "_following": following})
    clear = (F.coalesce("_reached", F.lit(0)) <= F.col("start")) & (F.coalesce("_following", F.col("end")) >= F.col("end"))
    return placed.filter(~is_base & clear).select("doc_id", "row_hash", "kind", "start", "end")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, email, ip, card, phone (base matches), added (kind, start, end).

    A span added never overlaps a base match of its document; added spans of one kind do not
    overlap each other.  A null text is empty and holds nothing; a very long one is read
    whole, in time that grows with its length and matches; repeated rows get the same answer each; an empty table gives no rows;
    other columns are ignored.
    """
    found = stored(base_matches(docs, id_col, text_col), "matches")
    accepted = stored(trusted_values(found), "accepted").withColumnRenamed("value", "_value")
    span = F.col("span")
    seen = (
        found.select("doc_id", "row_hash", F.explode("candidates").alias("span"))
        .withColumn("_v", F.xxhash64(span["value"]))
        .join(accepted, F.col("_v") == F.col("_value"))
    )
    spans = seen.select("doc_id", "row_hash", "kind", span["start"].alias("start"), span["end"].alias("end"))
    extra = _clear_of_base(spans.distinct(), found).groupBy(
        F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash")
    ).agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    joined = found.join(
        extra, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash")), "left"
    )
    free = F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    return joined.select("doc_id", *KINDS, free.alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, and all spans, each as kind:start:end."""

    def written(kind: str, spans: Column) -> Column:
        return F.transform(
            spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
        )

    def of_kind(kind: str) -> Column:
        own = F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        new = F.transform(
            F.filter("added", lambda a: a["kind"] == kind),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")),
        )
        return F.array_sort(F.concat(own, new))

    base = F.concat(*[written(k, F.col(k)) for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*[written(k, of_kind(k)) for k in KINDS]), ",").alias("spans"),
    )
