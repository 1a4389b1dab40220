"""Terminology: honorifics, sound effects, dictionary terms, message catalogs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from glossweave.functions.text import collapse_stretch, words

# The honorifics looked for by default.
HONORIFICS = ["san", "kun", "chan", "senpai", "sama", "dono", "sensei", "tan"]
# The same in Japanese script, written without a hyphen.
HONORIFICS_JA = ["さん", "くん", "ちゃん", "先輩", "様", "殿", "先生", "さま"]

#: Rows and characters of a glossary that may be sent to every executor.
SMALL_TERMS, SMALL_CHARS = 200_000, 8_000_000
#: First words of phrases that are looked up in a bitmap before the join.
MAPPED_WORDS = 20_000
SALTS = 32


def scan_honorifics(
    segments: DataFrame,
    honorifics: Sequence[str] = HONORIFICS,
    key: Sequence[str] = ("id",),
    japanese: Sequence[str] = HONORIFICS_JA,
) -> DataFrame:
    """Each name-honorific mention of a text as (key, mention_no, name, honorific).

    Latin names may have hyphens of their own, the honorific follows the last one.  A
    name in Han, Kana or both is followed by the honorific itself; kana names of which
    the honorific is not set off by its script cannot be told from other words.
    """
    latin = r"\p{L}+(?:-\p{L}+)*-(?:" + "|".join(map(re.escape, honorifics)) + r")\b"
    either = "|".join(sorted(map(re.escape, japanese), key=lambda h: (-len(h), h)))
    native = rf"(?:\p{{IsHan}}{{1,6}}?|[\p{{IsKatakana}}ー]+)(?:{either})"
    pattern = f"{latin}|{native}" if japanese else latin
    found = F.posexplode_outer(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    mentions = segments.select(*key, found.alias("mention_no", "_m")).filter(F.col("_m").isNotNull())
    dashed = F.contains(F.col("_m"), F.lit("-"))
    return mentions.select(
        *key,
        "mention_no",
        F.when(dashed, F.expr("left(_m, length(_m) - length(substring_index(_m, '-', -1)) - 1)"))
        .otherwise(F.regexp_replace("_m", f"(?:{either})$", ""))
        .alias("name"),
        F.when(dashed, F.substring_index("_m", "-", -1))
        .otherwise(F.regexp_extract("_m", f"(?:{either})$", 0))
        .alias("honorific"),
    )


def honorific_consistency(mentions: DataFrame) -> DataFrame:
    """Names used with more than one honorific: (name, n_honorifics, honorifics, n_mentions).

    The list of honorifics is fixed, so the set per name stays small.
    """
    return (
        mentions.groupBy("name")
        .agg(
            F.array_join(F.array_sort(F.collect_set("honorific")), ",").alias("honorifics"),
            F.count_distinct("honorific").alias("n_honorifics"),
            F.count(F.lit(1)).alias("n_mentions"),
        )
        .filter(F.col("n_honorifics") > 1)
    )


def sfx_lookup(tokens: DataFrame, sfx: DataFrame) -> DataFrame:
    """Sound effects by stretch-collapsed form; unmatched tokens keep a null translation."""
    forms = tokens.withColumn("form", collapse_stretch(F.lower("token")))
    return forms.join(sfx.select("form", "translation"), "form", "left").select(
        *tokens.columns, "form", "translation"
    )


def annotate_terms(
    segments: DataFrame, glossary: DataFrame, key: Sequence[str] = ("doc_id", "pos")
) -> DataFrame:
    """Dictionary hits and coverage per segment that has words.

    Result: (key, n_words, n_hits, coverage).  A term of several words, such as any of
    more than one letter in a script without spaces, is met where its words follow each
    other; each occurrence of a term is a hit.  The glossary is a table from a term's first
    word to what may follow it, probed once for each word of the text: the words that
    follow are looked at only behind a first word of a phrase, so a long term costs nothing
    elsewhere.  A glossary of measured small size is sent to every executor.  A larger one
    is joined by (first word, salt), so that a word that makes up much of all text is
    spread over many tasks.
    """
    key = list(key)
    terms = (
        glossary.select(words(F.col("term")).alias("_w"))
        .filter(F.size("_w") > 0)
        .distinct()
        .select(F.col("_w")[0].alias("_word"), F.slice("_w", F.lit(2), F.size("_w") - 1).alias("_rest"))
    )
    phrase = F.size("_rest") > 0
    longest, n, chars, phrases = terms.agg(
        F.max(F.size("_rest")), F.count(F.lit(1)), F.sum(F.length("_word") + F.length(F.array_join("_rest", " "))), F.count_if(phrase)
    ).first()
    small = n <= SMALL_TERMS and (chars or 0) <= SMALL_CHARS
    known = terms.groupBy("_word").agg(
        F.count_if(~phrase).alias("_single"), F.collect_list(F.when(phrase, F.col("_rest"))).alias("_phrases")
    )
    split = segments.select(*key, words(F.col("text")).alias("_w"))
    if phrases:
        at = split.select(*key, F.size("_w").alias("n_words"), "_w", F.posexplode("_w").alias("_pos", "_word"))
        behind = F.slice("_w", F.col("_pos") + 2, F.lit(longest))
        begins = _begins(terms.filter(phrase)) if small else F.lit(True)
        tokens = at.select(*key, "n_words", "_word", F.when(begins, behind).alias("_behind"))
        met_phrases = F.filter("_phrases", lambda p: F.slice("_behind", F.lit(1), F.size(p)) == p)
        follow = F.when(F.size("_phrases") > 0, F.size(met_phrases)).otherwise(0)
    else:
        tokens = split.select(*key, F.size("_w").alias("n_words"), F.explode("_w").alias("_word"))
        follow = F.lit(0)
    if small:
        met = tokens.join(F.broadcast(known), "_word", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salt = F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")
        met = tokens.withColumn("_salt", salt).join(
            known.withColumn("_salt", salts), ["_word", "_salt"], "left"
        )
    return (
        met.groupBy(*key)
        .agg(
            F.max("n_words").cast("long").alias("n_words"),
            F.sum(F.coalesce(F.col("_single") + follow, F.lit(0)).cast("long")).alias("n_hits"),
        )
        .withColumn("coverage", F.round(F.col("n_hits") / F.col("n_words"), 6))
    )


def _begins(phrases: DataFrame) -> Column:
    """False for most words that begin no phrase: a bitmap of the first words' hashes.

    Only for a glossary of measured small size, whose first words are collected.
    """
    count = phrases.select("_word").distinct().count()
    if count > MAPPED_WORDS:
        return F.lit(True)
    size = max(1024, 1 << (16 * count - 1).bit_length())
    place = F.pmod(F.xxhash64("_word"), F.lit(size)).cast("int")
    bits = [0] * (size // 64)
    for row in phrases.select(place.alias("p")).distinct().collect():
        bits[row["p"] // 64] |= 1 << (row["p"] % 64)
    signed = F.split(F.lit(",".join(str(b - (1 << 64) if b >> 63 else b) for b in bits)), ",").cast("array<bigint>")
    word = F.get(signed, F.floor(place / 64).cast("int"))
    return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), place % 64)) != 0


def catalog_coverage(catalogs: DataFrame, base: str = "en") -> DataFrame:
    """Keys a language misses or has in excess of the base, as (lang, key, status, fallback).

    Works from one aggregate per key: the languages that have it and the base
    value.  The full list of languages is a scalar, so no product of keys and
    languages is formed; only the differences are emitted.
    """
    langs = catalogs.agg(F.array_sort(F.collect_set("lang"))).scalar()
    per_key = catalogs.groupBy("key").agg(
        F.collect_set("lang").alias("_have"),
        F.max(F.when(F.col("lang") == base, F.col("value"))).alias("fallback"),
    )
    in_base = F.array_contains("_have", base)
    odd = F.when(in_base, F.array_except(langs, F.col("_have"))).otherwise(F.col("_have"))
    status = F.when(in_base, "missing").otherwise("extra")
    return per_key.select("key", "fallback", odd.alias("_odd"), status.alias("status")).select(
        F.explode("_odd").alias("lang"), "key", "status", "fallback"
    )
