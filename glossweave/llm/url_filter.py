"""URL verdicts: explicit rules first, else a weighted vocabulary.

An Aho-Corasick automaton finds all terms of the vocabulary in the lower-cased URL; a
hit counts only if no letter or digit touches it.  One strict term rejects, and so do
several distinct soft terms.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from glossweave.llm.common import LOWER, UPPER

#: Terms of which one rejects a URL.
STRICT = (
    "bestiality", "camgirls", "casino", "cialis", "escorts", "gambling", "hentai", "malware",
    "milf", "payday-loan", "phishing", "poker", "porn", "porno", "roulette", "slots", "spam",
    "viagra", "warez", "xxx",
)
#: Terms of which several reject a URL.
SOFT = (
    "ad", "adult", "ads", "affiliate", "banner", "bet", "bets", "betting", "bonus", "buy", "cheap",
    "clicks", "coupon", "crack", "dating", "deal", "deals", "discount", "doubleclick", "download",
    "farm", "free", "keygen", "loan", "loans", "lottery", "luck", "meds", "nude", "pharma",
    "pharmacy", "pills", "popup", "popups", "prize", "replica", "sex", "torrent", "track",
    "tracker", "tracking", "win", "winner",
)
SOFT_LIMIT = 2
#: (host, path, verdict) of the rules.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    """Lower-cased host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path) and its verdict; nulls if none fits.

    A rule fits its host and all subdomains if the path starts with the rule's.  Of
    equally long rules the one that sorts first wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def count_terms(url: str | None, automaton: ahocorasick.Automaton) -> tuple[int, int]:
    """Distinct strict and soft terms that stand in the URL between boundaries."""
    text = (url or "").translate(_ASCII_LOWER)
    found: tuple[set, set] = (set(), set())
    for last, (kind, term) in automaton.iter(text):
        first = last + 1 - len(term)
        before, after = text[first - 1 : first] if first else "", text[last + 1 : last + 2]
        if not (_inside(before) or _inside(after)):
            found[kind].add(term)
    return len(found[0]), len(found[1])


_ASCII_LOWER = str.maketrans(UPPER, LOWER)
_LETTERS = frozenset(LOWER + "0123456789")


def _inside(char: str) -> bool:
    return char in _LETTERS


def vocabulary(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, terms in ((1, soft), (0, strict)):  # a term in both lists is strict
        for term in terms:
            if term:
                automaton.add_word(term.translate(_ASCII_LOWER), (kind, term))
    if len(automaton):
        automaton.make_automaton()
    else:
        automaton.add_word("\0", (1, "\0"))
        automaton.make_automaton()
    return automaton


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, n_strict, n_soft.

    A null URL or one without ``://`` has an empty host and path and fits no rule; its
    terms count like any other's, a null has none and is allowed.  Repeated rows get the
    same verdict each, an empty table gives no rows, other columns are ignored.
    """

    @F.pandas_udf("struct<n_strict:int,n_soft:int>")
    def terms(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = vocabulary(strict, soft)
        for urls in parts:
            yield pd.DataFrame([count_terms(u, automaton) for u in urls], columns=["n_strict", "n_soft"])

    url = F.col(url_col).cast("string")
    parsed = pages.select(
        F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), terms(url).alias("_n")
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    bad = (F.col("_n.n_strict") > 0) | (F.col("_n.n_soft") >= soft_limit)
    return parsed.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"),
        "_n.n_strict",
        "_n.n_soft",
    )
