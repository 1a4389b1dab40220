"""Text expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Character entities decoded, in this order (the ampersand last, so
# that an escaped entity is not decoded twice).
ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]

# Elements whose text is not shown, and elements that end a block.
HIDDEN_ELEMENTS = ["script", "style", "head", "noscript", "template"]
BLOCK_ELEMENTS = [
    "html", "body", "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
    "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
]

CONTROL_PATTERN = r"[\x00-\x08\x0E-\x1F\x7F]"
SPACE_PATTERN = "[ \\t\\r\\n\\f\\x0B\\x{00A0}\\x{3000}]+"
HIDDEN_PATTERN = "(?is)<!--.*?-->|" + "|".join(
    rf"<{e}\b.*?</{e}\s*>" for e in HIDDEN_ELEMENTS
)
BLOCK_PATTERN = r"(?i)</?(?:" + "|".join(BLOCK_ELEMENTS) + r")\b[^>]*>"
TAG_PATTERN = r"<[^>]*>"
# Letters, their marks, and digits.  Scripts written without spaces give a word per letter,
# so that shingles of them are character n-grams.
WORD_PATTERN = r"[\p{L}\p{M}\p{N}]+"
UNSPACED_SCRIPTS = ["Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"]
UNSPACED_PATTERN = "[" + "".join(rf"\p{{Is{s}}}" for s in UNSPACED_SCRIPTS) + "]"

# Full-width forms U+FF01..U+FF5E map to ASCII by a constant shift.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def decode_entities(col: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, col)


def fold_space(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, SPACE_PATTERN, " "))


def sanitize(col: Column) -> Column:
    """Decode entities, drop control characters, fold width and white space."""
    text = F.regexp_replace(decode_entities(col), CONTROL_PATTERN, "")
    return fold_space(F.translate(text, WIDE, NARROW))


def normalized(col: Column) -> Column:
    """The form two equal segments share: folded space, lower case."""
    return F.lower(fold_space(col))


def fingerprint(col: Column) -> Column:
    return F.sha2(normalized(col), 256)


def words(col: Column) -> Column:
    """Lower-cased words; each letter of a script without spaces is one."""
    lower = F.lower(col)
    spaced = F.when(lower.rlike(UNSPACED_PATTERN), F.regexp_replace(lower, UNSPACED_PATTERN, " $0 ")).otherwise(lower)
    return F.regexp_extract_all(spaced, F.lit(WORD_PATTERN), F.lit(0))


def word_pairs(word_array: Column) -> Column:
    """Word pairs of a word array, repeats included; a single word stands for itself."""
    n = F.size(word_array)
    pairs = F.zip_with(
        F.slice(word_array, F.lit(1), n - 1),
        F.slice(word_array, F.lit(2), n - 1),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.when(n > 1, pairs).otherwise(word_array)


def shingles(word_array: Column) -> Column:
    """Distinct word pairs of a word array; a single word stands for itself."""
    return F.array_distinct(word_pairs(word_array))


def collapse_stretch(col: Column) -> Column:
    """Each run of one character becomes a single one, so stretched forms meet."""
    return F.regexp_replace(col, r"(.)\1+", "$1")


def visible_blocks(html: Column) -> Column:
    """Non-empty text blocks of a page in document order, as an array."""
    h = F.regexp_replace(html, HIDDEN_PATTERN, "")
    h = F.regexp_replace(h, r"[ \t\r\n\f]+", " ")
    h = F.regexp_replace(h, BLOCK_PATTERN, "\n")
    h = decode_entities(F.regexp_replace(h, TAG_PATTERN, ""))
    h = F.regexp_replace(F.regexp_replace(h, " +", " "), " ?\n[ \n]*", "\n")
    return F.filter(F.split(F.trim(h, F.lit(" \n")), "\n"), lambda t: t != "")
