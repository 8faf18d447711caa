"""Text functions shared by all operators; every one is a native column expression.

Patterns are written in the syntax that RE2 and ``java.util.regex`` share and get ``(?U)`` here,
which makes ``\\b \\w \\d \\s`` and case folding Unicode-aware in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: Separates sentences in every operator that has them.
SENTENCE_END = r"[.!?]+\s+"
#: Marks the beginning of a match; where a text has it, it becomes another control character first.
_MARK, _OTHER = "\u0001", "\u0002"


def unicode(pattern: str) -> str:
    return "(?U)" + pattern


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once even where ``use`` has inner loops."""
    return F.transform(F.array(value), use)[0]


def tokens(text: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def n_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def n_words(text: Column) -> Column:
    """Tokens with a letter or a number."""
    return F.size(F.filter(F.split(text, SPACE), lambda t: t.rlike(r"[\p{L}\p{N}]")))


def collapse(text: Column) -> Column:
    """Trimmed, with one space for each run of white space."""
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), "^ | $", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Pieces between sentence ends, blank ones included."""
    return F.split(text, unicode(SENTENCE_END))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(unicode(pattern)))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(unicode(pattern))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """A group of every non-overlapping match, in order."""
    return F.regexp_extract_all(text, F.lit(unicode(pattern)), F.lit(group))


def first(text: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match, null if there is none."""
    return F.when(has(text, pattern), F.regexp_extract(text, unicode(pattern), group))


def snippet(match: Column) -> Column:
    return F.replace(strip(F.substring(match, 1, 120)), F.lit("\n"), F.lit(" "))


def pct(offset: Column, total: Column) -> Column:
    """A share in per cent with one decimal, halves away from zero."""
    return F.round(offset / total * 1000) / 10


def pieces(text: Column, pattern: str) -> Column:
    """The text cut before each match."""
    return F.split(F.regexp_replace(F.translate(text, _MARK, _OTHER), unicode(pattern), _MARK + "$0"), _MARK)


def offsets(text: Column, pattern: str) -> Column:
    """For each match, how many tokens begin before it; one that begins mid-token counts the part before it."""
    return offsets_of(pieces(text, pattern))


def offsets_of(cut: Column) -> Column:
    """The tokens before each piece but the first.

    Those of the pieces are added up; a token that a cut splits counts once.  Linear in the text, and quadratic in
    the number of pieces, so callers cut off those that they don't report.
    """

    def step(acc: Column, piece: Column) -> Column:
        split_token = acc["open"] & piece.rlike(r"(?U)^\S")
        n = acc["n"] + n_tokens(piece) - F.when(split_token, 1).otherwise(0)
        # An empty piece (a match at the very start) leaves the state as it was.
        open_ = F.when(piece == "", acc["open"]).otherwise(piece.rlike(r"(?U)\S$"))
        return F.struct(n.alias("n"), open_.alias("open"), F.array_append(acc["out"], n).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(cut, start, step, lambda acc: F.slice(acc["out"], 1, F.size(acc["out"]) - 1))


def first_offset(text: Column, pattern: str) -> Column:
    """The token offset of the first match, null if there is none."""
    return F.when(has(text, pattern), n_tokens(F.split(text, unicode(pattern), 2)[0]))


def rows_of(docs: DataFrame, items: Column, name: str, *keep: str | Column) -> DataFrame:
    """A row for each element of ``items``, which is computed once.

    An inner generator would have the optimizer test the array's size below it, on a second copy of
    the whole expression; an outer one doesn't, so the rows of empty arrays are dropped after it.
    """
    return docs.select(*keep, F.posexplode_outer(items).alias("__pos", name)).where("__pos is not null").drop("__pos")


def half_up(x: Column, digits: int) -> Column:
    """Rounded to ``digits`` decimals, halves away from zero."""
    return F.round(x * 10**digits) / 10**digits
