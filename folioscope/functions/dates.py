"""Tolerant date parsing; every result is a date or null.  The session's time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of visible dates, in the order in which they are tried, by their shape: a parser
#: that fails costs far more than the test.
VISIBLE_FORMS = {
    r"^\d{4}-\d{2}-\d{2}$": ["yyyy-MM-dd"],
    r"^\d{1,2} [A-Za-z]+ \d{4}$": ["d MMM yyyy", "d MMMM yyyy"],
    r"^[A-Za-z]+ \d{1,2} \d{4}$": ["MMM d yyyy", "MMMM d yyyy"],
    r"^[A-Za-z]+ \d{1,2}, \d{4}$": ["MMM d, yyyy", "MMMM d, yyyy"],
    r"^\d{1,2}/\d{1,2}/\d{4}$": ["M/d/yyyy", "d/M/yyyy"],
    r"^\d{1,2}/\d{1,2}/\d{2}$": ["M/d/yy", "d/M/yy"],
}
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"


def parse_date(text: Column) -> Column:
    """The UTC date of an RFC 3339 time, or the ISO date in the first ten characters."""
    moment = F.when(text.rlike(_RFC3339), F.to_date(F.try_to_timestamp(F.regexp_replace(F.upper(text), "[T ]", "T"))))
    head = F.regexp_extract(text, r"^[\x00-\x7F]{10}", 0)
    plain = F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))
    return F.coalesce(moment, plain)


def parse_visible_date(text: Column) -> Column:
    """A date as it is written in prose; a year alone is its first of January."""
    spaced = F.regexp_replace(text, r",\s*", ", ")
    forms = [F.when(spaced.rlike(shape), F.coalesce(*[F.try_to_date(spaced, f) for f in fs])) for shape, fs in VISIBLE_FORMS.items()]
    year = F.regexp_extract(text, r"\b(19\d{2}|20\d{2}|21\d{2})\b", 1)
    return F.coalesce(*forms, F.when(year != "", F.try_to_date(F.concat(year, F.lit("-01-01")), "yyyy-MM-dd")))
