"""Dates of a document: declared, visible, and whether they agree.  ``as_of`` stands for today."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import parse_date, parse_visible_date

# Patterns of dates.
DATE_MODIFIED = r'"dateModified"\s*:\s*"([^"]+)"'
DATE_PUBLISHED = r'"datePublished"\s*:\s*"([^"]+)"'
YEAR = r"\b(19\d{2}|20\d{2}|21\d{2})\b"
TIME_ELEMENT = r"""<time\b[^>]*\bdatetime\s*=\s*["']([^"']+)["']"""
VISIBLE_LABEL = r"(?i)(?:last\s+updated|updated\s+on|updated|last\s+modified|modified\s+on|modified|reviewed\s+on|reviewed|fact[\s-]?checked\s+on|fact[\s-]?checked|posted|published)\s*[:.\s]+\s*((?:\d{1,2}\s+)?(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2}?,?\s*\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|\d{4})"


def freshness(html_like: Column, text: Column, as_of: Column) -> Column:
    def of_found(f: Column) -> Column:
        label_date = F.regexp_extract(f["label"], T.unicode(VISIBLE_LABEL), 1)
        visible = F.coalesce(parse_date(f["time"]), parse_visible_date(F.when(f["label"].isNotNull(), T.strip(label_date))))
        schema = parse_date(f["modified"])

        def of_dates(d: Column) -> Column:
            gap = F.datediff(d["schema"], d["visible"])
            severity = F.when(d["schema"].isNull(), "none").when(d["visible"].isNull(), F.when(T.n_tokens(text) >= 400, "severe").otherwise("none")).when(gap > 180, "severe").when(gap > 30, "mild").otherwise("none")
            return F.struct(
                f["modified"].alias("date_modified"),
                f["published"].alias("date_published"),
                F.datediff(as_of, parse_date(F.coalesce(f["modified"], f["published"]))).alias("days_since_modified"),
                F.array_sort(F.array_distinct(F.transform(T.find_all(text, YEAR), lambda y: y.cast("int")))).alias("year_mentions"),
                F.year(as_of).alias("current_year"),
                f["time"].alias("time_datetime"),
                f["label"].alias("visible_updated_label"),
                (severity != "none").alias("schema_vs_visible_mismatch"),
                severity.alias("schema_vs_visible_severity"),
            )

        return T.let(F.struct(schema.alias("schema"), visible.alias("visible")), of_dates)

    found = F.struct(
        T.first(html_like, DATE_MODIFIED, 1).alias("modified"),
        T.first(html_like, DATE_PUBLISHED, 1).alias("published"),
        T.first(html_like, TIME_ELEMENT, 1).alias("time"),
        T.collapse(T.first(text, VISIBLE_LABEL)).alias("label"),
    )
    return T.let(found, of_found)
