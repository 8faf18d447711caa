"""The audit of a frame of documents.

``audit`` is one narrow plan: markup is parsed once, features are columns over the parse, rules and
score are columns over the features.  No row moves between partitions, so a corpus of any size runs
at the pace of its scan.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rows_of
from ..operators import banks, design, freshness, page, prose
from ..sources.documents import with_markup
from ..sources.html import parsed
from . import rules

#: Factors, their other names, and the words by which a message belongs to one.
FACTORS = {
    "meta": ["meta ", "<title>", "title is"],
    "og": ["og:", "og_", "open graph", "twitter:card"],
    "content": ["body ", "h1", "h2", "tl;dr", "answer-first", "words", "heading"],
    "schema": ["schema", "json-ld"],
    "freshness": ["datemodified", "modified", "days ago"],
    "position": ["answer summary sits", "first statistic", "position"],
}
COMPONENT_FACTORS = {
    "meta_title": "meta", "meta_description": "meta", "og_title": "og", "og_image": "og", "og_image_url": "og", "og_image_dimensions": "og", "twitter_card": "og",
    "schema": "schema", "date_modified": "freshness", "staleness": "freshness", "tldr_position": "position", "first_stat_position": "position",
}
FEATURES = ["meta", "open_graph", "twitter_card", "schema_types", "content", "keywords", "entities", "evidence", "voice", "position_bias", "freshness", "ai_slop", "information_gain", "metatext", "copy_precision", "design_slop", "performance", "link_graph"]


def parse_factors(text: str | None) -> list[str]:
    """Factors of a comma-separated list; a ValueError for an unknown one."""
    names = [p.strip().lower() for p in (text or "").split(",") if p.strip()]
    for name in names:
        if name not in FACTORS:
            raise ValueError(f"unknown factor `{name}` (valid: {', '.join(FACTORS)})")
    return names


def features(docs: DataFrame, as_of: datetime.date) -> DataFrame:
    """A parsed document frame with a column for each feature group.

    docs: doc_id, label, file_type, raw; further columns stay.
    """
    rows = parsed(with_markup(docs))
    p, text, markup = F.col("parsed"), F.col("body_text"), F.col("html_like")
    titles = F.transform(p["headings"], lambda h: h["text"])
    rows = rows.withColumns({"meta": page.meta(p), "schema_types": p["schema_types"]})
    return rows.withColumns(
        {
            "open_graph": page.open_graph(p),
            "twitter_card": page.twitter_card(p),
            "content": page.content(p, text),
            "keywords": prose.keywords(text),
            "entities": prose.entities(text, titles),
            "evidence": prose.evidence(text),
            "voice": prose.voice(text, p["schema_types"], markup),
            "position_bias": prose.position_bias(text),
            "freshness": freshness.freshness(markup, text, F.lit(as_of)),
            "ai_slop": banks.ai_slop(text),
            "information_gain": prose.information_gain(text),
            "metatext": banks.metatext(text, titles),
            "copy_precision": prose.copy_precision(text),
            "design_slop": design.design_slop(markup),
            "performance": page.performance(p, markup),
            "link_graph": page.link_graph(p, F.col("meta.canonical")),
        }
    )


def message_has_factor(message: Column, factors: list[str]) -> Column:
    """Whether a message belongs to one of the factors, by the words in it."""
    out = F.lit(False)
    for needle in (n for f in factors for n in FACTORS[f]):
        out = out | F.contains(F.lower(message), F.lit(needle))
    return out


def component_factor(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in COMPONENT_FACTORS.items() for x in pair]), name), F.lit("content"))


def audit(docs: DataFrame, as_of: datetime.date, factors: list[str] | None = None, fail_under: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A report for each document: doc_id, file, file_type, features, score, score_breakdown, findings, suggestions.

    ``factors`` filters findings, suggestions and components, never the score.  With ``fail_under``
    there is a column ``passed``.  Columns of ``docs`` named in ``keep`` stay.
    """
    rows = features(docs, as_of).withColumns({"findings": rules.findings(rules.audit_rules()), "components": rules.deductions()})
    rows = rows.withColumn("score", rules.total_score(F.col("components")))
    found, parts = F.col("findings"), F.col("components")
    if factors:
        found = F.filter(found, lambda x: message_has_factor(x["message"], factors))
        parts = F.filter(parts, lambda x: component_factor(x["name"]).isin(factors))
    rows = rows.select("doc_id", F.col("label").alias("file"), "file_type", *keep, *FEATURES, "score", found.alias("findings"), parts.alias("components"))
    rows = rows.withColumn("score_breakdown", F.struct(F.col("score").alias("total"), "components")).drop("components")
    rows = rows.withColumn("suggestions", F.transform("findings", lambda x: x["message"]))
    return rows if fail_under is None else rows.withColumn("passed", F.col("score") >= fail_under)


def findings_long(audits: DataFrame) -> DataFrame:
    """A row for each finding: doc_id, rule_ord, rule_id, factor, message."""
    return rows_of(audits, F.col("findings"), "f", "doc_id").select("doc_id", "f.*")
