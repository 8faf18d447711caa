"""Comparison of two audits of the same documents: what was fixed, what regressed, what is still there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREVIOUS = "struct<status:string,data:struct<file:string,score:int,suggestions:array<string>>,file:string,score:int,suggestions:array<string>>"


def previous_snapshot(text: Column) -> Column:
    """struct(file, score, suggestions) of an earlier report as JSON, with or without the envelope; missing keys get defaults."""
    raw = F.from_json(text, PREVIOUS)
    wrapped = raw["status"].isNotNull() & raw["data"].isNotNull()

    def pick(name: str, default: Column) -> Column:
        return F.coalesce(F.when(wrapped, raw["data"][name]).otherwise(raw[name]), default)

    return F.struct(pick("file", F.lit("<unknown>")).alias("file"), pick("score", F.lit(0)).alias("score"), pick("suggestions", F.array().cast("array<string>")).alias("suggestions"))


def delta(before: Column, now: Column) -> Column:
    """struct(fixed, regressed, still_present) of two lists as sets, each in byte order."""
    return F.struct(
        F.array_sort(F.array_except(before, now)).alias("fixed"),
        F.array_sort(F.array_except(now, before)).alias("regressed"),
        F.array_sort(F.array_intersect(before, now)).alias("still_present"),
    )


def verify(previous: DataFrame, current: DataFrame, key: str = "file", by_rule: bool = False) -> DataFrame:
    """A row for each document of both: scores, delta and verdict.

    A document that one side lacks has an empty list and the score 0 there.  ``by_rule`` compares rule
    identifiers (the columns need ``findings``) instead of messages, so that a changed number isn't a change.
    """
    items = F.transform("findings", lambda f: f["rule_id"]) if by_rule else F.col("suggestions")
    none = F.array().cast("array<string>")
    a = previous.select(key, F.col("score").alias("score_before"), items.alias("before"))
    b = current.select(key, F.col("score").alias("score_now"), items.alias("now"))
    rows = a.join(b, key, "full").withColumn("delta", delta(F.coalesce("before", none), F.coalesce("now", none)))
    score = [F.coalesce(c, F.lit(0)) for c in ("score_before", "score_now")]
    passed = (F.size("delta.still_present") == 0) & (F.size("delta.regressed") == 0)
    return rows.select(key, score[0].alias("score_before"), score[1].alias("score_now"), (score[1] - score[0]).alias("score_change"), "delta.*", F.when(passed, "pass").otherwise("fail").alias("verdict"))


def verify_long(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Corpus form over long findings: (keys, status) by a full outer join on distinct rows."""
    a = previous.select(*keys).distinct().withColumn("__before", F.lit(True))
    b = current.select(*keys).distinct().withColumn("__now", F.lit(True))
    status = F.when(F.col("__now").isNull(), "fixed").when(F.col("__before").isNull(), "regressed").otherwise("still_present")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))
