"""Questions about a whole corpus of audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def score_histogram(audits: DataFrame, width: int = 10) -> DataFrame:
    """(bucket, documents) of the scores."""
    return audits.groupBy((F.floor(F.col("score") / width) * width).alias("bucket")).agg(F.count("*").alias("documents"))


def rule_prevalence(findings: DataFrame) -> DataFrame:
    """(rule_id, factor, documents) of long findings."""
    return findings.groupBy("rule_id", "factor").agg(F.countDistinct("doc_id").alias("documents"))


def rollup_by(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings by the keys, with subtotals; null stands for all."""
    return findings.rollup(*keys).agg(F.count("*").alias("findings"))


def rank_by(audits: DataFrame, group: str) -> DataFrame:
    """Each document's rank and quartile by score within its group.

    Ranks come from counts of each score, of which there are 101 a group at most, so that a group
    of any size is never sorted in one task.
    """
    counts = audits.groupBy(group, "score").agg(F.count("*").alias("n"))
    above = Window.partitionBy(group).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    ranks = counts.withColumn("rank", F.coalesce(F.sum("n").over(above), F.lit(0)) + 1).withColumn("documents", F.sum("n").over(whole))
    return audits.join(ranks.drop("n"), [group, "score"]).select("doc_id", group, "score", "rank", (F.col("rank") / F.col("documents")).alias("share"))


def quality_gate(audits: DataFrame, threshold: int) -> DataFrame:
    """The documents below the threshold."""
    return audits.where(F.col("score") < threshold).select("doc_id", "score")
