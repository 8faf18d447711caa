"""Audits of a stream of pages, the difference of successive audits, and windowed summaries."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.audit import audit

CHANGES = "file string, score_before int, score_now int, fixed array<string>, regressed array<string>, still_present array<string>"
STATE = "score int, suggestions array<string>, at long"


def read_landing(spark: SparkSession, path: str, schema: str = "doc_id long, label string, file_type string, raw string, ts timestamp") -> DataFrame:
    """Documents as they land in a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def audit_stream(docs: DataFrame, as_of: datetime.date) -> DataFrame:
    """The audit is stateless, so a stream of documents gives a stream of reports; ``ts``, if there, stays."""
    return audit(docs, as_of, keep=("ts",) if "ts" in docs.columns else ())


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    score, known, last = state.get if state.exists else (None, None, None)
    before = set(known if known is not None else [])
    rows = []
    audits = sorted((a for batch in batches for a in zip(batch["at"], batch["score"], batch["suggestions"], strict=True)), key=lambda a: a[0])
    for at, now_score, suggestions in audits:
        if last is not None and at < last:
            continue
        now = set(suggestions)
        if score is not None:
            rows.append((key[0], score, int(now_score), sorted(before - now), sorted(now - before), sorted(before & now)))
        score, before, last = int(now_score), now, int(at)
    state.update((score, sorted(before), last))
    yield pd.DataFrame(rows, columns=["file", "score_before", "score_now", "fixed", "regressed", "still_present"])


def changes(audits: DataFrame) -> DataFrame:
    """For every audit of a file after its first: what was fixed, regressed and is still present.

    Audits are taken in the order of ``ts``, if there is one, or else as they arrive.  One that is older than
    the last that was taken comes too late and is left out.
    """
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)) if "ts" in audits.columns else F.lit(0)
    return audits.select("file", "score", "suggestions", at.cast("long").alias("at")).groupBy("file").applyInPandasWithState(_changes, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """With event times that have a zone, as watermarks need; a batch needs no watermark."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, late) if events.isStreaming else rows


def windowed(events: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window_start, key, n, total) by tumbling or sliding window, later events than ``late`` left out."""
    at = F.window(ts, size, slide) if slide else F.window(ts, size)
    rows = _timed(events, ts, late)
    return rows.groupBy(at.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user, session_start, session_end, n) by session window."""
    rows = _timed(events, ts, late)
    return rows.groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
