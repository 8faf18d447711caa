"""Streams give what a batch gives."""

import datetime

from pyspark.sql import functions as F

from folioscope.streaming import landing

SCHEMA = "doc_id long, label string, file_type string, raw string, ts timestamp"


def _drain(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_changes_of_a_page(spark, tmp_path):
    versions = ["<h2>x</h2>", "<title>t</title><h1>x</h1>", "<title>t</title><h1>x</h1>"]
    for k, raw in enumerate(versions):
        spark.createDataFrame([(k, "page", "html", raw, datetime.datetime(2026, 1, 1 + k))], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path))
        docs = landing.read_landing(spark, str(tmp_path)).drop("ts")
    audits = landing.audit_stream(docs, datetime.date(2026, 5, 1))
    _drain(audits.select("file", "score"), "audits")
    assert spark.table("audits").count() == 3
    _drain(landing.changes(audits), "changes")
    rows = spark.table("changes").collect()
    assert len(rows) == 2 and all(set(r.fixed).isdisjoint(r.regressed) for r in rows)


def test_changes_are_taken_in_the_order_of_their_times(spark, tmp_path):
    day = lambda k: datetime.datetime(2026, 1, k)
    rows = [(0, "page", "html", "<title>t</title><h1>x</h1>", day(3)), (1, "page", "html", "<h2>x</h2>", day(1)), (2, "page", "html", "<h1>x</h1>", day(2))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    docs = landing.read_landing(spark, str(tmp_path / "in"))
    _drain(landing.changes(landing.audit_stream(docs, datetime.date(2026, 5, 1))), "ordered")
    first, second = spark.table("ordered").collect()
    assert first.score_before < first.score_now == second.score_before < second.score_now


def test_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = landing.windowed(stream, late="1000 days").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = landing.windowed(events)
    key = ["window_start", "event_type", "n"]
    assert sorted(map(tuple, spark.table("w").select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))
    assert landing.sessions(events).agg(F.sum("n")).first()[0] == events.count()
