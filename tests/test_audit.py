"""Whole audits against hand-derived results, and properties that every audit has."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators.verify import previous_snapshot, verify
from folioscope.plans import audit as plan
from folioscope.sinks import reports

AS_OF = datetime.date(2026, 5, 1)
DOCUMENTS = "doc_id long, label string, file_type string, raw string"
MINIMAL = "<html><body><h1>Hello</h1></body></html>"
TITLED = "<!DOCTYPE html><html><head><title>x</title></head><body><h1>x</h1></body></html>"
ARTICLE = """<!DOCTYPE html><html><head><title>Twenty-seven letters title.</title>
<meta name="description" content="{desc}"><meta property="og:title" content="t"><meta property="og:image" content="https://x.example/i.png"></head>
<body><h1>First-line LDL aim</h1><p><b>TL;DR</b> : statins come first for most adults in primary care now.</p>
<h2>One</h2><p>About 30% relative risk.</p><h2>Two</h2></body></html>""".format(desc="d" * 136)


def run(spark, *raws, kind="html", **options):
    rows = [(k, f"doc{k}", kind, raw) for k, raw in enumerate(raws)]
    found = plan.audit(spark.createDataFrame(rows, DOCUMENTS), AS_OF, **options).orderBy("doc_id").collect()
    return [r.asDict(True) for r in found]


def test_scores_of_small_pages(spark):
    minimal, titled = run(spark, MINIMAL, TITLED)
    assert minimal["score"] == 40
    assert [c["name"] for c in minimal["score_breakdown"]["components"]] == ["meta_title", "meta_description", "og_title", "og_image", "h2_count", "word_count", "schema"]
    assert titled["score"] == 55
    assert titled["suggestions"][0] == "Title is 1 chars. Aim 50..60."


def test_article(spark):
    (a,) = run(spark, ARTICLE)
    parts = {c["name"]: c["deducted"] for c in a["score_breakdown"]["components"]}
    assert parts == {"og_image_dimensions": 2, "twitter_card": 2, "word_count": 10, "schema": 5, "tldr_position": 5, "first_stat_position": 5}
    assert a["score"] == 100 - sum(parts.values())
    ids = [f["rule_id"] for f in a["findings"]]
    assert ids[:6] == ["title_short", "og_image_dims", "og_image_alt", "og_description_absent", "twitter_card_absent", "canonical_absent"]
    assert [f["rule_ord"] for f in a["findings"]] == sorted(f["rule_ord"] for f in a["findings"])


def test_markdown_and_empty_input(spark):
    a, b = run(spark, "---\nt: x\n---\n# One\n\ntext & <b>", None, kind="markdown")
    assert a["content"]["h1"] == ["One"] and a["content"]["word_count"] == 3
    assert b["content"]["word_count"] == 0 and b["position_bias"]["total_words"] == 0
    assert b["copy_precision"]["verdict"] == "insufficient_content"


def test_partitioning_does_not_matter(spark):
    rows = [(k, f"d{k}", "html", ARTICLE.replace("30%", f"{k}%")) for k in range(6)]
    one = plan.audit(spark.createDataFrame(rows, DOCUMENTS).coalesce(1), AS_OF).select("doc_id", "score", "suggestions")
    many = plan.audit(spark.createDataFrame(rows[::-1], DOCUMENTS).repartition(4), AS_OF).select("doc_id", "score", "suggestions")
    assert sorted(one.collect()) == sorted(many.collect())


def test_factors(spark):
    assert plan.parse_factors(" og, ,Schema") == ["og", "schema"]
    with pytest.raises(ValueError, match="unknown factor `x`"):
        plan.parse_factors("x")
    (every,) = run(spark, MINIMAL)
    (og,) = run(spark, MINIMAL, factors=["og"])
    assert og["score"] == every["score"]
    assert {c["name"] for c in og["score_breakdown"]["components"]} == {"og_title", "og_image"}
    assert og["suggestions"] == [s for s in every["suggestions"] if "og:" in s]


def test_gate(spark):
    assert [r["passed"] for r in run(spark, MINIMAL, TITLED, fail_under=50)] == [False, True]


def test_verify(spark):
    a = spark.createDataFrame([("f", 60, ["b", "a", "a"]), ("gone", 1, ["z"])], "file string, score int, suggestions array<string>")
    b = spark.createDataFrame([("f", 70, ["c", "a"]), ("new", 9, [])], "file string, score int, suggestions array<string>")
    rows = {r.file: r for r in verify(a, b).collect()}
    assert (rows["f"].fixed, rows["f"].regressed, rows["f"].still_present, rows["f"].score_change, rows["f"].verdict) == (["b"], ["c"], ["a"], 10, "fail")
    assert rows["gone"].verdict == "pass" and rows["new"].verdict == "pass"
    back = {r.file: r for r in verify(b, a).collect()}
    assert back["f"].regressed == rows["f"].fixed and back["f"].fixed == rows["f"].regressed
    assert all(not r.fixed and not r.regressed for r in verify(a, a).collect())


def test_previous_snapshot(spark):
    bare = json.dumps({"file": "a", "score": 3, "suggestions": ["x"]})
    wrapped = json.dumps({"version": "1", "status": "success", "data": {"file": "b", "score": 4}})
    rows = spark.createDataFrame([(bare,), (wrapped,), ("{}",)], "t string").select(previous_snapshot(F.col("t")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in rows] == [("a", 3, ["x"]), ("b", 4, []), ("<unknown>", 0, [])]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a<b>", "html", ARTICLE), (2, "b", "html", MINIMAL)], DOCUMENTS)
    audits = plan.audit(rows, AS_OF)
    pages = {r.doc_id: r.html for r in reports.html_reports(audits, AS_OF).collect()}
    assert "Findings" in pages[1] and "a&lt;b&gt;" in pages[2].replace(">b<", ">a&lt;b&gt;<")
    sarif = json.loads(audits.where("doc_id = 2").select(reports.sarif(F.col("file"), F.col("suggestions"), F.col("score"))).first()[0])
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["results"]) == 10
    data = json.loads(audits.where("doc_id = 2").select(reports.envelope(F.struct("score", "meta"))).first()[0])
    assert data["status"] == "success" and data["data"]["meta"]["title"] is None
    reports.write_reports(audits, str(tmp_path / "j"), "json", AS_OF)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    with pytest.raises(ValueError, match="unsupported"):
        reports.write_reports(audits, str(tmp_path / "x"), "pdf", AS_OF)


def test_report_of_a_crawl(spark):
    from folioscope.sources.crawl import audit_crawl

    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000000FA00000190")
    crawl = spark.createDataFrame(
        [
            ("https://x.example/a", 200, {"Content-Type": "text/html", "X-Robots-Tag": "noai, NOFOLLOW"}, ARTICLE.encode() + b"\xff", 200, "image/png", png),
            ("https://x.example/b", 500, {}, b"", None, None, None),
        ],
        "label string, status int, headers map<string,string>, body binary, image_status int, image_type string, image_bytes binary",
    )
    (r,) = audit_crawl(crawl, AS_OF).collect()
    assert [f.rule_id for f in r.response_findings] == ["xrobots_nofollow", "xrobots_noai", "og_image_small", "og_image_portrait"]
    assert list(r.suggestions[:4]) == [f.message for f in r.response_findings]
    assert (r.fetched.og_image_check.width, r.fetched.og_image_check.height) == (250, 400)


def test_findings_of_all_rules_are_returned(spark):
    from folioscope.plans.rules import audit_rules
    from folioscope.registry import queries

    rules = {r.id for r in audit_rules()}
    found = {r.rule_id for r in queries.audit_findings(spark, "/root/testdata/sf0.001").collect()}
    assert set(queries.FINDINGS) < rules
    assert found - set(queries.FINDINGS) and found <= rules
