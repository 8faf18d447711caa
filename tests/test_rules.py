"""Rules on both sides of their thresholds, in one audit of many small pages."""

import datetime

import pytest

from folioscope.plans import audit as plan

AS_OF = datetime.date(2026, 5, 1)


def page(head="", body="", tags=""):
    return f"<html {tags}><head>{head}</head><body>{body}</body></html>"


def words(n):
    return "<p>" + "word " * n + "</p>"


LD = '<script type="application/ld+json">{}</script>'
IMG = '<meta property="og:image" content="{}">'
CASES = [
    (page("<title></title>"), {"title_short"}, {"title_absent"}),
    (page(f"<title>{'x' * 29}</title>"), {"title_short"}, {"title_absent"}),
    (page(f"<title>{'é' * 30}</title>"), set(), {"title_absent", "title_short", "title_long"}),
    (page(f"<title>{'x' * 70}</title>"), set(), {"title_long"}),
    (page(f"<title>{'x' * 71}</title>"), {"title_long"}, {"title_short"}),
    (page(f'<meta name=description content="{"d" * 99}">'), {"desc_short"}, {"desc_absent"}),
    (page(f'<meta name=description content="{"d" * 100}">'), set(), {"desc_short", "desc_long"}),
    (page(f'<meta name=description content="{"d" * 171}">'), {"desc_long"}, {"desc_short"}),
    (page(IMG.format("/a")), {"og_image_relative", "twitter_card_absent"}, {"og_image_absent", "og_image_alt"}),
    (page(IMG.format("http://a")), {"og_image_http"}, {"og_image_dims"}),
    (page(IMG.format("https://a")), {"og_image_dims", "og_image_alt"}, {"og_image_http"}),
    (page('<meta property="og:url" content="https://a/"><link rel=canonical href="https://a">'), set(), {"og_url_canonical_mismatch", "canonical_absent"}),
    (page('<meta property="og:url" content="https://a/b"><link rel=canonical href="https://a">'), {"og_url_canonical_mismatch"}, set()),
    (page("<meta name=robots content='NoIndex, nofollow'>"), {"robots_noindex"}, {"robots_nofollow"}),
    (page("<meta name=robots content='nofollow'>"), {"robots_nofollow"}, {"robots_noindex"}),
    (page(body="<h1>a</h1><h1>b</h1><h2>c</h2><h2>C</h2>"), {"h1_multiple", "heading_duplicate"}, {"h1_absent", "h2_few", "heading_hierarchy"}),
    (page(body="<h1>a</h1><h3>b</h3>"), {"heading_hierarchy", "h2_few"}, {"heading_duplicate"}),
    (page(body=words(149)), {"thin_body"}, {"no_answer_block"}),
    (page(body=words(150)), {"no_answer_block"}, set()),
    (page(body=words(299)), {"thin_body"}, {"information_gain_weak"}),
    (page(body=words(300)), {"information_gain_weak", "position_1"}, {"thin_body", "few_quotable"}),
    (page(body=words(400)), {"few_quotable"}, {"link_no_authority"}),
    (page(body=words(600)), {"link_no_authority"}, {"no_table"}),
    (page(body=words(800)), {"no_table"}, set()),
    (page(body=words(800) + "<table></table>"), set(), {"no_table"}),
    (page(tags="lang=de"), {"hreflang_absent"}, {"html_lang_absent"}),
    (page("<link rel=alternate hreflang=en href=x>", tags="lang=de"), set(), {"hreflang_absent"}),
    (page(body="<noscript>Please enable JavaScript</noscript>"), {"noscript_boilerplate"}, set()),
    (page(body=f"<noscript>{'x' * 40}</noscript>"), set(), {"noscript_boilerplate"}),
    (page(LD.format('{"@type":"Article"}')), {"date_modified_absent", "og_type_absent"}, {"jsonld_absent", "stale_90"}),
    (page(LD.format('{"@type":"Article","dateModified":"2026-01-31"}')), set(), {"date_modified_absent", "stale_90"}),
    (page(LD.format('{"@type":"Article","dateModified":"2026-01-30"}')), {"stale_90"}, {"date_modified_absent"}),
    (page(LD.format('{"@type":"FAQPage"}')), {"faqpage_light"}, set()),
    (page(body="by Jane"), {"no_credentials"}, set()),
    (page(body="by Jane Smith, MD"), set(), {"no_credentials"}),
    (page(body="<img src=IMG_1.jpg><img alt=x src=a.png width=1 height=1>"), {"img_alt_missing", "perf_dims", "perf_filenames", "perf_lcp_preload"}, {"perf_lazy", "perf_modern_format"}),
    (page(body="<img src=a.jpg>" * 4), {"perf_lazy", "perf_modern_format"}, {"perf_filenames"}),
    (page(body="<img src=a.jpg>" * 3 + "<img src='a.webp?x'>"), set(), {"perf_modern_format"}),
    (page("<script src=a></script><script src=b defer></script>" + "<link rel=stylesheet>" * 4), {"perf_blocking_script"}, {"perf_stylesheets"}),
    (page("<script src=a type=module></script>" + "<link rel=stylesheet>" * 5), {"perf_stylesheets"}, {"perf_blocking_script"}),
    (page("<link rel=preload as=font href=x><style>" + "x" * 50_000 + "</style>"), {"perf_font_display"}, {"perf_inline_css"}),
    (page("<style>font-display: swap" + "x" * 50_001 + "</style><link rel=x href=a.woff2>"), {"perf_inline_css"}, {"perf_font_display"}),
    (page(body="<a href=x>here</a>" * 2), set(), {"link_generic"}),
    (page(body="<a href=x>Here</a>" * 30), {"link_generic", "link_mill"}, set()),
    (page(body="<a href=x>Here</a>" * 29 + "<a href=https://o.example>o</a>"), set(), {"link_mill"}),
]


@pytest.fixture(scope="module")
def fired(spark):
    rows = [(k, f"c{k}", "html", raw) for k, (raw, _, _) in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "doc_id long, label string, file_type string, raw string")
    found = plan.audit(docs, AS_OF).select("doc_id", "findings", "score", "score_breakdown").collect()
    return {r.doc_id: r for r in found}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_rule(fired, k):
    _, present, absent = CASES[k]
    ids = {f.rule_id for f in fired[k].findings}
    assert present <= ids and not absent & ids


def test_scores_add_up(fired):
    for r in fired.values():
        assert r.score == max(0, 100 - sum(c.deducted for c in r.score_breakdown.components)) and 0 <= r.score <= 100
        assert [f.rule_ord for f in r.findings] == sorted(f.rule_ord for f in r.findings)
