"""Text, date and image functions against Python and hand-derived values."""

import datetime
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import dates
from folioscope.functions import text as T
from folioscope.operators import banks, design, freshness, page, prose
from folioscope.sources import images


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


t = F.col("t")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab. \t\x01", max_size=12), min_size=1, max_size=4))
def test_offsets_match_a_plain_loop(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", "t", T.offsets(t, r"a\b").alias("o"), T.first_offset(t, r"a\b").alias("f")).collect()
    for r in rows:
        want = [len(r.t[: m.start()].split()) for m in re.finditer(r"a\b", r.t)]
        assert r.o == want and r.f == (want[0] if want else None), r.t


def test_word_counts(spark):
    r = one(spark, "a —  1, ... é! z", T.n_tokens(t), T.n_words(t), T.collapse(t))
    assert tuple(r) == (6, 4, "a — 1, ... é! z")


def test_questions_miss_every_second_in_a_row(spark):
    r = one(spark, "Why is that? How so then? Is it now? Why is that? Done.", prose.questions(t))
    assert r[0] == ["Why is that?", "Is it now?"]


def test_people(spark):
    text = "Per Jane Smith, PhD and Dr. Jane Smith met Prof Ann Lee. By Bob, MD."
    assert [tuple(p) for p in one(spark, text, prose.people(t))[0]] == [("Jane Smith", "PHD"), ("Ann Lee", None)]


def test_claims_and_statistics(spark):
    text = "Studies show x [1]. " + "pad " * 120 + "Experts agree on 30% relative 40 users."
    e = one(spark, text, prose.evidence(t))[0]
    assert e.stat_count == 1 and [c.snippet for c in e.unsupported_claims] == ["Experts agree on 30% relative 40 users."]


def test_snippet(spark):
    sentences = ["w " * 10, "w " * 45, "w " * 20, "w " * 15]
    text = ". ".join(s.strip() for s in sentences)
    assert len(one(spark, text, prose.snippet_candidate(t))[0].split()) == 45
    assert one(spark, "", prose.snippet_candidate(t), prose.avg_sentence_words(t))[:2] == (None, 0)


@pytest.mark.parametrize(("words", "verdict"), [(19, "insufficient_content"), (20, "tight")])
def test_copy_precision_needs_words(spark, words, verdict):
    assert one(spark, "abc " * words, prose.copy_precision(t))[0].verdict == verdict


@pytest.mark.parametrize("bank", ["PHRASES", "ASIDES"])
def test_patterns_compile_in_both_dialects(spark, bank):
    import duckdb

    for p in getattr(banks, bank):
        duckdb.execute("SELECT regexp_matches('x', ?)", [p.regex]).fetchall()
        one(spark, "x", T.count(t, p.regex))


POSITIVE = {
    "negation_pivot_but": "not a thing but", "negation_pivot_em_dash": "never a thing — always", "delve_only": "Delving", "leverage_foster_underscore": "fosters", "tapestry_family": "pivotal", "nuanced_interplay": "nuanced",
    "realm_landscape": "in the realm of", "era_opener": "in an era where", "today_fast_paced": "in today's digital", "ever_evolving": "ever-changing", "testament_to": "stands as a testament to", "it_worth_noting": "it's worth noting",
    "navigate_complexities": "navigating the complexities", "bold_colon_header": "**Label:** x", "false_conclusion_opener": "In conclusion, x", "not_only_but_also": "not only this thing but also", "unlock_potential": "unlock the power",
    "paramount_importance": "of paramount importance", "seamlessly_integrate": "seamlessly integrates", "world_of_x": "welcome to the world of", "hedge_stack": "perhaps it might", "furthermore_moreover": "moreover",
}


def test_each_phrase_fires_alone(spark):
    rows = spark.createDataFrame([(k, v) for k, v in POSITIVE.items()], "k string, t string").select("k", banks.bank_hits(t, banks.PHRASES, 20).alias("h")).collect()
    assert len(rows) == 22
    for r in rows:
        assert r.k in [h.kind for h in r.h], r.k
    assert one(spark, "plain words stand here", banks.bank_hits(t, banks.PHRASES, 20))[0] == []


def test_caps(spark):
    r = one(spark, "delve " * 21 + "moreover " * 21, banks.ai_slop(t))[0]
    assert len(r.signals) == 40 and r.verdict == "likely_ai"
    assert r.density_per_1000_words == round((20 + 20 * 0.6) / 42 * 1000, 2)


def test_heading_skeleton(spark):
    names = F.array(*[F.lit(x) for x in ("Introduction", "1. FAQ", "introduction", "Other", "  ")])
    r = one(spark, "", banks.heading_skeleton(names))[0]
    assert r.matched == ["introduction"] and r.jaccard == round(1 / 25, 3)


@pytest.mark.parametrize(
    ("text", "date"),
    [("2026-12-31", "2026-12-31"), ("30 Dec 2026", "2026-12-30"), ("December 30, 2026", "2026-12-30"), ("Dec 30,2026", "2026-12-30"), ("12/31/26", "2026-12-31"), ("31 Foo 2026", "2026-01-01"), ("12/31/2026", "2026-12-31"), ("31/12/2026", "2026-12-31"), ("2026", "2026-01-01"), ("Dec. 30 2026", "2026-01-01"), ("x", None)],
)
def test_visible_dates(spark, text, date):
    assert one(spark, text, dates.parse_visible_date(t))[0] == (date and datetime.date.fromisoformat(date))


@pytest.mark.parametrize(("text", "date"), [("2026-05-01T23:30:00-05:00", "2026-05-02"), ("2026-05-01T10:00:00", "2026-05-01"), ("2026-05-01", "2026-05-01"), ("05/01/2026", None), ("é026-05-01", None), (None, None)])
def test_declared_dates(spark, text, date):
    assert one(spark, text, dates.parse_date(t))[0] == (date and datetime.date.fromisoformat(date))


@pytest.mark.parametrize(("gap", "severity"), [(30, "none"), (31, "mild"), (180, "mild"), (181, "severe"), (-400, "none")])
def test_date_gap(spark, gap, severity):
    day = datetime.date(2026, 1, 1)
    markup = f'"dateModified": "{day}" <time datetime="{day - datetime.timedelta(gap)}">'
    assert one(spark, markup, freshness.freshness(t, F.lit("a b"), F.lit(day)))[0].schema_vs_visible_severity == severity


def test_design(spark):
    html = '<div class="border-l-4">\n<div class="border-l-3 rounded">\n<p style="border-left-width: 3px">\n<span style="border-left-width: 9px">\n<i style="transition: all 1s, width 2s">'
    assert [f.id for f in one(spark, html, design.line_findings(t))[0]] == ["side-tab"] * 3
    assert one(spark, "\n".join(["p{font-family: 'Foo', serif}"] * 20), design.single_font(t))[0] == "only font used is foo"
    assert one(spark, "\n".join(["p{font-family: 'Foo', serif}"] * 19), design.single_font(t))[0] is None
    r = one(spark, "animate-bounce " * 60, design.design_slop(t))[0]
    assert len(r.findings) == 50 and r.counts == {"bounce-easing": 60} and r.verdict == "heavy"


def test_hosts(spark):
    got = [one(spark, u, page.host_of(t))[0] for u in ("HTTPS://Www.A.b:80/x", "//u@h?x", "/x", "mailto:a@b", "http://")]
    assert got == ["www.a.b:80", "u@h", None, None, None]
    flags = [one(spark, h, page.is_authority(t))[0] for h in ("www.bbc.co.uk", "notbbc.co.uk", "xedu", "cs.ox.ac.uk", "nih.gov.evil.com")]
    assert flags == [True, False, True, True, False]


IMAGES = {
    "89504E470D0A1A0A0000000D49484452000004B000000276": (1200, 630),
    "474946383961" + "2003A201": (800, 418),
    "52494646000000005745425056503858" + "00" * 8 + "AF0400" + "750200": (1200, 630),
    "52494646000000005745425056503820" + "00" * 7 + "9D012A" + "B0047602": (1200, 630),
    "5249464600000000574542505650384C" + "00000000" + "2F" + "AF445D00" + "0000000000": (1200, 374),
    "FFD8FFE000040000FFC00011080276" + "04B003": (1200, 630),
    "3C68746D6C3E": None,
    "FFD8FFE0": None,
    "": None,
}


def test_images(spark):
    rows = spark.createDataFrame([(bytes.fromhex(k),) for k in IMAGES], "b binary").select(images.dimensions(F.col("b")).alias("d"), images.looks_like_image(F.col("b")).alias("i")).collect()
    assert [tuple(r.d) if r.d else None for r in rows] == list(IMAGES.values())
    assert [r.i for r in rows] == [True] * 6 + [False, True, False]
