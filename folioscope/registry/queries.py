"""The registered queries of the audit engine: name to (spark, folder) -> DataFrame."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import banks, corpus, design, freshness, page, prose, verify
from ..plans import audit as plan
from ..sinks import reports
from ..sources import crawl, images
from ..sources.documents import markdown_to_html, with_markup
from ..sources.html import parsed
from ..streaming import landing
from . import samples

#: The day that stands for today in every registered query.
AS_OF = datetime.date(2024, 6, 1)


def _body(spark, sf_dir, **columns: Column) -> DataFrame:
    return samples.prose(spark, sf_dir).select("doc_id", *[v.alias(k) for k, v in columns.items()])


def _b() -> Column:
    return F.col("body_text")


def _joined(rows: Column, *fields: str) -> Column:
    """An array of structs as text."""
    return F.array_join(F.transform(rows, lambda r: F.concat_ws(":", *[r[f].cast("string") for f in fields])), "|")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.plain(spark, sf_dir).select("doc_id", T.n_tokens(_b()).alias("n_ws"), T.n_words(_b()).alias("n_words"))


def sentence_stats(spark, sf_dir):
    return samples.plain(spark, sf_dir).select("doc_id", prose.quotable_sentences(_b()).alias("quotable"), prose.avg_sentence_words(_b()).alias("avg_words"))


def keyword_counts(spark, sf_dir):
    return prose.keyword_counts(samples.prose(spark, sf_dir))


def keywords(spark, sf_dir):
    return _body(spark, sf_dir, k=prose.keywords(_b())).select("doc_id", _joined(F.col("k.primary"), "term", "count").alias("terms"), F.array_join("k.questions", "|").alias("questions"))


def people(spark, sf_dir):
    return _body(spark, sf_dir, p=prose.people(_b())).select("doc_id", F.posexplode_outer("p").alias("pos", "p")).where("pos is not null").select("doc_id", "pos", "p.name", "p.credentials")


def organizations(spark, sf_dir):
    rows = samples.prose(spark, sf_dir)
    heads = samples.titles(spark, sf_dir).select("doc_id", F.explode("headings").alias("heading"))
    heads = heads.unionByName(rows.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "the smith foundation").otherwise("none").alias("heading")))
    return prose.organization_counts(rows, heads)


def organizations_by_row(spark, sf_dir):
    none = F.array(F.lit("acme research institute"))
    return _body(spark, sf_dir, organizations=F.array_join(prose.organizations(_b(), F.when(F.col("doc_id") % 2 == 0, none).otherwise(F.array().cast("array<string>"))), "|"))


def evidence(spark, sf_dir):
    return _body(spark, sf_dir, e=prose.evidence(_b())).select("doc_id", "e.stat_count", "e.quote_count", _joined(F.col("e.unsupported_claims"), "snippet", "position_pct").alias("claims"))


def snippet_candidate(spark, sf_dir):
    return _body(spark, sf_dir, snippet=prose.snippet_candidate(_b()))


def position_bias(spark, sf_dir):
    rows = _body(spark, sf_dir, p=prose.position_bias(_b()))
    return rows.select("doc_id", "p.total_words", "p.tldr_position_pct", "p.first_stat_position_pct", "p.first_credential_position_pct", F.size("p.warnings").alias("warnings"))


def information_gain(spark, sf_dir):
    rows = _body(spark, sf_dir, g=prose.information_gain(_b()))
    return rows.select("doc_id", "g.score", *[F.col(f"g.counts.{k}").alias(k) for k in prose.ORIGINALITY], F.size("g.samples").alias("samples"))


def copy_precision(spark, sf_dir):
    rows = _body(spark, sf_dir, c=prose.copy_precision(_b()))
    names = [*prose.PRECISION, "sentences"]
    return rows.select("doc_id", "c.score", "c.verdict", *[F.col("c.counts")[k].alias(k) for k in names], *[F.col("c.densities")[k].alias(k) for k in ("filler_per_1k", "sentence_length_var_ratio", "avg_word_length_chars", "concrete_per_100_words")])


def ai_slop_density(spark, sf_dir):
    return _body(spark, sf_dir, density=banks.phrase_density(_b())).withColumn("verdict", banks.phrase_verdict(F.col("density")))


def _signals(rows: DataFrame) -> DataFrame:
    hits = rows.select("doc_id", F.posexplode_outer("x.signals").alias("pos", "s")).where("pos is not null")
    return hits.groupBy("doc_id", F.col("s.kind").alias("kind")).agg(F.count("*").alias("hits"), F.min_by("s.position_pct", "pos").alias("first_pct"), F.min_by("s.snippet", "pos").alias("first_snippet"))


def ai_slop_signals(spark, sf_dir):
    return _signals(_body(spark, sf_dir, x=banks.ai_slop(_b())))


def metatext_signals(spark, sf_dir):
    return _signals(_body(spark, sf_dir, x=banks.metatext(_b(), F.array().cast("array<string>"))))


def metatext_verdict(spark, sf_dir):
    rows = samples.prose(spark, sf_dir).join(samples.titles(spark, sf_dir), "doc_id").select("doc_id", banks.metatext(_b(), F.col("headings")).alias("x"))
    return rows.select("doc_id", F.col("x.weighted_score_per_1000_words").alias("density"), "x.heading_skeleton.jaccard", F.array_join("x.heading_skeleton.matched", "|").alias("matched"), "x.verdict")


def freshness_dates(spark, sf_dir):
    rows = samples.dated(spark, sf_dir).select("doc_id", freshness.freshness(F.col("html_like"), _b(), F.lit(AS_OF)).alias("f"))
    return rows.select("doc_id", "f.date_modified", "f.date_published", "f.days_since_modified", "f.time_datetime", "f.visible_updated_label", F.array_join(F.transform("f.year_mentions", lambda y: y.cast("string")), "|").alias("years"), F.col("f.schema_vs_visible_severity").alias("severity"))


def design_line_hits(spark, sf_dir):
    return design.line_hit_counts(samples.styles(spark, sf_dir))


def design_documents(spark, sf_dir):
    h = F.col("html_like")
    return samples.styles(spark, sf_dir).select("doc_id", design.single_font(h).alias("font"), design.monotonous_spacing(h).alias("spacing"), design.everything_centered(h).alias("centered"))


def design_verdict(spark, sf_dir):
    rows = samples.styles(spark, sf_dir).select("doc_id", design.design_slop(F.col("html_like")).alias("d"))
    return rows.select("doc_id", "d.verdict", F.size("d.counts").alias("kinds"), F.size("d.findings").alias("findings"))


def heading_order(spark, sf_dir):
    k = F.col("doc_id")
    levels = F.transform(F.sequence(F.lit(0).cast("bigint"), k % 5 + 1), lambda i: F.struct(F.when(i == 0, (k % 9 == 0).cast("tinyint") + 1).otherwise((k * 3 + i * i) % 4 + 1).cast("tinyint").alias("level"), samples.choose(k + i, samples.TITLES).alias("text")))
    rows = samples.table(spark, sf_dir, "documents").select("doc_id", levels.alias("hs"))
    return rows.select("doc_id", page.hierarchy_violation(F.col("hs")).alias("violation"), page.duplicate_headings(F.transform("hs", lambda h: h["text"])).alias("duplicates"))


def markdown_lite(spark, sf_dir):
    k = F.col("doc_id")
    front = F.when(k % 3 == 0, F.lit("---\ntitle: x\n---\n")).when(k % 3 == 1, F.lit("---\nopen\n")).otherwise(F.lit(""))
    head = F.concat(F.when(k % 4 == 0, F.lit("# ")).when(k % 4 == 1, F.lit("  ## ")).when(k % 4 == 2, F.lit("### ")).otherwise(F.lit("#### ")), F.lit("A & B <c>\r\n\n"))
    return samples.table(spark, sf_dir, "documents").select("doc_id", markdown_to_html(F.concat(front, head, "text")).alias("html"))


def _pages(spark, sf_dir) -> DataFrame:
    return parsed(with_markup(samples.pages(spark, sf_dir)))


def page_metadata(spark, sf_dir):
    rows = _pages(spark, sf_dir)
    p = F.col("parsed")
    rows = rows.select("doc_id", page.meta(p).alias("m"), page.open_graph(p).alias("o"), p["schema_types"].alias("t"))
    return rows.select("doc_id", "m.title", F.length("m.description").alias("n_description"), "m.canonical", F.col("o.image").alias("og_image"), F.col("o.title").alias("og_title"), F.col("o.url").alias("og_url"), F.array_join("t", "|").alias("schema_types"))


def page_body_text(spark, sf_dir):
    rows = samples.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("html_like"))
    return parsed(rows).select("doc_id", "body_text", T.n_words(_b()).alias("word_count"), F.array_join(page.headings(F.col("parsed"), 1), "|").alias("h1"), F.col("parsed.html_lang").alias("lang"))


def page_links(spark, sf_dir):
    p = F.col("parsed")
    return _pages(spark, sf_dir).select("doc_id", page.link_graph(p, page.meta(p)["canonical"]).alias("g")).select("doc_id", "g.*")


def authority_links(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("doc_id", F.explode_outer("parsed.anchors").alias("a")).select("doc_id", page.host_of(F.col("a.href")).alias("host")).where("host is not null")
    return page.authority_links(rows).groupBy("host").agg(F.count("*").alias("links"))


def page_performance(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("doc_id", page.performance(F.col("parsed"), F.col("html_like")).alias("p"))
    return rows.select("doc_id", "p.images.*", "p.render_blocking.*", "p.resource_hints.preload", F.col("p.fonts.external_link_count").alias("font_links"), "p.inline_bytes.inline_css", "p.inline_bytes.inline_js")


def _audits(spark, sf_dir) -> DataFrame:
    return plan.audit(samples.pages(spark, sf_dir), AS_OF)


def audit_scores(spark, sf_dir):
    return _audits(spark, sf_dir).select("doc_id", "score", F.array_join(F.transform("score_breakdown.components", lambda c: F.concat(c["name"], F.lit(":"), c["deducted"])), "|").alias("components"))


def audit_findings(spark, sf_dir):
    """All findings of all rules; the tests hold the rules against fixtures, ``rule_findings`` has SQL for a part."""
    return plan.findings_long(_audits(spark, sf_dir)).select("doc_id", "rule_id", "factor", "message")


def rule_findings(spark, sf_dir):
    """The findings of given rules: those of metadata, previews, structure and links."""
    rows = plan.findings_long(_audits(spark, sf_dir))
    return rows.where(F.col("rule_id").isin(FINDINGS)).select("doc_id", "rule_id", "factor", "message")


#: Rules whose conditions the SQL of ``rule_findings`` states.
FINDINGS = ["desc_absent", "desc_short", "desc_long", "og_title_absent", "og_image_absent", "og_image_relative", "og_image_dims", "og_image_alt", "og_description_absent", "og_type_absent", "twitter_card_absent", "canonical_absent", "viewport_absent", "h2_few", "img_alt_missing", "jsonld_absent", "stale_90", "perf_lazy", "perf_dims", "perf_blocking_script", "perf_font_display", "perf_lcp_preload", "link_generic", "date_mismatch_severe"]


def factor_filter(spark, sf_dir):
    kept = plan.audit(samples.pages(spark, sf_dir), AS_OF, factors=plan.parse_factors("og, Schema"))
    return plan.findings_long(kept).groupBy("rule_id").agg(F.count("*").alias("documents"))


def verify_diff(spark, sf_dir):
    before = samples.titles(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), F.lit(60).alias("score"), F.col("headings").alias("suggestions")).where("doc_id % 10 <> 0")
    shifted = samples.titles(spark, sf_dir).select((F.col("doc_id") + 3).cast("string").alias("file"), F.lit(70).alias("score"), F.col("headings").alias("suggestions"))
    rows = verify.verify(before, shifted)
    return rows.select("file", "score_change", *[F.array_join(c, "|").alias(c) for c in ("fixed", "regressed", "still_present")], "verdict")


def verify_long(spark, sf_dir):
    rows = samples.titles(spark, sf_dir)
    before = rows.select("doc_id", F.explode("headings").alias("message"))
    now = rows.select((F.col("doc_id") + 3).alias("doc_id"), F.explode("headings").alias("message"))
    return verify.verify_long(before, now, ["doc_id", "message"]).groupBy("status").agg(F.count("*").alias("findings"))


ROBOTS = ["noindex", "NoFollow, noindex", "nofollow;noarchive", "none", "all", "noai , noimageindex", "max-snippet:5"]


def header_rules(spark, sf_dir):
    k = F.col("o_orderkey")
    robots = F.when(k % 8 != 7, samples.choose(k % 8, ROBOTS))
    rows = samples.table(spark, sf_dir, "orders").select(k.alias("doc_id"), crawl.header_findings(robots, F.when(k % 3 == 0, F.lit("gzip")), k * 7).alias("f"), crawl.status_class((k % 6 * 100 + k % 40).cast("int")).alias("status_class"))
    return rows.select("doc_id", F.array_join(F.transform("f", lambda x: x["rule_id"]), "|").alias("rules"), "status_class")


def _image_bytes(k: Column) -> Column:
    big = F.lpad(F.hex(k % 1500 + 1), 8, "0")
    high = F.lpad(F.hex(k % 900 + 1), 8, "0")
    le = lambda x: F.concat(F.lpad(F.hex(x % 256), 2, "0"), F.lpad(F.hex(F.floor(x / 256)), 2, "0"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big, high)
    gif = F.concat(F.lit("474946383961"), le(k % 1500 + 1), le(k % 900 + 1))
    return F.unhex(F.when(k % 3 == 0, png).when(k % 3 == 1, gif).otherwise(F.lit("3C68746D6C3E3C2F68746D6C3E")))


def image_probe(spark, sf_dir):
    k = F.col("o_orderkey")
    data = _image_bytes(k)
    rows = samples.table(spark, sf_dir, "orders").select(k.alias("doc_id"), data.alias("data"))
    rows = rows.select("doc_id", F.coalesce(images.png_dimensions(F.col("data")), images.gif_dimensions(F.col("data"))).alias("d"), images.looks_like_image(F.col("data")).alias("is_image"))
    return rows.select("doc_id", "d.width", "d.height", "is_image")


def image_rules(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, 404).when(k % 7 != 0, 200)
    kind = F.when(k % 3 == 2, F.lit("text/html")).otherwise(F.lit("image/png"))
    rows = samples.table(spark, sf_dir, "orders").select(k.alias("doc_id"), crawl.image_findings(F.lit("https://x.example/i.png"), status, kind, crawl.image_probe(kind, _image_bytes(k)), F.lit("1200")).alias("f"))
    return rows.select("doc_id", F.array_join(F.transform("f", lambda x: x["rule_id"]), "|").alias("rules"))


def jsonld(spark, sf_dir):
    from ..operators import jsonld as build

    c = F.col
    rows = samples.table(spark, sf_dir, "customer")
    made = build.organization(c("c_name"), F.when(c("c_custkey") % 2 == 0, F.concat(F.lit("https://x.example/"), c("c_custkey").cast("string"))), same_as=F.when(c("c_custkey") % 3 == 0, F.array(c("c_mktsegment"))).otherwise(F.array().cast("array<string>")))
    faq = build.faq(F.array(F.concat(c("c_name"), F.lit(" :: "), c("c_mktsegment")), F.when(c("c_custkey") % 4 == 0, F.lit("no separator")).otherwise(F.lit("a::b::c"))))
    rows = rows.select("c_custkey", made.alias("o"), faq.alias("q"))
    at = lambda j, path: F.get_json_object(j, path)
    return rows.select("c_custkey", at(c("o"), "$.name").alias("name"), at(c("o"), "$.url").alias("url"), at(c("o"), "$.sameAs[0]").alias("same_as"), at(c("q"), "$.mainEntity[0].acceptedAnswer.text").alias("answer"), at(c("q"), "$.mainEntity[1].acceptedAnswer.text").alias("second"))


def sarif_results(spark, sf_dir):
    rows = samples.titles(spark, sf_dir).select("doc_id", F.explode(reports.sarif_results(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.col("headings"))).alias("r"))
    return rows.select(F.col("r.locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("uri"), F.col("r.level").alias("level"), F.col("r.message.text").alias("text"))


def _scores(spark, sf_dir) -> DataFrame:
    """A score for each document, and the source to group by."""
    return samples.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.greatest(F.lit(0), 100 - (F.col("doc_id") * 37 % 83).cast("int")).alias("score"))


def score_histogram(spark, sf_dir):
    return corpus.score_histogram(_scores(spark, sf_dir))


def score_rank(spark, sf_dir):
    return corpus.rank_by(_scores(spark, sf_dir), "source")


def quality_gate(spark, sf_dir):
    return corpus.quality_gate(_scores(spark, sf_dir), 60)


def rule_prevalence(spark, sf_dir):
    rows = samples.titles(spark, sf_dir).select("doc_id", F.explode("headings").alias("rule_id")).withColumn("factor", F.length("rule_id") % 3)
    return corpus.rule_prevalence(rows)


def findings_rollup(spark, sf_dir):
    rows = samples.titles(spark, sf_dir).join(_scores(spark, sf_dir), "doc_id").select("lang", F.explode("headings").alias("rule_id"))
    return corpus.rollup_by(rows, "lang", "rule_id")


def event_windows(spark, sf_dir):
    rows = landing.windowed(samples.table(spark, sf_dir, "events"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark, sf_dir):
    rows = landing.sessions(samples.table(spark, sf_dir, "events"))
    return rows.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


def audit_reports(spark, sf_dir):
    """The whole report of each page as JSON; SQL can't express it, the tests hold it against fixtures."""
    return _audits(spark, sf_dir).select("doc_id", "score", F.length(reports.envelope(F.struct("file", "score", "suggestions", "content"))).alias("n_json"), F.size("suggestions").alias("n_suggestions"))


def jsonld_documents(spark, sf_dir):
    from ..operators import jsonld as build

    c, k = F.col, F.col("c_custkey")
    odd = F.when(k % 2 == 1, c("c_mktsegment"))
    rows = samples.table(spark, sf_dir, "customer").select(
        k,
        build.article(c("c_name"), c("c_mktsegment"), F.lit("2024-01-01"), c("c_name"), modified=F.when(k % 3 == 0, F.lit("2024-02-02")), credentials=odd, org_name=odd, org_url=F.lit("https://o.example"), url=F.when(k % 5 == 0, F.lit("https://x.example")), image=odd).alias("a"),
        build.howto(c("c_name"), F.array(c("c_mktsegment"), F.lit("done")), description=odd).alias("h"),
        build.person(c("c_name"), job_title=odd, works_for=odd).alias("p"),
    )
    at = lambda j, path: F.get_json_object(c(j), path)
    return rows.select(
        "c_custkey",
        at("a", "$.dateModified").alias("modified"),
        at("a", "$.author.honorificSuffix").alias("suffix"),
        at("a", "$.publisher.name").alias("publisher"),
        at("a", "$.mainEntityOfPage.@id").alias("page"),
        at("h", "$.step[1].position").alias("position"),
        at("h", "$.step[0].text").alias("step"),
        at("p", "$.worksFor.name").alias("employer"),
        F.concat_ws(",", *[F.array_join(F.json_object_keys(c(j)), ",") for j in "ahp"]).alias("keys"),
    )


QUERIES = [
    word_counts, sentence_stats, keyword_counts, keywords, people, organizations, organizations_by_row, evidence, snippet_candidate, position_bias, information_gain,
    copy_precision, ai_slop_density, ai_slop_signals, metatext_signals, metatext_verdict, freshness_dates, design_line_hits, design_documents, design_verdict, heading_order,
    markdown_lite, page_metadata, page_body_text, page_links, authority_links, page_performance, audit_scores, audit_findings, rule_findings, factor_filter, verify_diff, verify_long, header_rules,
    image_probe, image_rules, jsonld, jsonld_documents, sarif_results, score_histogram, score_rank, quality_gate, rule_prevalence, findings_rollup, event_windows, event_sessions, audit_reports,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
