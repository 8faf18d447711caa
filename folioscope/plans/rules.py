"""Rules that turn features into findings, in their order, and deductions from the score.

A rule is one row: place, id, factor and the column of its message, which is null where it doesn't
fire.  The messages are fixed values: two audits are compared by them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import page

#: Schema types of an article.
ARTICLES = ["Article", "NewsArticle", "BlogPosting", "ScholarlyArticle", "TechArticle"]


@dataclass(frozen=True)
class Rule:
    id: str
    factor: str
    #: message, or null, of a row with the audit's features
    message: Column


def _say(condition: Column, *parts) -> Column:
    """The message where the condition holds."""
    return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def _fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def is_article(types: Column) -> Column:
    return F.arrays_overlap(types, F.array(*[F.lit(a) for a in ARTICLES]))


def is_absolute(url: Column) -> Column:
    return url.startswith("https://") | url.startswith("http://")


def audit_rules() -> list[Rule]:
    """The rules of an audit over the columns that ``features`` makes, in order."""
    c = F.col
    title, desc = c("meta.title"), c("meta.description")
    image, words, lang = c("open_graph.image"), c("content.word_count"), c("content.html_lang")
    types, robots = c("schema_types"), F.lower(c("meta.robots"))
    n_title, n_desc = F.length(title), F.length(desc)
    https = image.startswith("https://")
    og_url, canonical = c("open_graph.url"), c("meta.canonical")
    bare = lambda u: F.regexp_replace(u, "/+$", "")
    warnings = c("position_bias.warnings")
    days, modified = c("freshness.days_since_modified"), c("freshness.date_modified")
    slop, info, metatext, copy, design = (c(x) for x in ("ai_slop", "information_gain", "metatext", "copy_precision", "design_slop"))
    images, blocking, fonts, inline = (c(f"performance.{x}") for x in ("images", "render_blocking", "fonts", "inline_bytes"))
    links = c("link_graph")
    matched = metatext["heading_skeleton"]["matched"]
    severity = c("freshness.schema_vs_visible_severity")
    noindex, nofollow = F.contains(robots, F.lit("noindex")), F.contains(robots, F.lit("nofollow"))
    article_undated = modified.isNull() & is_article(types)
    return [
        Rule("title_absent", "meta", _say(title.isNull(), "Title absent. Aim 50..60 chars.")),
        Rule("title_short", "meta", _say(n_title < 30, "Title is ", n_title, " chars. Aim 50..60.")),
        Rule("title_long", "meta", _say(n_title > 70, "Title is ", n_title, " chars. Mobile snippets truncate around 70.")),
        Rule("desc_absent", "meta", _say(desc.isNull(), "Meta description absent. 150..160 chars.")),
        Rule("desc_short", "meta", _say(n_desc < 100, "Meta description is ", n_desc, " chars. Aim 150..160.")),
        Rule("desc_long", "meta", _say(n_desc > 170, "Meta description is ", n_desc, " chars. Snippets truncate past 160.")),
        Rule("og_title_absent", "og", _say(c("open_graph.title").isNull(), "og:title absent.")),
        Rule("og_image_absent", "og", _say(image.isNull(), "og:image absent. Shares and AI-citation previews render bare. Ship 1200×630 (1.91:1), absolute https URL.")),
        Rule("og_image_relative", "og", _say(~is_absolute(image), "og:image is not an absolute URL (`", image, "`). Crawlers resolve it against nothing — the preview silently fails everywhere. Use the full https URL.")),
        Rule("og_image_http", "og", _say(image.startswith("http://"), "og:image is plain http. Platforms that refuse mixed content drop the preview — serve it over https.")),
        Rule("og_image_dims", "og", _say(https & (c("open_graph.image_width").isNull() | c("open_graph.image_height").isNull()), "og:image:width/height absent. The first share of any page renders imageless while the crawler fetches the file — declare 1200 and 630.")),
        Rule("og_image_alt", "og", _say(https & c("open_graph.image_alt").isNull(), "og:image:alt absent. Screen readers and multimodal retrieval read it.")),
        Rule("og_description_absent", "og", _say(image.isNotNull() & c("open_graph.description").isNull(), "og:description absent. Platforms fall back to the meta description; AI previews may show arbitrary page text instead.")),
        Rule("og_url_canonical_mismatch", "og", _say(bare(og_url) != bare(canonical), "og:url (`", og_url, "`) and canonical (`", canonical, "`) disagree. Shares and citations split across two URLs — align them.")),
        Rule("og_type_absent", "og", _say(c("open_graph.type").isNull() & is_article(types), "og:type absent on an Article page. Declare `og:type=article`.")),
        Rule("twitter_card_absent", "og", _say(c("twitter_card.card").isNull() & image.isNotNull(), "twitter:card absent. X falls back to OG for text and image but renders the small card — add `twitter:card=summary_large_image`.")),
        Rule("canonical_absent", "meta", _say(canonical.isNull(), "Canonical link absent. Without it, near-duplicate URLs dilute Google's index and confuse downstream retrieval.")),
        Rule("robots_noindex", "meta", _say(noindex, "Robots meta is `", c("meta.robots"), "`. Page is excluded from search and AI retrieval.")),
        Rule("robots_nofollow", "meta", _say(~noindex & nofollow, "Robots meta is `", c("meta.robots"), "`. Links on this page pass no authority.")),
        Rule("viewport_absent", "meta", _say(c("meta.viewport").isNull(), "Viewport meta absent. Mobile rendering breaks; Google indexes mobile-first.")),
        Rule("h1_absent", "content", _say(F.size("content.h1") == 0, "H1 absent.")),
        Rule("h1_multiple", "content", _say(F.size("content.h1") > 1, F.size("content.h1"), " H1s. Use one; demote the rest.")),
        Rule("h2_few", "content", _say(F.size("content.h2") < 2, F.size("content.h2"), " H2s in main content. H2s act as passage anchors for AI retrieval; one or zero H2s makes the page hard to chunk.")),
        Rule("thin_body", "content", _say(words < 300, "Body is ", words, " words. Thin pages rarely satisfy substantive queries.")),
        Rule("no_answer_block", "content", _say(~c("content.has_tldr") & (words >= 150), "No answer-first summary detected. State the core answer in the opening 40..60 words; a label (TL;DR, Key takeaways) helps extraction but is optional.")),
        Rule("no_credentials", "content", _say(~c("content.has_credentials") & c("content.has_author") & F.coalesce(lang.startswith("en"), F.lit(True)), "Author byline present but no visible credentials. Credentials help entity disambiguation and reviewer trust on YMYL pages.")),
        Rule("img_alt_missing", "content", _say(c("content.missing_alt_count") > 0, c("content.missing_alt_count"), " images missing alt text. Multimodal AI search reads alt.")),
        Rule("html_lang_absent", "content", _say(lang.isNull(), "`<html lang>` absent. Multilingual AI retrieval relies on it.")),
        Rule("jsonld_absent", "schema", _say(F.size(types) == 0, "No JSON-LD. Article + Organization at minimum; FAQ for question pages.")),
        Rule("faqpage_light", "schema", _say(F.array_contains(types, "FAQPage") & (words < 800), "FAQPage schema no longer earns a Google rich result (retired 7 May 2026). Keep it on FAQ-heavy pages — Bing and AI platforms still read it — but it's dead weight on a page this light.")),
        Rule("schema_dense", "schema", _say(F.size(types) > 8, F.size(types), " JSON-LD @types on one page. Past ~8 distinct types the maintenance burden outweighs the ranking signal — collapse overlapping types (Product+Offer+Service, etc.).")),
        Rule("noscript_boilerplate", "content", _say(c("content.noscript_kind") == "boilerplate_only", '`<noscript>` only says "enable JavaScript". Crawlers see nothing on JS-only pages.')),
        Rule("heading_hierarchy", "content", page.hierarchy_violation(c("content.headings_in_order"))),
        Rule("heading_duplicate", "content", _say(c("content.duplicate_heading_count") > 0, c("content.duplicate_heading_count"), " duplicate heading", _plural(c("content.duplicate_heading_count")), ". Headings are passage anchors for AI retrieval; identical text confuses fan-out.")),
        Rule("heading_empty", "content", _say(c("content.empty_heading_count") > 0, c("content.empty_heading_count"), " empty heading tag", _plural(c("content.empty_heading_count")), ". Delete or fill — empty headings break outline navigation.")),
        Rule("no_table", "content", _say((c("content.table_count") == 0) & (words >= 800), "No `<table>` elements. Perplexity and AI Mode lift pages with comparison tables on listy content.")),
        Rule("few_quotable", "content", _say((words >= 400) & (c("content.quotable_sentence_count") < 5), "Only ", c("content.quotable_sentence_count"), " quotable sentence", _plural(c("content.quotable_sentence_count")), " (5..25 words). AI assistants cite short complete sentences verbatim — add a few standalone claims.")),
        Rule("hreflang_absent", "content", _say(~lang.startswith("en") & (F.size("content.hreflangs") == 0), "Non-English page with no `<link rel=alternate hreflang>` alternates. AI engines down-rank lone translations.")),
        Rule("date_modified_absent", "freshness", _say(article_undated, 'dateModified absent on Article schema. Freshness signals matter on news, evolving topics, and any page where the user reasonably asks "is this current?"')),
        Rule("stale_90", "freshness", _say(~article_undated & (days > 90), "Last modified ", days, " days ago. If the topic moves, refresh and update dateModified.")),
        *[Rule(f"position_{k + 1}", "position", F.get(warnings, F.lit(k))) for k in range(3)],
        Rule("ai_slop_suspicious", "content", _say(slop["verdict"] == "suspicious", "AI-slop density ", _fixed(slop["density_per_1000_words"], 1), "/1000 words. ", F.size(slop["signals"]), ' signals. Review for tells like "delve", "tapestry", negation pivots.')),
        Rule("ai_slop_likely", "content", _say(slop["verdict"] == "likely_ai", "AI-slop density ", _fixed(slop["density_per_1000_words"], 1), "/1000 words (", F.size(slop["signals"]), " signals). Heavy LLM-writing fingerprint. Rewrite the worst sections.")),
        Rule("information_gain_weak", "content", _say((words >= 300) & (info["score"] <= 1), "Information Gain ", info["score"], "/10. Rewritten / templated content reads weak. Add named-source quotes, sample sizes (n=…), YoY deltas, first-party evidence.")),
        Rule("information_gain_below", "content", _say((words >= 300) & info["score"].between(2, 4), "Information Gain ", info["score"], "/10. Below the competitive band (5..7). Add first-party data: named quotes, methodology, sample sizes.")),
        Rule("metatext_suspicious", "content", _say(metatext["verdict"] == "suspicious", "Metatext density ", _fixed(metatext["weighted_score_per_1000_words"], 2), "/1000 words. ", F.size(metatext["signals"]), " signals. Check for process narration, hedges, closing pleasantries.")),
        Rule("metatext_skeleton", "content", _say((metatext["verdict"] == "metatext_heavy") & (F.size(matched) > 0), "Metatext heavy: density ", _fixed(metatext["weighted_score_per_1000_words"], 2), "/1000 words + heading skeleton matches AI table-of-contents (", F.size(matched), " of: ", F.array_join(matched, ", "), "). Rewrite without process narration.")),
        Rule("metatext_heavy", "content", _say((metatext["verdict"] == "metatext_heavy") & (F.size(matched) == 0), "Metatext heavy: density ", _fixed(metatext["weighted_score_per_1000_words"], 2), "/1000 words, ", F.size(metatext["signals"]), " signals. Strong agent-speaking-not-content fingerprint.")),
        Rule("copy_mid", "content", _say(copy["verdict"] == "mid", "Copy precision ", _fixed(copy["score"], 1), "/10 (mid). Cut filler words and empty-emphasis adjectives; favour concrete nouns and numbers.")),
        Rule("copy_padded", "content", _say(copy["verdict"] == "padded", "Copy precision ", _fixed(copy["score"], 1), "/10 (padded). Heavy filler / hedge / empty-emphasis density. Rewrite for load-bearing words only.")),
        Rule("design_suspicious", "content", _say(design["verdict"] == "suspicious", "Design-slop verdict: suspicious (", F.size(design["findings"]), " hits across ", F.size(design["counts"]), " kinds). Common 2026 AI tells present.")),
        Rule("design_heavy", "content", _say(design["verdict"] == "heavy", "Design-slop verdict: heavy (", F.size(design["findings"]), " hits across ", F.size(design["counts"]), " kinds). Reads as templated AI-generated UI; differentiate the palette, fonts, and layout.")),
        Rule("perf_lazy", "content", _say(images["eligible_for_lazy_missing"] > 0, images["eligible_for_lazy_missing"], " below-the-fold image", _plural(images["eligible_for_lazy_missing"]), ' without `loading="lazy"`. Lazy-load every image past the first two to cut initial bytes.')),
        Rule("perf_dims", "content", _say(images["missing_dimensions"] > 0, images["missing_dimensions"], " of ", images["total"], " `<img>` missing width/height. CLS risk unless reserved via CSS `aspect-ratio` / fixed-size container.")),
        Rule("perf_filenames", "content", _say(images["non_descriptive_filenames"] > 0, images["non_descriptive_filenames"], " image filename", _plural(images["non_descriptive_filenames"]), " look templated (IMG_1234, DSC00012, screenshot.png). Rename — image search and multimodal AI read the filename.")),
        Rule("perf_modern_format", "content", _say((images["total"] >= 4) & (images["modern_format_via_picture"] == 0) & (images["modern_format_via_src"] == 0), "No WebP / AVIF / JXL detected. Modern formats commonly cut ~25–50% versus comparable JPEG/PNG (content + encoder dependent; see developers.google.com/speed/webp, web.dev/articles/compress-images-avif).")),
        Rule("perf_blocking_script", "content", _say(blocking["head_scripts_blocking"] > 0, blocking["head_scripts_blocking"], " render-blocking `<script>` in `<head>` (no async/defer/type=module). Each one delays first paint.")),
        Rule("perf_stylesheets", "content", _say(blocking["head_stylesheets"] > 4, blocking["head_stylesheets"], ' render-blocking `<link rel="stylesheet">` in `<head>` (severity rises with count and bytes). Inline critical CSS, ship the rest async.')),
        Rule("perf_font_display", "content", _say((fonts["external_link_count"] > 0) & ~fonts["has_font_display_strategy"], "External fonts present but no `font-display: swap|optional|fallback` declared. Invisible text during font load (FOIT) on slow networks.")),
        Rule("perf_lcp_preload", "content", _say((images["total"] >= 1) & ~c("performance.resource_hints.preloads_an_image"), 'No `<link rel="preload" as="image">` for the LCP image. Browser discovers the hero image only after the HTML parser reaches it.')),
        Rule("perf_inline_css", "content", _say(inline["inline_css"] > 50_000, F.floor(inline["inline_css"] / 1024), " KB of inline `<style>` (raw). Keep critical CSS small — roughly under the first-round-trip budget when compressed (web.dev/extract-critical-css).")),
        Rule("perf_inline_js", "content", _say(inline["inline_js"] > 50_000, F.floor(inline["inline_js"] / 1024), " KB of inline `<script>`. Bundle and defer — inline JS blocks parsing.")),
        Rule("link_no_authority", "content", _say((words >= 600) & (links["authority_external"] == 0), "No outbound links to trusted-reference sources (.gov, .edu, peer-reviewed journals, major press) in main content. Clear sourcing is a trust signal for both readers and AI retrievers.")),
        Rule("link_generic", "content", _say(links["generic_anchor_text"] >= 3, links["generic_anchor_text"], ' generic anchor texts ("click here", "read more", "link"). Anchor text is topic signal — use descriptive phrases.')),
        Rule("link_mill", "content", _say((links["total"] >= 30) & (links["external"] == 0), "Many internal links and zero outbound. Pages that never cite outside read as link-mill / templated to AI retrievers.")),
        Rule("date_mismatch_mild", "freshness", _say(severity == "mild", 'Schema dateModified is mildly newer (>30 days) than the visible "Updated/Modified" signal. Google\'s publication-dates guidance says visible and structured dates should match.')),
        Rule("date_mismatch_severe", "freshness", _say(severity == "severe", "Schema dateModified is severely out of sync with visible signals (gap >180 days, or no visible date at all on long content). Refresh visible dates alongside the schema, not just the schema.")),
    ]


def findings(rules: list[Rule]) -> Column:
    """The rules that fire, in order: array of (rule_ord, rule_id, factor, message)."""
    rows = [F.struct(F.lit(k + 1).alias("rule_ord"), F.lit(r.id).alias("rule_id"), F.lit(r.factor).alias("factor"), r.message.alias("message")) for k, r in enumerate(rules)]
    return F.filter(F.array(*rows), lambda x: x["message"].isNotNull())


def deductions() -> Column:
    """The components that cost points, in order: array of (name, deducted, reason)."""
    c = F.col
    image, words, types = c("open_graph.image"), c("content.word_count"), c("schema_types")
    undated = c("freshness.date_modified").isNull() & is_article(types)
    slop, gain = c("ai_slop.verdict"), c("information_gain.score")
    rows = [
        ("meta_title", 15, "Missing <title>", c("meta.title").isNull()),
        ("meta_description", 10, "Missing meta description", c("meta.description").isNull()),
        ("og_title", 5, "Missing og:title", c("open_graph.title").isNull()),
        ("og_image", 10, "Missing og:image", image.isNull()),
        ("og_image_url", 8, "og:image is not an absolute URL", ~is_absolute(image)),
        ("og_image_dimensions", 2, "og:image:width/height not declared", is_absolute(image) & (c("open_graph.image_width").isNull() | c("open_graph.image_height").isNull())),
        ("twitter_card", 2, "Missing twitter:card", c("twitter_card.card").isNull() & image.isNotNull()),
        ("h1", 10, "No H1 heading", F.size("content.h1") == 0),
        ("h2_count", 5, "Fewer than 2 H2 headings", F.size("content.h2") < 2),
        ("word_count", 10, "Body under 300 words", words < 300),
        ("tldr", 2, "No answer-first summary marker", ~c("content.has_tldr") & (words >= 150)),
        ("schema", 5, "No JSON-LD schema", F.size(types) == 0),
        ("date_modified", 5, "Missing dateModified on Article", undated),
        ("staleness", 5, "Content >180 days old", ~undated & (c("freshness.days_since_modified") > 180)),
        ("tldr_position", 5, "Answer summary past first 10% of body", c("position_bias.tldr_position_pct") > 10.0),
        ("first_stat_position", 5, "First statistic past first 30% of body", c("position_bias.first_stat_position_pct") > 30.0),
        ("img_alt", 5, "Images missing alt text", c("content.missing_alt_count") > 0),
        ("ai_slop", 5, "AI-writing fingerprint suspicious", slop == "suspicious"),
        ("ai_slop", 15, "AI-writing fingerprint heavy", slop == "likely_ai"),
        ("information_gain", 10, "Low Information Gain (rewritten / templated)", (words >= 300) & (gain <= 1)),
        ("information_gain", 5, "Below the 5..7 competitive band", (words >= 300) & gain.between(2, 4)),
    ]
    made = [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("name"), F.lit(points).alias("deducted"), F.lit(reason).alias("reason"))) for name, points, reason, test in rows]
    return F.array_compact(F.array(*made))


def total_score(components: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - F.aggregate(components, F.lit(0), lambda a, x: a + x["deducted"]))
