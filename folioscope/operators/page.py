"""Projections of a parsed page: metadata, previews, structure, static performance, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import prose

# Property names, markers and lists that decide results.
META_NAMES = ["description", "keywords", "author", "robots", "viewport"]
OPEN_GRAPH = {"title": "og:title", "description": "og:description", "image_width": "og:image:width", "image_height": "og:image:height", "image_alt": "og:image:alt", "url": "og:url", "type": "og:type", "site_name": "og:site_name"}
IMAGE_ALIASES = ["og:image:url", "og:image:secure_url"]
TWITTER = {"card": "twitter:card", "title": "twitter:title", "description": "twitter:description", "image": "twitter:image"}
NOSCRIPT_BOILERPLATE = ["enable javascript", "requires javascript", "turn on javascript", "javascript is disabled"]
TEMPLATED_FILENAME = r"(?i)(^|/)(img[_-]?\d+|dsc[_-]?\d+|image[_-]?\d+|photo[_-]?\d+|picture[_-]?\d+|screen ?shot|screenshot)([_-]?\d+)?\.(jpe?g|png|gif|webp|avif|heic)$"
MODERN_FORMAT = r"(?i)\.(webp|avif|jxl)(\?|#|$)"
MODERN_TYPES = ["image/webp", "image/avif", "image/jxl"]
FONT_DISPLAY = r"(?i)font-display\s*:\s*(swap|optional|fallback)"
FONT_HOSTS = ["fonts.googleapis.com", "fonts.gstatic.com", "use.typekit.net", "use.fontawesome.com", "typekit.net", ".woff2?"]
FONT_SUFFIXES = [".woff", ".woff2"]
FOLD_IMAGES = 2
AUTHORITIES = [
    "nih.gov", "cdc.gov", "fda.gov", "who.int", "europa.eu", "ema.europa.eu", "nice.org.uk", "gov.uk", "nhs.uk", "ac.uk", "oecd.org", "worldbank.org", "imf.org", "un.org", "unesco.org",
    ".edu", ".ac.uk", ".ac.jp", "ox.ac.uk", "cam.ac.uk", "harvard.edu", "mit.edu", "stanford.edu",
    "doi.org", "pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov", "nature.com", "science.org", "cell.com", "nejm.org", "thelancet.com", "bmj.com", "jamanetwork.com", "pnas.org", "plos.org", "frontiersin.org", "springer.com", "wiley.com", "sciencedirect.com", "cochranelibrary.com",
    "arxiv.org", "biorxiv.org", "medrxiv.org", "ssrn.com", "scholar.google",
    "wikipedia.org", "britannica.com", "reuters.com", "apnews.com", "bloomberg.com", "ft.com", "wsj.com", "nytimes.com", "economist.com", "bbc.com", "bbc.co.uk", "theguardian.com",
]
GENERIC_ANCHORS = ["click here", "read more", "link", "here", "more", "this", "this link", "details"]



def _last_or_null(items: Column, key: str, value: str) -> Column:
    matches = F.filter(items, lambda m: (F.lower(m[key]) == value) & m["content"].isNotNull())
    return T.let(matches, lambda ms: F.get(ms, F.size(ms) - 1)["content"])


def meta(p: Column) -> Column:
    canonical = F.filter(p["links"], lambda x: F.lower(x["rel"]) == "canonical")
    return F.struct(
        p["title"].alias("title"),
        *[_last_or_null(p["metas"], "name", n).alias(n) for n in ("description", "keywords", "author")],
        F.get(canonical, F.lit(0))["href"].alias("canonical"),
        *[_last_or_null(p["metas"], "name", n).alias(n) for n in ("robots", "viewport")],
        F.exists(p["links"], lambda x: F.coalesce(F.contains(F.lower(x["rel"]), F.lit("icon")), F.lit(False))).alias("favicon"),
    )


def open_graph(p: Column) -> Column:
    aliases = F.filter(p["metas"], lambda m: F.lower(m["property"]).isin(IMAGE_ALIASES) & m["content"].isNotNull())
    image = F.coalesce(_last_or_null(p["metas"], "property", "og:image"), F.get(aliases, F.lit(0))["content"])
    fields = {k: _last_or_null(p["metas"], "property", v) for k, v in OPEN_GRAPH.items()}
    order = ["title", "description", "image", "image_width", "image_height", "image_alt", "url", "type", "site_name"]
    return F.struct(*[(image if k == "image" else fields[k]).alias(k) for k in order])


def twitter_card(p: Column) -> Column:
    return F.struct(*[_last_or_null(p["metas"], "name", v).alias(k) for k, v in TWITTER.items()])


def headings(p: Column, level: int | None = None) -> Column:
    rows = p["headings"] if level is None else F.filter(p["headings"], lambda h: h["level"] == level)
    return F.transform(rows, lambda h: h["text"])


def noscript_kind(p: Column) -> Column:
    def substantive(text: Column) -> Column:
        plain = T.collapse(F.lower(text))
        boilerplate = F.lit(False)
        for phrase in NOSCRIPT_BOILERPLATE:
            boilerplate = boilerplate | F.contains(plain, F.lit(phrase))
        return ~boilerplate & (F.octet_length(plain) >= 40)

    return F.when(F.size(p["noscripts"]) == 0, "absent").when(F.exists(p["noscripts"], substantive), "substantive").otherwise("boilerplate_only")


def duplicate_headings(texts: Column) -> Column:
    return F.size(texts) - F.size(F.array_distinct(F.transform(texts, lambda h: F.lower(T.strip(h)))))


def hierarchy_violation(rows: Column) -> Column:
    """The first break in the order of (level, text) headings, as a message; null if there is none."""

    def message(h: Column, i: Column) -> Column:
        before = F.get(rows, i - 1)["level"]
        first = F.when((i == 0) & (h["level"] > 1), F.concat(F.lit("First heading is H"), h["level"], F.lit(", not H1. Crawlers and screen readers rely on H1 first.")))
        skip = F.when((i > 0) & (h["level"] > before + 1), F.concat(F.lit("Heading hierarchy skips: H"), h["level"], F.lit(" after H"), before, F.lit(". Use consecutive levels.")))
        return F.coalesce(first, skip)

    return F.get(F.filter(F.transform(rows, message), lambda m: m.isNotNull()), F.lit(0))


def content(p: Column, text: Column) -> Column:
    lang = T.strip(p["html_lang"])
    titles = F.concat_ws(" ", *[F.array_join(headings(p, n), " ") for n in (1, 2, 3)])
    languages = F.transform(F.filter(p["links"], lambda x: (F.lower(x["rel"]) == "alternate") & x["hreflang"].isNotNull()), lambda x: T.strip(x["hreflang"]))
    return F.struct(
        T.n_words(text).alias("word_count"),
        *[headings(p, n).alias(f"h{n}") for n in (1, 2, 3)],
        T.has(text, prose.ANSWER_BLOCK).alias("has_tldr"),
        T.has(titles, prose.FAQ).alias("has_faq"),
        T.has(text, prose.AUTHOR).alias("has_author"),
        T.has(text, prose.NAMED_CREDENTIAL).alias("has_credentials"),
        F.size(F.filter(p["images"], lambda i: T.strip(F.coalesce(i["alt"], F.lit(""))) == "")).alias("missing_alt_count"),
        F.size(p["images"]).alias("image_count"),
        F.when(lang != "", lang).alias("html_lang"),
        p["headings"].alias("headings_in_order"),
        F.array_sort(F.array_distinct(F.filter(languages, lambda x: x != ""))).alias("hreflangs"),
        noscript_kind(p).alias("noscript_kind"),
        p["table_count"].alias("table_count"),
        F.lit(0).alias("empty_heading_count"),
        duplicate_headings(headings(p)).alias("duplicate_heading_count"),
        prose.quotable_sentences(text).alias("quotable_sentence_count"),
    )


def _blank(x: Column) -> Column:
    return T.strip(F.coalesce(x, F.lit(""))) == ""


def _lower(x: Column) -> Column:
    return F.lower(F.coalesce(x, F.lit("")))


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def performance(p: Column, html_like: Column) -> Column:
    images, links, scripts = p["images"], p["links"], p["scripts"]
    late = F.slice(images, FOLD_IMAGES + 1, F.greatest(F.size(images), F.lit(1)))
    related = F.filter(links, lambda x: x["rel"].isNotNull())

    def rel(word: str):
        return lambda x: F.contains(_lower(x["rel"]), F.lit(word))

    def preload(x: Column) -> Column:
        return rel("preload")(x) & ~rel("modulepreload")(x)

    def font_preload(x: Column) -> Column:
        return rel("preload")(x) & (_lower(x["as"]) == "font")

    def font_link(x: Column) -> Column:
        href, out = _lower(x["href"]), font_preload(x)
        for host in FONT_HOSTS:
            out = out | F.contains(href, F.lit(host))
        for suffix in FONT_SUFFIXES:
            out = out | F.endswith(href, F.lit(suffix))
        return out

    blocking = _count(scripts, lambda s: s["in_head"] & s["src"].isNotNull() & ~s["async"] & ~s["defer"] & (_lower(s["type"]) != "module"))
    sheets = _count(links, lambda x: x["in_head"] & (_lower(x["rel"]) == "stylesheet") & ~x["disabled"] & (_lower(x["media"]) != "print"))
    inline = F.aggregate(F.filter(scripts, lambda s: s["src"].isNull()), F.lit(0).cast("bigint"), lambda a, s: a + s["bytes"])
    return F.struct(
        F.struct(
            F.size(images).alias("total"),
            _count(late, lambda i: _lower(i["loading"]) != "lazy").alias("eligible_for_lazy_missing"),
            _count(images, lambda i: _blank(i["width"]) | _blank(i["height"])).alias("missing_dimensions"),
            _count(images, lambda i: T.has(F.coalesce(i["src"], F.lit("")), TEMPLATED_FILENAME)).alias("non_descriptive_filenames"),
            _count(p["picture_sources"], lambda s: F.lower(s).isin(MODERN_TYPES)).alias("modern_format_via_picture"),
            _count(images, lambda i: T.has(F.coalesce(i["src"], F.lit("")), MODERN_FORMAT)).alias("modern_format_via_src"),
        ).alias("images"),
        F.struct(blocking.alias("head_scripts_blocking"), sheets.alias("head_stylesheets")).alias("render_blocking"),
        F.struct(
            _count(related, preload).alias("preload"),
            _count(related, rel("preconnect")).alias("preconnect"),
            _count(related, rel("dns-prefetch")).alias("dns_prefetch"),
            _count(related, rel("modulepreload")).alias("modulepreload"),
            F.exists(related, lambda x: preload(x) & (_lower(x["as"]) == "image")).alias("preloads_an_image"),
        ).alias("resource_hints"),
        F.struct(_count(related, font_link).alias("external_link_count"), T.has(html_like, FONT_DISPLAY).alias("has_font_display_strategy"), _count(related, font_preload).alias("preloaded")).alias("fonts"),
        F.struct(p["style_bytes"].alias("inline_css"), inline.alias("inline_js")).alias("inline_bytes"),
    )


def host_of(href: Column) -> Column:
    """The host of an absolute link in lower case, with port and user; null for others."""
    host = F.regexp_extract(F.lower(T.strip(href)), r"^(?:(?:http://)+(?:https://)*(?://)*|(?:https://)+(?://)*|(?://)+)([^/?#]*)", 1)
    return F.when(host != "", host)


def _bare(host: Column) -> Column:
    return F.regexp_replace(host, r"^(?:www\.)+", "")


def is_authority(host: Column) -> Column:
    """Whether a host is, or lies under, a trusted source; the entries with a dot match any end."""
    bare = _bare(host)
    names = [d for d in AUTHORITIES if not d.startswith(".")]
    out = bare.isin(names)
    for d in names:
        out = out | F.endswith(bare, F.lit("." + d))
    for d in AUTHORITIES:
        if d.startswith("."):
            out = out | F.endswith(bare, F.lit(d[1:]))
    return out


def link_kinds(p: Column, canonical: Column) -> Column:
    """The counted links outside chrome: array of (host, kind, nofollow, authority, generic)."""
    own = host_of(canonical)
    kept = F.filter(p["anchors"], lambda a: ~T.strip(a["href"]).rlike(r"^$|^#|^javascript:"))

    def row(a: Column) -> Column:
        host = host_of(a["href"])
        inside = host.isNull() | F.coalesce(_bare(host) == _bare(own), F.lit(False))
        text = F.lower(a["text"])
        return F.struct(
            host.alias("host"),
            F.when(inside, "internal").otherwise("external").alias("kind"),
            F.array_contains(T.tokens(_lower(a["rel"])), "nofollow").alias("nofollow"),
            F.coalesce(is_authority(host), F.lit(False)).alias("authority"),
            (text.isin(GENERIC_ANCHORS) | (text == "")).alias("generic"),
        )

    return F.transform(kept, row)


def link_graph(p: Column, canonical: Column) -> Column:
    def of_links(links: Column) -> Column:
        outside = F.filter(links, lambda x: x["kind"] == "external")
        return F.struct(
            F.size(links).alias("total"),
            (F.size(links) - F.size(outside)).alias("internal"),
            F.size(outside).alias("external"),
            _count(outside, lambda x: x["nofollow"]).alias("nofollow_external"),
            _count(outside, lambda x: x["authority"]).alias("authority_external"),
            F.size(F.array_distinct(F.transform(outside, lambda x: x["host"]))).alias("external_hosts"),
            _count(links, lambda x: x["generic"]).alias("generic_anchor_text"),
        )

    return T.let(link_kinds(p, canonical), of_links)


def authority_links(hosts: DataFrame, host_col: str = "host") -> DataFrame:
    """Corpus form: the rows of hosts under a trusted source.  The list is short and fixed, so no row is moved."""
    return hosts.where(is_authority(F.lower(F.col(host_col))))
