"""Design rules: patterns of templated pages, by line and by document, over the raw markup.

The rule names and their taxonomy are adapted from an Apache-2.0 project; see NOTICE.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Test = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Rule:
    id: str
    regex: str
    #: snippet, or null to skip, of (all groups of a match from 0, line)
    passes: Test


# What counts as rounded, as a safe element, as a generic font.
ROUNDED = r"\brounded(?:-\w+)?\b"
BORDER_RADIUS = r"(?i)border-radius"
SAFE_ELEMENT = r"(?i)<(?:blockquote|nav[\s>]|pre[\s>]|code[\s>]|a\s|input[\s>]|span[\s>])"
GENERIC_FONTS = ["serif", "sans-serif", "monospace", "system-ui", "ui-sans-serif", "ui-serif", "ui-monospace", "ui-rounded", "cursive", "fantasy", "math", "emoji", "inherit", "initial", "unset", "revert", "revert-layer"]
COLOURED = r"\bbg-(?:red|orange|amber|yellow|lime|green|emerald|teal|cyan|sky|blue|indigo|violet|purple|fuchsia|pink|rose)-\d+\b"
SIZED = r"\b(?:(?:max|min)-)?(?:width|height)\b|\bpadding\b|\bmargin\b"


def _at_least(group: Column, least: int) -> Column:
    n = group.try_cast("bigint")
    return (n >= least) & (n <= 4294967295)


def _whole(g: Column, line: Column) -> Column:
    return g[0]


def _if(condition: Column, snippet: Column) -> Column:
    return F.when(condition, snippet)


def _on(pattern: str, snippet: Callable[[Column], Column] = lambda g: g[0]) -> Test:
    """Passes where the line has the pattern too."""
    return lambda g, line: _if(T.has(line, pattern), snippet(g))


def _transition(name: str) -> Test:
    def test(g: Column, line: Column) -> Column:
        value = F.lower(g[1])
        return _if(~T.has(value, r"\ball\b") & T.has(value, SIZED), F.concat(F.lit(f"{name}: "), T.strip(g[1])))

    return test


def _bezier(g: Column, line: Column) -> Column:
    y1, y2 = g[2].try_cast("double"), g[4].try_cast("double")
    return _if(~(y1.between(-0.1, 1.1) & y2.between(-0.1, 1.1)), F.concat(F.lit("cubic-bezier("), F.concat_ws(", ", g[1], g[2], g[3], g[4]), F.lit(")")))


def _shadcn(g: Column, line: Column) -> Column:
    sure = T.has(line, r"--background\s*:\s*oklch\(1\s+0\s+0\)") | T.has(line, r"--muted-foreground\s*:\s*oklch\(0\.556\s+0\s+0\)") | T.has(line, r"--destructive\s*:\s*oklch\(0\.577\s+0\.245\s+27\.325\)")
    return F.when(sure, F.lit("shadcn unmodified :root palette")).otherwise(F.lit("--radius: 0.625rem (likely shadcn)"))


def _text(text: str) -> Test:
    return lambda g, line: F.lit(text)


#: Line rules, in order of evaluation.
RULES = [
    Rule("side-tab", r"\bborder-[lrse]-(\d+)\b", lambda g, line: _if(F.when(T.has(line, ROUNDED), _at_least(g[1], 1)).otherwise(_at_least(g[1], 4)), g[0])),
    Rule("side-tab", r"(?i)border-(?:left|right)-width\s*:\s*(\d+)px", lambda g, line: _if(~T.has(line, SAFE_ELEMENT) & _at_least(g[1], 3), g[0])),
    Rule("border-accent-on-rounded", r"\bborder-[tb]-(\d+)\b", lambda g, line: _if(T.has(line, ROUNDED) & _at_least(g[1], 1), g[0])),
    Rule("border-accent-on-rounded", r"(?i)border-(?:top|bottom)\s*:\s*(\d+)px\s+solid", lambda g, line: _if(_at_least(g[1], 3) & T.has(line, BORDER_RADIUS), g[0])),
    Rule("overused-font", r"""(?i)font-family\s*:\s*['"]?(Inter|Roboto|Open Sans|Lato|Montserrat|Arial|Helvetica|Fraunces|Geist Sans|Geist Mono|Geist|Mona Sans|Plus Jakarta Sans|Space Grotesk|Recoleta|Instrument Sans)\b""", _whole),
    Rule("overused-font", r"(?i)fonts\.googleapis\.com/css2?\?family=(Inter|Roboto|Open\+Sans|Lato|Montserrat|Fraunces|Plus\+Jakarta\+Sans|Space\+Grotesk|Instrument\+Sans|Mona\+Sans|Geist)\b", lambda g, line: F.concat(F.lit("Google Fonts: "), F.replace(g[1], F.lit("+"), F.lit(" ")))),
    Rule("anthropic_overused_font_2026", r"""(?i)font-family\s*:\s*['"]?(Inter|Roboto|Arial|Space Grotesk)\b""", lambda g, line: g[1]),
    Rule("editorial_serif_wave", r"""(?i)font-family\s*:\s*['"]?(Fraunces|Recoleta|Newsreader|Tiempos)\b""", lambda g, line: _if(T.has(line, r"(?i)font-style\s*:\s*italic|\bitalic\b") | T.has(line, r"#(?:7c2d12|92400e|9a3412|c2410c|d97706|b45309|78350f|fef3c7|fed7aa|fffbeb)\b"), F.concat(g[1], F.lit(" + italic / warm palette (community-observed)")))),
    Rule("pure-black-white", r"(?i)background(?:-color)?\s*:\s*(#000000|#000|rgb\(\s*0\s*,\s*0\s*,\s*0\s*\))\b", _on(r"(?i)#fff(fff)?\b|\bwhite\b")),
    Rule("pure-black-white", r"\bbg-black\b", _on(r"\b(text-white|bg-white)\b")),
    Rule("gradient-text", r"(?i)background-clip\s*:\s*text|-webkit-background-clip\s*:\s*text", _on(r"(?i)gradient", lambda g: F.lit("background-clip: text + gradient"))),
    Rule("gradient-text", r"\bbg-clip-text\b", _on(r"(?i)\bbg-gradient-to-", lambda g: F.lit("bg-clip-text + bg-gradient"))),
    Rule("gray-on-color", r"\btext-(?:gray|slate|zinc|neutral|stone)-(\d+)\b", lambda g, line: _if(T.has(line, COLOURED), F.concat(g[0], F.lit(" on "), F.regexp_extract(line, T.unicode(COLOURED), 0)))),
    Rule("ai-color-palette", r"\btext-(?:purple|violet|indigo)-(\d+)\b", _on(r"(?i)\btext-(?:[2-9]xl|[3-9]xl)\b|<h[1-3]", lambda g: F.concat(g[0], F.lit(" on heading")))),
    Rule("ai-color-palette", r"\bfrom-(?:purple|violet|indigo)-(\d+)\b", _on(r"\bto-(?:purple|violet|indigo|blue|cyan|pink|fuchsia)-\d+\b", lambda g: F.concat(g[0], F.lit(" gradient")))),
    Rule("ai-color-palette", r"(?i)#(7c3aed|8b5cf6|a855f7|9333ea|7e22ce|6d28d9|6366f1|764ba2|667eea)\b", lambda g, line: F.concat(F.lit("#"), g[1])),
    Rule("bounce-easing", r"\banimate-bounce\b", _text("animate-bounce (Tailwind)")),
    Rule("bounce-easing", r"(?i)animation(?:-name)?\s*:\s*[^;]*\b(bounce|elastic|wobble|jiggle|spring)\b", _whole),
    Rule("bounce-easing", r"cubic-bezier\(\s*([-\d.]+)\s*,\s*([-\d.]+)\s*,\s*([-\d.]+)\s*,\s*([-\d.]+)\s*\)", _bezier),
    Rule("layout-transition", r"(?i)transition\s*:\s*([^;{}]+)", _transition("transition")),
    Rule("layout-transition", r"(?i)transition-property\s*:\s*([^;{}]+)", _transition("transition-property")),
    Rule("justified-text", r"(?i)text-align\s*:\s*justify|\btext-justify\b", _whole),
    Rule("tiny-text", r"(?i)font-size\s*:\s*(1[0-3])(?:px)\b", lambda g, line: F.concat(F.lit("font-size: "), g[1], F.lit("px"))),
    Rule("tight-leading", r"(?i)line-height\s*:\s*(0?\.\d+|1\.[0-2]\d?)\b", lambda g, line: F.concat(F.lit("line-height: "), g[1])),
    Rule("all-caps-body", r"<(?:p|li|article)[^>]*\bclass=[^>]*\buppercase\b", lambda g, line: F.concat(F.lit("<"), F.substring(g[0], 1, 8), F.lit("…> with `uppercase` on long-form text"))),
    Rule("wide-tracking", r"(?i)letter-spacing\s*:\s*(0\.0[6-9]|0\.[1-9])(?:em|rem)", lambda g, line: F.concat(F.lit("letter-spacing: "), g[1], F.lit("em"))),
    Rule("shadcn_default_oklch", r"--radius\s*:\s*0\.625rem", _shadcn),
    Rule("vercel_next_forge_default", r"--font-sans\s*:\s*var\(--font-geist-sans\)", _text("next-forge default: --font-sans + geist")),
]
LINE_CAP, FINDING_CAP = 5001, 50

# Patterns of the document rules.
FONT_FAMILY = r"(?i)font-family\s*:\s*([^;}]+)"
FONT_LINK = r"""(?i)fonts\.googleapis\.com/css2?\?family=([^&"'\s]+)"""
SPACING_PX = r"(?i)(?:padding|margin)(?:-(?:top|right|bottom|left))?\s*:\s*(\d+)px"
SPACING_REM = r"(?i)(?:padding|margin)(?:-(?:top|right|bottom|left))?\s*:\s*([\d.]+)rem"
SPACING_GAP = r"(?i)gap\s*:\s*(\d+)px"
SPACING_CLASS = r"\b(?:p|px|py|pt|pb|pl|pr|m|mx|my|mt|mb|ml|mr|gap)-(\d+)\b"
TEXT_ELEMENT = r"(?i)<(?:h[1-6]|p|div|li|button)\b[^>]*>"
CENTERED = r"(?i)text-align\s*:\s*center|\btext-center\b"

_FINDING = "array<struct<id:string,snippet:string>>"


def lines(html_like: Column) -> Column:
    """Lines as they end in \\n or \\r\\n; no empty one after the last end."""
    parts = F.split(html_like, r"\r?\n")
    return T.let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def _passed(rule: Rule, line: Column) -> Callable[[Column], Column]:
    return lambda groups: F.struct(F.lit(rule.id).alias("id"), rule.passes(groups, line).alias("snippet"))


def _line_findings(line: Column) -> Column:
    every = []
    for rule in RULES:
        groups = rule.regex.replace("(?:", "").replace("(?i)", "").count("(") - rule.regex.count(r"\(")
        # All groups of a match side by side.
        found = F.transform(T.find_all(line, rule.regex), lambda m: F.array(m))
        for k in range(1, groups + 1):
            found = F.zip_with(found, T.find_all(line, rule.regex, k), lambda a, g: F.array_append(a, g))
        snippets = F.transform(found, _passed(rule, line))
        every.append(F.when(T.has(line, rule.regex), F.filter(snippets, lambda s: s["snippet"].isNotNull())).otherwise(F.array().cast(_FINDING)))
    return F.flatten(F.array(*every))


#: A line without any of these has no finding; spares most lines the single rules.
_ANY = r"(?i)border-|font|background|bg-|text-|from-|#[0-9a-f]{6}|animat|bezier|transition|line-height|uppercase|letter-spacing|--radius"


def line_findings(html_like: Column) -> Column:
    """(id, snippet) by line, rule and place, over the first ``LINE_CAP`` lines."""
    hinted = F.filter(F.slice(lines(html_like), 1, LINE_CAP), lambda x: x.rlike(_ANY))
    return F.flatten(F.transform(hinted, _line_findings))


def single_font(html_like: Column) -> Column:
    """The snippet if there is one font only, on 20 lines or more."""
    lists = F.flatten(F.transform(T.find_all(html_like, FONT_FAMILY, 1), lambda x: F.split(x, ",")))
    named = F.transform(lists, lambda f: F.lower(F.regexp_replace(T.strip(f), r"""^['"]+|['"]+$""", "")))
    named = F.filter(named, lambda f: (f != "") & ~f.isin(GENERIC_FONTS))
    linked = F.flatten(F.transform(T.find_all(html_like, FONT_LINK, 1), lambda x: F.split(x, r"\|")))
    linked = F.filter(F.transform(linked, lambda f: F.lower(F.replace(F.split(f, ":")[0], F.lit("+"), F.lit(" ")))), lambda f: f != "")
    return T.let(F.array_distinct(F.concat(named, linked)), lambda f: F.when((F.size(f) == 1) & (F.size(lines(html_like)) >= 20), F.concat(F.lit("only font used is "), f[0])))


def spacing_values(html_like: Column) -> Column:
    """Spacings in pixels, in steps of four."""

    def whole(pattern: str) -> Column:
        return F.filter(F.transform(T.find_all(html_like, pattern, 1), lambda v: v.try_cast("bigint")), lambda v: v.isNotNull() & (v <= 4294967295))

    px = F.filter(whole(SPACING_PX), lambda v: (v > 0) & (v < 200))
    rem = F.transform(T.find_all(html_like, SPACING_REM, 1), lambda v: F.round(v.try_cast("double") * 16).cast("bigint"))
    rem = F.filter(rem, lambda v: v.isNotNull() & (v > 0) & (v < 200))
    classes = F.transform(whole(SPACING_CLASS), lambda v: F.least(v * 4, F.lit(4294967295)))
    return F.transform(F.concat(px, rem, whole(SPACING_GAP), classes), lambda v: F.floor(v / 4) * 4)


def monotonous_spacing(html_like: Column) -> Column:
    """The snippet if one of at most three spacings makes over 60 % of ten or more; ties go to the smaller."""

    def of_values(v: Column) -> Column:
        distinct = F.array_sort(F.array_distinct(v))
        counts = F.transform(distinct, lambda x: F.struct((-F.size(F.filter(v, lambda y: y == x))).alias("minus"), x.alias("px")))
        most = F.array_sort(counts)[0]
        share = -most["minus"] / F.size(v)
        few = F.size(F.filter(distinct, lambda x: x > 0)) <= 3
        text = F.concat(F.lit("~"), most["px"], F.lit("px used "), -most["minus"], F.lit("/"), F.size(v), F.lit(" times ("), F.round(share * 100).cast("int"), F.lit("%)"))
        return F.when((F.size(v) >= 10) & (share > 0.6) & few, text)

    return F.when(F.regexp_count(html_like, F.lit(r"(?i)padding|margin|gap|[pm][xytblr]?-\d")) >= 10, T.let(spacing_values(html_like), of_values))


def everything_centered(html_like: Column) -> Column:
    """The snippet if over 70 % of five or more lines with a text element are centred."""
    rows = F.filter(lines(html_like), lambda x: (F.octet_length(T.strip(x)) > 20) & T.has(x, TEXT_ELEMENT))

    def of_rows(r: Column) -> Column:
        centred = F.size(F.filter(r, lambda x: T.has(x, CENTERED)))
        text = F.concat(centred, F.lit("/"), F.size(r), F.lit(" text elements centered ("), F.round(centred / F.size(r) * 100).cast("int"), F.lit("%)"))
        return F.when((F.size(r) >= 5) & (centred / F.size(r) > 0.7), text)

    return T.let(rows, of_rows)


def design_slop(html_like: Column) -> Column:
    """struct(findings, counts, verdict); line findings are capped, counts are not."""
    documents = {"single-font": single_font, "monotonous-spacing": monotonous_spacing, "everything-centered": everything_centered}
    own = F.array(*[F.struct(F.lit(k).alias("id"), f(html_like).alias("snippet")) for k, f in documents.items()])
    both = F.struct(line_findings(html_like).alias("by_line"), F.filter(own, lambda s: s["snippet"].isNotNull()).alias("by_document"))

    def of_both(b: Column) -> Column:
        ids = F.array_sort(F.transform(F.concat(b["by_line"], b["by_document"]), lambda f: f["id"]))

        def of_ids(names: Column) -> Column:
            counts = F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(n, F.size(F.filter(names, lambda m: m == n)))))
            total = F.size(names)
            verdict = F.when(total == 0, "clean").when(total <= 4, "minor").when(total <= 10, "suspicious").otherwise("heavy")
            return F.struct(F.concat(F.slice(b["by_line"], 1, FINDING_CAP), b["by_document"]).alias("findings"), counts.alias("counts"), verdict.alias("verdict"))

        return T.let(ids, of_ids)

    return T.let(both, of_both)


def line_hit_counts(docs: DataFrame, html_col: str = "html_like", id_col: str = "doc_id") -> DataFrame:
    """Corpus form: (doc_id, id, hits) of the line rules."""
    rows = T.rows_of(docs, line_findings(F.col(html_col)), "f", id_col)
    return rows.groupBy(id_col, F.col("f.id").alias("id")).agg(F.count("*").alias("hits"))
