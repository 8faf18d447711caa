"""Inputs of the registered queries.

The supplied texts hardly touch the patterns, so sentences that do are put around them, chosen by
the row's key.  Every sample exists twice, as columns and as SQL, made from the same lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scans import read_table

OPENERS = [
    "We delve into the tapestry of it, not only for this but also for that.",
    "In today's fast-paced world it is worth noting that experts agree on 30 percent of 40 users.",
    "As an AI language model I cannot browse the internet. Hope this helps you.",
    "Dr. Jane Smith, PhD, works at Acme Research Institute and again at Acme Research Institute.",
    "Why does it work? How does it work? What is the bottom line? Which one is it?",
    "Studies show a rise of 25 percent [3] in 2024. Research suggests more of it.",
    'He said "this is a very long quotation indeed" — Jane Smith and up 12% from 2023.',
    "TL;DR: 30 patients were measured, n = 45 and we analyzed our dataset with a control group.",
    "Perhaps it could really be quite clearly and actually very simply seen, possibly.",
    "Updated on Dec 30, 2025. See (2024) or https://example.org within 12 months.",
    "In conclusion, furthermore, let me know if you have any doubt. Great question!",
    "In order to leverage the key and crucial results, the report was written and was opened.",
    "Mr Bob Brown MD and Prof. Alice Ann Green met. Data shows growth of 3 million.",
    "Unlock the power of ever-evolving markets, a testament to their paramount importance.",
    "Here's a comprehensive guide. I'll start with it. You might be wondering, as mentioned above.",
    "It is well known that the Smith Foundation and the Smith Foundation agree, in other words.",
    "",
]
CLOSERS = [
    "Is it done? Reviewed 12 March 2024. It should be noted that firstly it was taken.",
    "Please bear in mind that 50 people, MD or JD, navigate the landscape seamlessly integrated.",
    "",
    "Feel free to ask. Not a plan but a habit. Widely accepted, this may be.",
    "At a glance: 7 companies grew by 3 percentage points since 2020 [1] [2] [3].",
]
TITLES = ["Introduction", "Background", "FAQ", "Conclusion", "Our Field Notes", "1. Overview", "Use Cases", "  Tips", "Key Takeaways", "faq", "Results"]


def choose(key: Column, items: list[str]) -> Column:
    out = F.lit(items[0])
    for k, item in enumerate(items[1:], 1):
        out = F.when(key % len(items) == k, F.lit(item)).otherwise(out)
    return out


def choose_sql(key: str, items: list[str]) -> str:
    return f"CASE ({key}) % {len(items)} " + " ".join(f"WHEN {k} THEN {quoted(x)}" for k, x in enumerate(items)) + " END"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: (doc_id, body_text)."""
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse(F.col("text")).alias("body_text"))


PLAIN_SQL = r"(SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS b FROM documents)"


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with sentences before and after: (doc_id, body_text)."""
    k = F.col("doc_id")
    body = F.concat_ws(" ", choose(k, OPENERS), "body_text", choose(k * 7 + 3, CLOSERS))
    return plain(spark, sf_dir).select("doc_id", T.collapse(body).alias("body_text"))


PROSE_SQL = rf"(SELECT doc_id, trim(regexp_replace(({choose_sql('doc_id', OPENERS)}) || ' ' || b || ' ' || ({choose_sql('doc_id * 7 + 3', CLOSERS)}), '\s+', ' ', 'g')) AS b FROM {PLAIN_SQL})"
#: The same with what RE2 doesn't take for word characters, though they are, as underscores.
ASCII_SQL = rf"(SELECT doc_id, b, regexp_replace(b, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]', '_', 'g') AS u FROM {PROSE_SQL})"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: (doc_id, headings) of three to eight titles."""
    k = F.col("doc_id")
    made = F.transform(F.sequence(F.lit(0).cast("bigint"), k % 6 + 2), lambda i: choose((k * 5 + i * 3) % 97, TITLES))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("headings"))


TITLES_SQL = f"(SELECT doc_id, list_transform(range(0, doc_id % 6 + 3), lambda i: {choose_sql('(doc_id * 5 + i * 3) % 97', TITLES)}) AS hs FROM documents)"

_LINES = [
    ("<div class=\"border-l-", "p_size % 8", " rounded-lg text-center\"> framed text element</div>"),
    ("<p style=\"font-family: Inter, serif; padding: ", "4 * (p_partkey % 2 + 1)", "px\">text here that is long enough</p>"),
    ("a{transition: width 0.3s; line-height: 1.", "p_size % 10", "; color: #8b5cf6}"),
    ("p{font-size: ", "8 + p_size % 8", "px; text-align: justify}"),
    ("h1{letter-spacing: 0.", "p_size % 10", "em; background: #000; color: white}"),
    ("<h2 class=\"text-purple-", "100 * (p_size % 9)", " text-3xl bg-black text-white\">Heading goes here</h2>"),
    ("b{animation: bounce 1s; transition-timing-function: cubic-bezier(0.1, ", "p_size % 3", ", 0.2, 1.5)}"),
    ("i{border-top: ", "p_size % 6", "px solid; border-radius: 4px; border-left-width: 4px}"),
    ("<span class=\"text-gray-", "100 * (p_size % 9)", " bg-red-500 from-violet-500 to-pink-500\">x</span>"),
    (":root{--radius: 0.625rem; --font-sans: var(--font-geist-sans); margin: ", "p_size % 5", "rem; gap: 8px}"),
    ("<li class=\"uppercase mt-", "p_partkey % 3", "\">listed text that is long</li>"),
]


def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part: (doc_id, html_like) of 14 to 33 lines of styles and classes."""
    # The first lines by rule, those after them alike.
    parts = [F.concat(F.lit(a), F.expr(e).cast("string"), F.lit(z)) for a, e, z in _LINES]
    kept = [F.when((F.col("p_partkey") + k) % 4 != 0, p).otherwise(F.lit("<br>")) for k, p in enumerate(parts)]
    tail = F.transform(F.sequence(F.lit(1), F.col("p_size") % 20 + 3), lambda i: F.concat(F.lit('<p class="text-center mt-4">paragraph number '), i.cast("string"), F.lit("</p>")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array_join(F.concat(F.array(*kept), tail), "\n").alias("html_like"))


STYLES_SQL = (
    "(SELECT p_partkey AS doc_id, array_to_string(list_concat(["
    + ", ".join(f"CASE WHEN (p_partkey + {k}) % 4 <> 0 THEN {quoted(a)} || CAST({e} AS VARCHAR) || {quoted(z)} ELSE '<br>' END" for k, (a, e, z) in enumerate(_LINES))
    + """], list_transform(range(1, p_size % 20 + 4), lambda i: '<p class="text-center mt-4">paragraph number ' || i || '</p>')), chr(10)) AS h FROM part)"""
)


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: (doc_id, html_like, body_text) with declared and visible dates."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    modified = F.when(k % 4 != 0, F.concat(F.lit('{"dateModified": "'), F.date_format(day, "yyyy-MM-dd"), F.when(k % 3 == 0, F.lit("T23:30:00-05:00")).otherwise(F.lit("")), F.lit('"}'))).otherwise(F.lit("{}"))
    published = F.concat(F.lit('{"datePublished" : "'), F.date_format(F.date_sub(day, 40), "yyyy-MM-dd"), F.lit('"}'))
    element = F.when(k % 5 == 0, F.concat(F.lit("<time class=x datetime='"), F.date_format(F.date_sub(day, (k % 300).cast("int")), "yyyy-MM-dd"), F.lit("'>"))).otherwise(F.lit(""))
    label = F.when(k % 5 == 1, F.concat(F.lit("Last updated: "), F.date_format(F.date_sub(day, (k % 300).cast("int")), "yyyy-MM-dd"))).when(k % 5 == 2, F.concat(F.lit("Reviewed "), F.date_format(day, "MMM d, yyyy"))).when(k % 5 == 3, F.concat(F.lit("published "), F.year(day).cast("string"))).otherwise(F.lit("No date."))
    filler = F.repeat(F.lit("word "), ((k % 2) * 450).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.concat(modified, published, element).alias("html_like"), T.collapse(F.concat(label, F.lit(" and "), filler)).alias("body_text"))


DATED_SQL = """(SELECT o_orderkey AS doc_id,
  CASE WHEN o_orderkey % 4 <> 0 THEN '{"dateModified": "' || strftime(d, '%Y-%m-%d') || CASE WHEN o_orderkey % 3 = 0 THEN 'T23:30:00-05:00' ELSE '' END || '"}' ELSE '{}' END
    || '{"datePublished" : "' || strftime(d - 40, '%Y-%m-%d') || '"}'
    || CASE WHEN o_orderkey % 5 = 0 THEN '<time class=x datetime=''' || strftime(d - CAST(o_orderkey % 300 AS INTEGER), '%Y-%m-%d') || '''>' ELSE '' END AS h,
  trim(CASE o_orderkey % 5 WHEN 1 THEN 'Last updated: ' || strftime(d - CAST(o_orderkey % 300 AS INTEGER), '%Y-%m-%d') WHEN 2 THEN 'Reviewed ' || strftime(d, '%b %-d, %Y') WHEN 3 THEN 'published ' || year(d) ELSE 'No date.' END
    || ' and ' || repeat('word ', CAST((o_orderkey % 2) * 450 AS INTEGER))) AS b FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders))"""

HOSTS = ["https://www.shop.example.com/a?b=1", "http://en.wikipedia.org/wiki/X", "//cdn.example.net/x.js", "/about", "#top", "mailto:a@b.c", "https://cs.xedu/p", "javascript:void(0)", "https://shop.example.com:8080/", "https://news.bbc.co.uk#f", "HTTPS://Shop.Example.com/z"]
ANCHORS = ["Click here", "our own report", "", "read more", "details of the plan"]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with metadata, links and images put into the markup: documents to audit."""
    k = F.col("page_id")
    head = F.concat(
        F.when(k % 3 != 0, F.concat(F.lit('<meta name="Description" content="'), F.repeat(F.lit("about it "), (k % 25).cast("int")), F.lit('">'))).otherwise(F.lit("")),
        F.when(k % 2 == 0, F.lit('<link rel="canonical" href="https://shop.example.com/p"><meta property="og:url" content="https://shop.example.com/p/">')).otherwise(F.lit("")),
        F.when(k % 4 == 1, F.lit('<meta property="og:image:url" content="/x.png"><meta property="og:title" content="T">')).otherwise(F.lit("")),
        F.when(k % 4 == 2, F.lit('<meta property="og:image" content="https://x.example/i.png"><meta property="og:image:width" content="1200">')).otherwise(F.lit("")),
        F.when(k % 5 == 0, F.lit('<script type="application/ld+json">{"@graph":[{"@type":["Article","Thing"],"dateModified":"2024-01-15"}]}</script>')).otherwise(F.lit("")),
        F.when(k % 6 == 0, F.lit('<script src="a.js"></script><link rel="preload" as="font" href="f.woff2"><link rel=stylesheet href=s.css>')).otherwise(F.lit("")),
    )
    link = lambda i: F.concat(F.lit('<a href="'), choose(k + i * 3, HOSTS), F.when(i % 2 == 0, F.lit('" rel="nofollow noopener">')).otherwise(F.lit('">')), choose(k + i, ANCHORS), F.lit("</a>"))
    image = lambda i: F.concat(F.lit('<img src="/img_'), i.cast("string"), F.when(i % 2 == 0, F.lit('.webp" alt="x" width="4" height="3">')).otherwise(F.lit('.jpg" loading="lazy">')))
    tail = F.concat(F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), k % 7), link), " "), F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), k % 6 + 1), image), ""))
    body = F.concat(F.lit("<h2>"), choose(k, TITLES), F.lit("</h2>"), F.when(k % 3 == 1, F.concat(F.lit("<h4>"), choose(k, TITLES), F.lit("</h4>"))).otherwise(F.lit("")), tail)
    html = F.replace(F.replace(F.col("html"), F.lit("</title>"), F.concat(F.lit("</title>"), head)), F.lit("</article>"), F.concat(body, F.lit("</article>")))
    return table(spark, sf_dir, "pages").select(k.alias("doc_id"), F.col("url").alias("label"), F.lit("html").alias("file_type"), html.alias("raw"))


PAGES_SQL = f"""(SELECT page_id AS doc_id, replace(replace(html, '</title>', '</title>'
  || CASE WHEN page_id % 3 <> 0 THEN '<meta name="Description" content="' || repeat('about it ', CAST(page_id % 25 AS INTEGER)) || '">' ELSE '' END
  || CASE WHEN page_id % 2 = 0 THEN '<link rel="canonical" href="https://shop.example.com/p"><meta property="og:url" content="https://shop.example.com/p/">' ELSE '' END
  || CASE WHEN page_id % 4 = 1 THEN '<meta property="og:image:url" content="/x.png"><meta property="og:title" content="T">' ELSE '' END
  || CASE WHEN page_id % 4 = 2 THEN '<meta property="og:image" content="https://x.example/i.png"><meta property="og:image:width" content="1200">' ELSE '' END
  || CASE WHEN page_id % 5 = 0 THEN '<script type="application/ld+json">{{"@graph":[{{"@type":["Article","Thing"],"dateModified":"2024-01-15"}}]}}</script>' ELSE '' END
  || CASE WHEN page_id % 6 = 0 THEN '<script src="a.js"></script><link rel="preload" as="font" href="f.woff2"><link rel=stylesheet href=s.css>' ELSE '' END),
  '</article>', '<h2>' || t || '</h2>' || CASE WHEN page_id % 3 = 1 THEN '<h4>' || t || '</h4>' ELSE '' END
  || array_to_string(list_transform(range(0, page_id % 7 + 1), lambda i: '<a href="' || {choose_sql('page_id + i * 3', HOSTS)} || CASE WHEN i % 2 = 0 THEN '" rel="nofollow noopener">' ELSE '">' END || {choose_sql('page_id + i', ANCHORS)} || '</a>'), ' ')
  || array_to_string(list_transform(range(1, page_id % 6 + 2), lambda i: '<img src="/img_' || i || CASE WHEN i % 2 = 0 THEN '.webp" alt="x" width="4" height="3">' ELSE '.jpg" loading="lazy">' END), '') || '</article>') AS h
  FROM (SELECT *, {choose_sql('page_id', TITLES)} AS t FROM pages))"""
