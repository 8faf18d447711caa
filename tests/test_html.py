"""The HTML parser on hand-written pages."""

import pytest

from folioscope.sources.documents import from_frame, markdown_to_html, read_files
from folioscope.sources.html import parse


def test_chrome():
    p = parse("<body><header><nav>n</nav><h1>site</h1></header><header><h1>hero</h1></header><nav>x</nav><aside><h2>a</h2></aside><footer>f<table></table></footer><table></table>body</body>")
    assert [h["text"] for h in p["headings"]] == ["hero"]
    assert p["body_text"] == "hero body" and p["table_count"] == 1


def test_main_is_the_root():
    p = parse("<body>out<main>in<nav>no</nav></main><h2>after</h2><a href=x>l</a>")
    assert p["body_text"] == "in" and p["headings"][0]["text"] == "after" and len(p["anchors"]) == 1


def test_raw_text():
    p = parse("<head><script>if (a<b) {'</p>'}</script><style>p>a{}</style><noscript><img src=a></noscript><title>A &amp; B</title></head><body>x<script>y</script><template>z</template>")
    assert p["title"] == "A & B" and p["body_text"] == "x" and not p["images"] and p["noscripts"] == ["<img src=a>"]
    assert p["style_bytes"] == 5 and [s["in_head"] for s in p["scripts"]] == [True, False]


@pytest.mark.parametrize("markup", ["", None, "<", "<a", "<a href='", "<!--", "<!-- x", "</", "</x", "text", "<p><b></p></b>", "<table><tr><td>x", "<svg><title>s</title><path/></svg>", "<title>", "<<>>", "&", "&#xfffffff;", "<a b=c=d 'e' = f>", "\x00"])
def test_never_fails(markup):
    assert isinstance(parse(markup)["body_text"], str)


def test_repairs():
    p = parse("<title>t</title><h1>a<h2>b</h2><p>c<p>d<ul><li>e<li>f</ul><a href=1>g<a href=2>h</a>")
    assert [(h["level"], h["text"]) for h in p["headings"]] == [(1, "a"), (2, "b")]
    assert [(a["href"], a["text"]) for a in p["anchors"]] == [("1", "g"), ("2", "h")]
    assert p["title"] == "t" and p["body_text"] == "a b c d e f g h"


def test_attributes():
    p = parse('<html LANG="de"><meta NAME=Description content="a &quot;b&quot; &copy=1"><img src=x.png alt><link rel="alternate" hreflang=en disabled>')
    assert p["html_lang"] == "de" and p["metas"][0]["content"] == 'a "b" &copy=1'
    assert p["images"][0]["alt"] == "" and p["images"][0]["width"] is None and p["links"][0]["disabled"]


def test_schema_types():
    blocks = ['{"@type": ["B", "A"], "x": [{"@type": "C"}]}', "{bad", '{"@type": NaN}', '[{"y": {"@type": "A"}}]']
    p = parse("".join(f'<script type="Application/LD+json">{b}</script>' for b in blocks))
    assert p["schema_types"] == ["A", "B", "C"]


def test_deep_nesting():
    assert parse("<div>" * 20_000 + "x")["body_text"] == "x"


def test_markdown(spark):
    from pyspark.sql import functions as F

    cases = {"---\na: b\n---\n# H": "<h1>H</h1>", "---\nopen": "<p>---</p><p>open</p>", "  ### a<b\n#### no\n\n": "<h3>a&lt;b</h3><p>#### no</p>"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select(markdown_to_html(F.col("t"))).collect()
    assert [r[0] for r in rows] == [f"<!DOCTYPE html><html><head></head><body>{v}</body></html>" for v in cases.values()]


def test_files(spark, tmp_path):
    (tmp_path / "a.HTML").write_text("<p>x")
    (tmp_path / "b.md").write_text("# x")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "d.htm").write_bytes(b"\xff\xfe")
    docs, rejects = read_files(spark, str(tmp_path))
    assert sorted((r.file_type, r.raw) for r in docs.collect()) == [("html", "<p>x"), ("markdown", "# x")]
    assert sorted(r.reason for r in rejects.collect()) == ["not UTF-8", "unsupported file type"]
    sniffed = from_frame(spark.createDataFrame([(1, " <p>"), (2, "x")], "k long, t string"), "k", "t").collect()
    assert [r.file_type for r in sniffed] == ["html", "markdown"]


def test_deep_markup_takes_linear_time():
    import time

    from folioscope.sources.html import parse

    n = 100_000
    start = time.monotonic()
    assert parse("<div>" * n + "x" + "</div>" * n)["body_text"] == "x"
    assert parse("<header>" * n + "<nav>y</nav>" + "</header>" * n + "z")["body_text"] == "z"
    # Quadratic time would be minutes.
    assert time.monotonic() - start < 20
