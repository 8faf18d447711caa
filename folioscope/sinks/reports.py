"""Report files.  JSON and SARIF are columns; the HTML page is rendered by partition, in Arrow batches."""

from __future__ import annotations

import datetime
import html
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "1"
TOOL = "folioscope"
#: Score from which a report is good, and middling.
BANDS = (85, 60)
#: Error codes, and the exit codes that a command line would give them.
ERRORS = {"invalid_input": 3, "config_error": 2, "rate_limited": 4, "transient_error": 1, "io_error": 1, "quality_gate": 1, "verify_failed": 1}
_OPTIONS = {"ignoreNullFields": "false"}


def to_report_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), _OPTIONS)


def envelope(data: Column) -> Column:
    """The success envelope around a struct."""
    return F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit("success").alias("status"), data.alias("data")), _OPTIONS)


def error_envelope(code: Column, message: Column, suggestion: Column) -> Column:
    error = F.struct(code.alias("code"), message.alias("message"), suggestion.alias("suggestion"))
    return F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit("error").alias("status"), error.alias("error")), _OPTIONS)


def sarif_results(file: Column, suggestions: Column) -> Column:
    """One SARIF result for each suggestion."""

    def result(s: Column) -> Column:
        place = F.struct(F.struct(F.struct(file.alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
        return F.struct(F.lit(f"{TOOL}.audit.suggestion").alias("ruleId"), F.lit("warning").alias("level"), F.struct(s.alias("text")).alias("message"), F.array(place).alias("locations"))

    return F.transform(suggestions, result)


def sarif(file: Column, suggestions: Column, score: Column) -> Column:
    """A SARIF 2.1.0 log of one document as JSON."""
    rule = F.struct(F.lit(f"{TOOL}.audit.suggestion").alias("id"), F.lit("AuditSuggestion").alias("name"), F.struct(F.lit("audit suggestion").alias("text")).alias("shortDescription"))
    driver = F.struct(F.lit(TOOL).alias("name"), F.lit(VERSION).alias("version"), F.array(rule).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), sarif_results(file, suggestions).alias("results"), F.struct(score.alias(f"{TOOL}.score")).alias("properties"))
    return F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs")), _OPTIONS)


def score_band(score: int) -> str:
    return "good" if score >= BANDS[0] else "mid" if score >= BANDS[1] else "poor"


def _cells(row: tuple, cell: str = "td") -> str:
    return "<tr>" + "".join(f"<{cell}>{html.escape('not detected' if c is None else str(c), quote=True)}</{cell}>" for c in row) + "</tr>"


def _table(title: str, rows: list[tuple], head: tuple | None = None) -> str:
    if not rows:
        return ""
    return f"<h2>{title}</h2>\n<table>" + (_cells(head, "th") if head else "") + "".join(map(_cells, rows)) + "</table>\n"


def _yes(flag: bool | None) -> str:
    return "yes" if flag else "no"


def render_html(a: dict, as_of: datetime.date) -> str:
    """The self-contained page of one report; long lists show their first entries."""
    title = (a["meta"]["title"] or "").strip() or a["file"]
    content, fresh, perf, links = a["content"], a["freshness"], a["performance"], a["link_graph"]
    out = [f"<header><h1>{html.escape(title)}</h1><p>audit of {as_of} <b class='{score_band(a['score'])}'>{a['score']}/100</b></p><p>{html.escape(a['file'])}</p></header>\n<h2>Findings</h2>\n"]
    out.append("<ol>" + "".join(f"<li>{html.escape(s)}</li>" for s in a["suggestions"]) + "</ol>\n" if a["suggestions"] else "<p>No findings.</p>\n")
    out.append(_table("Score", [(c["name"], c["reason"], -c["deducted"]) for c in a["score_breakdown"]["components"]], ("Component", "Reason", "Points")))
    out.append(_table("Found", [("Title", a["meta"]["title"]), ("Description", a["meta"]["description"]), ("Schema", ", ".join(a["schema_types"]) or None), ("og:image", a["open_graph"]["image"])]))
    out.append(_table("Indexing", [("Canonical", a["meta"]["canonical"]), ("Robots", a["meta"]["robots"]), ("Viewport", a["meta"]["viewport"]), ("Favicon", _yes(a["meta"]["favicon"])), ("hreflang", ", ".join(content["hreflangs"]) or None), ("noscript", content["noscript_kind"])]))
    dates = [(k, fresh[k]) for k in ("date_modified", "date_published", "time_datetime", "visible_updated_label", "days_since_modified")]
    if any(v is not None for _, v in dates):
        out.append(_table("Freshness", [*dates, ("agreement", fresh["schema_vs_visible_severity"])]))
    out.append(_table("Signals", [("Words", content["word_count"]), ("Answer block", _yes(content["has_tldr"])), ("FAQ", _yes(content["has_faq"])), ("Author", _yes(content["has_author"])), ("Credentials", _yes(content["has_credentials"])), ("Tables", content["table_count"]), ("Quotable sentences", content["quotable_sentence_count"]), ("Images without alt", content["missing_alt_count"])]))
    slop, asides, copy, design, gain = (a[k] for k in ("ai_slop", "metatext", "copy_precision", "design_slop", "information_gain"))
    out.append(_table("Verdicts", [("Phrases", slop["verdict"], slop["density_per_1000_words"]), ("Asides", asides["verdict"], asides["weighted_score_per_1000_words"]), ("Design", design["verdict"], len(design["findings"])), ("Copy precision", copy["verdict"], copy["score"]), ("Information gain", "", gain["score"])]))
    out.append(_table("Phrases", [(s["kind"], s["snippet"], f"{s['position_pct']}%") for s in slop["signals"][:15]]))
    out.append(_table("Asides", [(s["kind"], s["snippet"], f"{s['position_pct']}%") for s in asides["signals"][:15]]))
    out.append(_table("Design", [(f["id"], f["snippet"]) for f in design["findings"][:20]]))
    out.append(_table("Copy precision", sorted(copy["densities"].items())))
    out.append(_table("Information gain", [*gain["counts"].items(), *((s["kind"], s["snippet"]) for s in gain["samples"][:8])]))
    out.append(_table("Keywords", [(k["term"], k["count"]) for k in a["keywords"]["primary"][:8]] + [("question", q) for q in a["keywords"]["questions"][:6]]))
    out.append(_table("Entities", [(p["name"], p["credentials"]) for p in a["entities"]["people"][:8]] + [("organization", o) for o in a["entities"]["organizations"][:10]]))
    out.append(_table("Voice", [("Snippet", a["voice"]["featured_snippet_candidate"]), ("Speakable", _yes(a["voice"]["speakable_eligible"])), ("Words a sentence", a["voice"]["avg_sentence_words"])]))
    out.append(_table("Evidence", [("Statistics", a["evidence"]["stat_count"]), ("Quotes", a["evidence"]["quote_count"]), *(("Unsupported", c["snippet"]) for c in a["evidence"]["unsupported_claims"][:10])]))
    out.append(_table("Performance", [(f"{k}.{n}", v) for k, group in perf.items() for n, v in group.items()]))
    if links["total"]:
        out.append(_table("Links", list(links.items())))
    if a.get("fetched"):
        out.append(_table("Response", [(k, v) for k, v in a["fetched"].items() if not isinstance(v, dict)]))
    out.append(_table("Headings", [(f"H{h['level']}", h["text"]) for h in content["headings_in_order"][:30]]))
    style = "body{font:16px/1.5 sans-serif;max-width:48rem;margin:2rem auto}td,th{padding:.2rem .8rem;text-align:left;border-bottom:1px solid}"
    return f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body>\n{"".join(out)}</body></html>\n'


def html_reports(audits: DataFrame, as_of: datetime.date) -> DataFrame:
    """(doc_id, file, html) of each report."""
    names = [c for c in audits.columns if c != "findings"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [dict(zip(names, values, strict=True)) for values in zip(*(_plain(c) for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(names.index("doc_id")), pa.array([r["file"] for r in rows], pa.string()), pa.array([render_html(r, as_of) for r in rows], pa.string())], ["doc_id", "file", "html"])

    return audits.select(*names).mapInArrow(run, f"doc_id {audits.schema['doc_id'].dataType.simpleString()}, file string, html string")


def _plain(column: pa.Array) -> list:
    def clean(value, kind):
        if value is None:
            return {} if pa.types.is_map(kind) else None
        if pa.types.is_map(kind):
            return dict(value)
        if pa.types.is_struct(kind):
            return {f.name: clean(value[f.name], f.type) for f in kind}
        return value

    return [clean(v, column.type) for v in column.to_pylist()]


def write_reports(audits: DataFrame, path: str, kind: str, as_of: datetime.date) -> None:
    """Write a folder of reports: kind 'json' (one line a document), 'sarif' or 'html' (Parquet of pages); else a ValueError."""
    if kind == "json":
        audits.drop("findings").write.option("ignoreNullFields", "false").json(path)
    elif kind == "sarif":
        audits.select(sarif(F.col("file"), F.col("suggestions"), F.col("score")).alias("value")).write.text(path)
    elif kind in ("html", "htm"):
        html_reports(audits, as_of).write.parquet(path)
    else:
        raise ValueError(f"unsupported report kind {kind!r} (expected json, html, sarif)")


def summary(audits: DataFrame) -> DataFrame:
    """What a reader wants first: file, score, words, schema types, suggestions as bullets."""
    return audits.select("file", "score", F.col("content.word_count").alias("words"), F.array_join("schema_types", ", ").alias("schemas"), F.array_join(F.transform("suggestions", lambda s: F.concat(F.lit("• "), s)), "\n").alias("bullets"))


def acknowledgement(audits: DataFrame, path: str) -> DataFrame:
    """What a writer reports back: where, and the score."""
    return audits.select(F.lit(path).alias("wrote"), "score")
