"""What the engine can do, as a table: rules, components, patterns, factors, verdicts, outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import banks, design
from ..sinks.reports import ERRORS
from . import rules
from .audit import COMPONENT_FACTORS, FACTORS, FEATURES

VERDICTS = {
    "ai_slop": ["clean", "suspicious", "likely_ai"],
    "metatext": ["clean", "suspicious", "metatext_heavy"],
    "copy_precision": ["tight", "mid", "padded", "insufficient_content"],
    "design_slop": ["clean", "minor", "suspicious", "heavy"],
    "freshness": ["none", "mild", "severe"],
    "noscript": ["absent", "boilerplate_only", "substantive"],
    "verify": ["pass", "fail"],
}


def manifest(spark: SparkSession) -> DataFrame:
    """(kind, ord, id, detail) of everything that a report can contain."""
    rows = [("rule", k, r.id, r.factor) for k, r in enumerate(rules.audit_rules(), 1)]
    rows += [("factor", k, f, ", ".join(words)) for k, (f, words) in enumerate(FACTORS.items(), 1)]
    rows += [("component", k, c, f) for k, (c, f) in enumerate(COMPONENT_FACTORS.items(), 1)]
    rows += [("feature", k, f, "") for k, f in enumerate(FEATURES, 1)]
    rows += [("phrase", k, p.kind, str(p.confidence)) for k, p in enumerate(banks.PHRASES, 1)]
    rows += [("aside", k, p.kind, str(p.confidence)) for k, p in enumerate(banks.ASIDES, 1)]
    rows += [("design_line", k, r.id, r.regex) for k, r in enumerate(design.RULES, 1)]
    rows += [("verdict", k, f"{name}.{v}", "") for name, vs in VERDICTS.items() for k, v in enumerate(vs, 1)]
    rows += [("error", k, code, str(exit_code)) for k, (code, exit_code) in enumerate(ERRORS.items(), 1)]
    rows += [("output", k, o, "") for k, o in enumerate(("json", "html", "sarif"), 1)]
    return spark.createDataFrame(rows, "kind string, ord int, id string, detail string")


def pattern_table(spark: SparkSession) -> DataFrame:
    """The pattern banks as rows (bank, ord, kind, confidence, regex, weights), to query or extend."""
    rows = [("phrases", k, p.kind, banks.CONFIDENCE[p.confidence], p.regex, None) for k, p in enumerate(banks.PHRASES, 1)]
    rows += [("asides", k, p.kind, p.confidence, p.regex, list(p.weights) if p.weights else None) for k, p in enumerate(banks.ASIDES, 1)]
    return spark.createDataFrame(rows, "bank string, ord int, kind string, confidence double, regex string, weights array<double>")
