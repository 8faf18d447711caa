"""Host-level quality rules, with DataFrame functions only.

Each document is measured over its whole text (null: no text) and judged by the base rule, that
it has at least 50 words and not more than half of them in repeated three-word windows.  Four
rules are then counted by host.  A host's failure rate under a rule is shrunk towards the mean
of all hosts with a beta prior whose two parameters are fitted to the hosts' rates by moments, so
that a host with few documents is not judged by them alone.  A host that exceeds a rule's limit
fails, and its documents with it; documents without a host (null) have only the base rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import written

#: Fails if ...; and the shrunk failure rate beyond which a host fails.
RULES = {
    "base": ("base_failed", 0.5),
    "symbols": ("10 * n_symbols > n_words", 0.5),
    "dup_lines": ("10 * n_dup_lines > 3 * n_lines", 0.5),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 15 * n_words", 0.5),
}
#: Bounds of a prior's weight, in documents.
WEIGHT = (1.0, 1000.0)

_SPACE = " \t\n\x0b\x0c\r"


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, not once for each element of an inner loop."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """How many words lie in a three-word window that the array holds twice or more."""

    def of_windows(windows: Column) -> Column:
        hashes = F.transform(windows, lambda w: w["h"])

        def of_sorted(by_hash: Column) -> Column:
            # Windows that equal a neighbour in the order of hashes, by position.
            again = F.filter(by_hash, lambda w, i: F.coalesce(F.get(by_hash, i - 1)["h"] == w["h"], F.lit(False)) | F.coalesce(F.get(by_hash, i + 1)["h"] == w["h"], F.lit(False)))
            at = F.array_sort(F.transform(again, lambda w: w["i"]))
            # Each covers three words, less what the next one covers too.
            return _let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(windows), F.lit(0).cast("long")).otherwise(_let(F.array_sort(windows), of_sorted))

    def of_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(_let(windows, of_windows))

    return _let(words, of_words)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_SPACE)) != "")
    stats = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))
    line_stats = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).alias("host"),
        stats.alias("words"),
        F.length(F.translate(text, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        line_stats.alias("lines"),
    )
    rows = rows.select("doc_id", "host", "words.n_words", "word_chars", "n_symbols", "lines.n_lines", "lines.n_dup_lines", "words.n_repeat_words")
    return rows.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def host_verdicts(measured: DataFrame) -> DataFrame:
    """For each host: documents, the failures and shrunk rate under each rule, and whether it failed."""
    counts = [F.count_if(F.expr(rule)).alias(f"{name}_failures") for name, (rule, _) in RULES.items()]
    hosts = measured.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *counts)
    rates = {name: F.col(f"{name}_failures") / F.col("n") for name in RULES}
    # One row of two numbers a rule, whatever the number of hosts.
    prior = hosts.agg(*[f(r).alias(f"{name}_{what}") for name, r in rates.items() for what, f in (("mean", F.avg), ("var", F.var_pop))]).first()
    out = hosts
    failed = F.lit(False)
    for name, (_, limit) in RULES.items():
        mean, var = prior[f"{name}_mean"] or 0.0, prior[f"{name}_var"] or 0.0
        weight = max(WEIGHT[0], min(WEIGHT[1], mean * (1 - mean) / var - 1)) if var > 0 else WEIGHT[1]
        out = out.withColumn(f"{name}_rate", (F.col(f"{name}_failures") + F.lit(weight * mean)) / (F.col("n") + F.lit(weight)))
        failed = failed | (F.col(f"{name}_rate") > limit)
    return out.withColumn("host_failed", failed).select("host", "n", *[f"{r}_{x}" for r in RULES for x in ("failures", "rate")], "host_failed")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``measure``'s columns, with host_failed and kept.

    The measures are written once, narrow, since both the hosts' counts and the documents need them.
    """
    measured = written(measure(docs, id_col, text_col, host_col))
    # Only failed hosts, and written, so that Spark can split a hot host in the join.
    verdicts = written(host_verdicts(measured).where("host_failed").select("host", "host_failed"))
    out = measured.join(verdicts, "host", "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
