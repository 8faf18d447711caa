"""Documents from files and frames: type, Markdown rendering, rejects.

A document frame has doc_id, label, file_type ('html' or 'markdown') and raw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let

#: File extensions and their types.
EXTENSIONS = {"html": "html", "htm": "html", "md": "markdown", "mdx": "markdown"}


def type_of_path(path: Column) -> Column:
    """The type by extension, null if it is not supported."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair]), extension)


def sniffed_type(raw: Column) -> Column:
    return F.when(raw.rlike(r"(?U)^\s*<"), "html").otherwise("markdown")


def type_of_content_type(header: Column) -> Column:
    """Of an HTTP content type: markdown if it says so, else html."""
    return F.when(F.coalesce(F.contains(F.lower(header), F.lit("markdown")), F.lit(False)), "markdown").otherwise("html")


def _escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def markdown_to_html(raw: Column) -> Column:
    """Headings of three levels, and a paragraph for every other line; front matter goes.  One line of markup."""
    closed = F.instr(F.substring(raw, F.lit(4), F.length(raw)), "\n---")
    body = F.when(raw.startswith("---") & (closed > 0), F.substring(raw, closed + 7, F.length(raw))).otherwise(raw)

    def line(x: Column) -> Column:
        def of_trimmed(t: Column) -> Column:
            out = F.when(t == "", F.lit("")).otherwise(F.concat(F.lit("<p>"), _escaped(t), F.lit("</p>")))
            for level in (1, 2, 3):
                mark = "#" * level + " "
                rest = F.substring(t, F.lit(level + 2), F.length(t))
                out = F.when(t.startswith(mark), F.concat(F.lit(f"<h{level}>"), _escaped(rest), F.lit(f"</h{level}>"))).otherwise(out)
            return out

        return let(F.regexp_replace(x, r"(?U)^\s+", ""), of_trimmed)

    rendered = F.array_join(F.transform(F.split(body, r"\r?\n"), line), "")
    return F.concat(F.lit("<!DOCTYPE html><html><head></head><body>"), rendered, F.lit("</body></html>"))


def with_markup(docs: DataFrame) -> DataFrame:
    """Adds html_like: the raw markup, or Markdown rendered; null texts are empty."""
    raw = F.coalesce("raw", F.lit(""))
    return docs.withColumn("html_like", F.when(F.col("file_type") == "markdown", markdown_to_html(raw)).otherwise(raw))


def read_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of a file, folder or glob.  Rejects have label and reason; doc_id is a hash of the label."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.col("path").alias("label"), type_of_path(F.col("path")).alias("file_type"), "content")
    text = F.expr("try_validate_utf8(cast(content as string))")
    rows = rows.select(F.xxhash64("label").alias("doc_id"), "label", "file_type", text.alias("raw"))
    reason = F.when(F.col("file_type").isNull(), "unsupported file type").when(F.col("raw").isNull(), "not UTF-8")
    return rows.where(reason.isNull()), rows.where(reason.isNotNull()).select("label", reason.alias("reason"))


def from_frame(rows: DataFrame, id_col: str, text_col: str, label_col: str | None = None, file_type: str | None = None) -> DataFrame:
    """Documents of a frame; without ``file_type`` it is sniffed."""
    kind = F.lit(file_type) if file_type else sniffed_type(F.col(text_col))
    label = F.col(label_col) if label_col else F.concat(F.lit("doc-"), F.col(id_col).cast("string"))
    return rows.select(F.col(id_col).alias("doc_id"), label.alias("label"), kind.alias("file_type"), F.col(text_col).alias("raw"))
