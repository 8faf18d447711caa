"""Crawl tables: what the response of a page, and of its preview image, adds to the audit.

A crawl table has label, status, headers (map), body (binary), and for the image that og:image names
image_status, image_type, image_bytes.  Fetching is left to a crawler; this engine reads its table.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip
from ..plans.audit import audit
from .documents import type_of_content_type
from .images import PROBE_BYTES, dimensions, looks_like_image

#: The headers that are kept, and the limits of a body and of its compression.
HEADERS = ["content-type", "x-robots-tag", "content-encoding", "cache-control", "last-modified", "server"]
BODY_BYTES = 10 << 20
UNCOMPRESSED_BYTES = 50_000


def lower_keys(headers: Column) -> Column:
    """The headers by lower-case name; the last of equal names counts."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def status_class(status: Column) -> Column:
    """ok, rate_limited (429), bad_input (other 4xx) or transient (5xx, or no response)."""
    return F.when(status.isNull() | (status >= 500), "transient").when(status == 429, "rate_limited").when(status >= 400, "bad_input").otherwise("ok")


def _rules(rows: list[tuple[str, Column]]) -> Column:
    made = [F.struct(F.lit(k).alias("rule_id"), m.alias("message")) for k, m in rows]
    return F.filter(F.array(*made), lambda x: x["message"].isNotNull())


def header_findings(robots: Column, encoding: Column, size: Column) -> Column:
    """Findings of response headers: array of (rule_id, message)."""

    def of_tokens(names: Column) -> Column:
        def has(*tokens: str) -> Column:
            return F.coalesce(F.arrays_overlap(names, F.array(*[F.lit(t) for t in tokens])), F.lit(False))

        return _rules(
            [
                ("xrobots_noindex", F.when(has("noindex", "none"), F.concat(F.lit("X-Robots-Tag header is `"), robots, F.lit("`. Page excluded from index at the header level — meta-robots can't override this.")))),
                ("xrobots_nofollow", F.when(has("nofollow") & ~has("noindex"), F.lit("X-Robots-Tag header includes `nofollow`. Links on this page pass no authority."))),
                ("xrobots_noimageindex", F.when(has("noimageindex"), F.lit("X-Robots-Tag includes `noimageindex`. Page images won't appear in image search."))),
                ("xrobots_noai", F.when(has("noai", "noimageai"), F.lit("X-Robots-Tag includes `noai`/`noimageai` (non-standard — Google and Anthropic document robots.txt user-agent controls instead, not these directives). Treat as a signal of intent, not enforcement."))),
                ("no_compression", F.when(encoding.isNull() & (size > UNCOMPRESSED_BYTES), F.concat(F.floor(size / 1024).cast("string"), F.lit(" KB response with no Content-Encoding (no Brotli/gzip). Compression cuts transfer size 70–85%.")))),
            ]
        )

    return let(F.transform(F.split(F.lower(F.coalesce(robots, F.lit(""))), "[,;]"), strip), of_tokens)


def image_probe(kind: Column, data: Column) -> Column:
    """struct(width, height, svg, image): what an image's content type and first bytes show."""
    bytes_ = F.substring(data, 1, PROBE_BYTES)
    start = F.hex(F.substring(data, 1, 5))
    svg = F.coalesce(F.contains(kind, F.lit("svg")), F.lit(False)) | start.startswith("3C737667") | (start == "3C3F786D6C")
    image = F.coalesce(kind.startswith("image/"), F.lit(False)) | looks_like_image(bytes_)
    return let(dimensions(bytes_), lambda s: F.struct(s["width"].alias("width"), s["height"].alias("height"), F.coalesce(svg, F.lit(False)).alias("svg"), F.coalesce(image, F.lit(False)).alias("image")))


def image_findings(url: Column, status: Column, kind: Column, probe: Column, declared_width: Column) -> Column:
    """Findings of the preview image's response; none without a response or for a URL that isn't absolute."""
    answered = (url.startswith("https://") | url.startswith("http://")) & status.isNotNull()
    failed = status >= 400

    def of_size(s: Column) -> Column:
        w, h, svg, image = s["width"], s["height"], s["svg"], s["image"]
        size = F.concat(w.cast("string"), F.lit("×"), h.cast("string"))
        shown = answered & ~failed
        tiny = (w < 200) | (h < 200)
        declared = F.when(declared_width.rlike(r"^\+?[0-9]+$"), declared_width.try_cast("bigint"))
        return _rules(
            [
                ("og_image_http_error", F.when(answered & failed, F.concat(F.lit("og:image returns HTTP "), status.cast("string"), F.lit(". Every share and AI-citation preview renders blank — fix the URL or ship a new image.")))),
                ("og_image_svg", F.when(shown & svg, F.lit("og:image is SVG. Most platforms refuse SVG previews — export a 1200×630 PNG or JPEG."))),
                ("og_image_not_image", F.when(shown & ~svg & ~image, F.concat(F.lit("og:image serves `"), F.coalesce(kind, F.lit("unknown content-type")), F.lit("`, not an image — a bot challenge, login redirect, or error page is answering in its place.")))),
                ("og_image_tiny", F.when(shown & tiny, F.concat(F.lit("og:image is "), size, F.lit(". Below the 200×200 platform minimum — it will be ignored outright.")))),
                ("og_image_small", F.when(shown & ~tiny & (w < 600), F.concat(F.lit("og:image is "), size, F.lit(". Under 600 px wide, platforms fall back to the small-thumbnail layout — ship 1200×630.")))),
                ("og_image_soft", F.when(shown & ~tiny & (w >= 600) & (w < 1200), F.concat(F.lit("og:image is "), size, F.lit(". Renders soft on high-DPI screens; 1200×630 is the standard.")))),
                ("og_image_portrait", F.when(shown & (h > w), F.concat(F.lit("og:image is portrait ("), size, F.lit("). Preview cards crop to 1.91:1 landscape — faces and text will be cut.")))),
                ("og_image_declared_mismatch", F.when(shown & (declared != w), F.concat(F.lit("og:image:width declares "), declared.cast("string"), F.lit(" but the file is "), w.cast("string"), F.lit(" px. Cards lay out from the declared size — align the tags with the file.")))),
            ]
        )

    return let(probe, of_size)


def audit_crawl(crawl: DataFrame, as_of: datetime.date, factors: list[str] | None = None, fail_under: int | None = None) -> DataFrame:
    """The audit of the pages that answered, with ``fetched`` and the findings of the responses in front.

    Response findings pass the factor filter and don't touch the score.  A body is cut at ``BODY_BYTES``
    and decoded with replacement of what is not UTF-8.
    """
    rows = crawl.where(status_class(F.col("status")) == "ok").withColumn("headers", lower_keys(F.col("headers")))
    body = F.substring("body", 1, BODY_BYTES)
    rows = rows.select(
        F.xxhash64("label").alias("doc_id"),
        "label",
        type_of_content_type(F.col("headers")["content-type"]).alias("file_type"),
        F.expr(f"make_valid_utf8(cast(substring(body, 1, {BODY_BYTES}) as string))").alias("raw"),
        F.octet_length(body).alias("bytes"),
        "status",
        "headers",
        "image_status",
        "image_type",
        image_probe(F.col("image_type"), F.col("image_bytes")).alias("probe"),
    )
    extra = ("status", "headers", "bytes", "image_status", "image_type", "probe")
    both = audit(rows, as_of, factors, fail_under, keep=extra)
    names = [c for c in both.columns if c not in extra]
    og, headers, probe = F.col("open_graph"), F.col("headers"), F.col("probe")
    made = F.concat(header_findings(headers["x-robots-tag"], headers["content-encoding"], F.col("bytes")), image_findings(og["image"], F.col("image_status"), F.col("image_type"), probe, og["image_width"]))
    both = both.withColumn("response_findings", made)
    check = F.when(F.col("image_status").isNotNull() & og["image"].rlike("^https?://"), F.struct(og["image"].alias("url"), F.col("image_status").alias("status"), F.when(F.col("image_status") < 400, F.col("image_type")).alias("content_type"), probe["width"].alias("width"), probe["height"].alias("height")))
    fetched = F.struct(F.col("file").alias("url"), "status", "bytes", *[headers[h].alias(h.replace("-", "_")) for h in HEADERS], check.alias("og_image_check"))
    front = F.transform("response_findings", lambda x: x["message"])
    both = both.withColumn("fetched", fetched).withColumn("suggestions", F.concat(front, "suggestions"))
    return both.select(*names, "response_findings", "fetched")
