"""Fetching: a frame of URLs to a crawl table, one request for the page and one for its preview image.

A scheme other than http or https is bad input.  A response is read up to ``BODY_BYTES``, an image up
to the bytes that hold its dimensions.  A transport failure leaves status and body null, so that a
flaky network never looks like a broken page.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crawl import BODY_BYTES
from .html import parse
from .images import PROBE_BYTES

# Limits of a request.
TIMEOUT_S = 20
REDIRECTS = 8
AGENT = "folioscope/1"

_HEADERS = pa.map_(pa.string(), pa.string())
SCHEMA = pa.schema([("label", pa.string()), ("status", pa.int32()), ("headers", _HEADERS), ("body", pa.binary()), ("image_status", pa.int32()), ("image_type", pa.string()), ("image_bytes", pa.binary())])
DDL = "label string, status int, headers map<string,string>, body binary, image_status int, image_type string, image_bytes binary"


class _Redirects(urllib.request.HTTPRedirectHandler):
    max_redirections = REDIRECTS


def get(url: str, limit: int) -> tuple[int | None, list[tuple[str, str]], bytes | None]:
    """(status, headers, body) of a URL; of an error response without its body."""
    if not url.lower().startswith(("http://", "https://")):
        return None, [], None
    opener = urllib.request.build_opener(_Redirects)
    try:
        with opener.open(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=TIMEOUT_S) as response:
            return response.status, response.getheaders(), response.read(limit)
    except urllib.error.HTTPError as error:
        return error.code, error.headers.items(), None
    except (OSError, ValueError):
        return None, [], None


def preview_image(markup: str) -> str | None:
    """The absolute og:image of a page, null if it has none."""
    image = alias = None
    for m in parse(markup)["metas"]:
        name = (m["property"] or "").lower()
        if m["content"] is not None and name == "og:image":
            image = m["content"]
        elif m["content"] is not None and name in ("og:image:url", "og:image:secure_url"):
            alias = alias or m["content"]
    image = image or alias
    return image if image and image.startswith(("http://", "https://")) else None


def fetch(urls: DataFrame, url_col: str = "url", per_task: int = 50) -> DataFrame:
    """The crawl table of the distinct URLs of a frame, about ``per_task`` requests a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                status, headers, body = get(url, BODY_BYTES)
                row = {"label": url, "status": status, "headers": list(dict((k.lower(), v) for k, v in headers).items()), "body": body}
                if body and (image := preview_image(body.decode("utf-8", "replace"))):
                    row["image_status"], names, row["image_bytes"] = get(image, PROBE_BYTES)
                    row["image_type"] = next((v for k, v in names if k.lower() == "content-type"), None)
                yield pa.RecordBatch.from_pylist([row], schema=SCHEMA)

    rows = urls.select(F.col(url_col).alias("url")).where("url is not null").distinct()
    tasks = max(1, -(-rows.count() // per_task))
    return rows.repartition(tasks, "url").mapInArrow(run, DDL)
