"""Fetching from a local server; the catalogue of rules."""

import datetime
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from folioscope.operators import banks
from folioscope.plans import manifest
from folioscope.sources import crawl, http

PNG = bytes.fromhex("89504E470D0A1A0A0000000D49484452000004B000000276")


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        base = f"http://127.0.0.1:{self.server.server_address[1]}"
        page = f'<head><title>t</title><meta property="og:image" content="{base}/i.png"></head><body><h1>x</h1>'.encode()
        status, kind, body = {"/": (200, "text/html", page), "/i.png": (200, "image/png", PNG), "/moved": (302, "text/html", b"")}.get(self.path, (404, "text/plain", b"no"))
        self.send_response(status)
        self.send_header("Content-Type", kind)
        if status == 302:
            self.send_header("Location", "/")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    http_server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http_server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http_server.server_address[1]}"
    http_server.shutdown()


def test_fetch(spark, server):
    urls = [(f"{server}/",), (f"{server}/moved",), (f"{server}/gone",), ("ftp://x/",), ("http://127.0.0.1:1/",), (None,), (f"{server}/",)]
    rows = http.fetch(spark.createDataFrame(urls, "url string"))
    got = {r.label.removeprefix(server): (r.status, r.image_status) for r in rows.collect()}
    assert got == {"/": (200, 200), "/moved": (200, 200), "/gone": (404, None), "ftp://x/": (None, None), "http://127.0.0.1:1/": (None, None)}
    audits = crawl.audit_crawl(rows, datetime.date(2026, 5, 1)).collect()
    assert sorted(r.file.removeprefix(server) for r in audits) == ["/", "/moved"]
    assert all(r.fetched.og_image_check.width == 1200 and not r.response_findings for r in audits)


def test_manifest(spark):
    rows = manifest.manifest(spark)
    kinds = {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()}
    assert kinds["phrase"] == 22 and kinds["aside"] == 30 and kinds["design_line"] == 28 and kinds["factor"] == 6
    assert manifest.pattern_table(spark).count() == len(banks.PHRASES) + len(banks.ASIDES)


def _webp(name, body):
    return b"RIFF" + bytes(4) + b"WEBP" + name + bytes(4) + body + bytes(20)


def _jpeg(*segments):
    return b"\xff\xd8" + b"".join(segments) + b"\xff\xda\x00\x02" + bytes(20)


def _segment(marker, payload):
    return bytes([0xFF, marker]) + (len(payload) + 2).to_bytes(2, "big") + payload


def test_sizes_of_webp_and_jpeg(spark):
    from folioscope.sources import images

    frame = b"\x08" + (630).to_bytes(2, "big") + (1200).to_bytes(2, "big") + b"\x03" + bytes(9)
    app = _segment(0xE0, b"JFIF\x00" + b"\xff\xc0\x00\x11\x08\x00\x01\x00\x01")
    lossless = 1199 | 629 << 14
    want = {
        _webp(b"VP8X", bytes(4) + (1199).to_bytes(3, "little") + (629).to_bytes(3, "little")): (1200, 630),
        _webp(b"VP8L", b"\x2f" + lossless.to_bytes(4, "little")): (1200, 630),
        _webp(b"VP8 ", b"\x10\x00\x00\x9d\x01\x2a" + (1200 | 1 << 14).to_bytes(2, "little") + (630).to_bytes(2, "little")): (1200, 630),
        _webp(b"VP8L", b"\x2e" + bytes(4)): None,
        _webp(b"ALPH", bytes(10)): None,
        _webp(b"VP8X", b"")[:29]: None,
        _jpeg(app, _segment(0xC0, frame)): (1200, 630),
        _jpeg(app, b"\xff\xff\xff" + _segment(0xC2, frame)): (1200, 630),
        _jpeg(_segment(0xC4, frame), b"\xff\x01", _segment(0xC1, frame)): (1200, 630),
        _jpeg(app): None,
        _jpeg(_segment(0xC0, frame))[:8]: None,
        b"\xff\xd8\xff\xe0\x00\x01": None,
        b"": None,
    }
    rows = spark.createDataFrame([(bytearray(d),) for d in want], "d binary").select(images.dimensions(F.col("d")).alias("s"), images.looks_like_image(F.col("d")).alias("i")).collect()
    assert [tuple(r.s) if r.s else None for r in rows] == list(want.values())
    assert [r.i for r in rows] == [bool(d) for d in want]
