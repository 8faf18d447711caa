"""Image dimensions from the first bytes of a file.

PNG and GIF have native expressions; WebP and JPEG need a walk through the header and go through Arrow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Bytes that suffice for the header of every supported format.
PROBE_BYTES = 64 * 1024


def _big(data: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("bigint")


def _little(data: Column, at: int) -> Column:
    return _big(data, at + 1, 1) * 256 + _big(data, at, 1)


def _starts(data: Column, signature: str) -> Column:
    return F.hex(F.substring(data, 1, len(signature) // 2)) == signature


def png_dimensions(data: Column) -> Column:
    return F.when((F.octet_length(data) >= 24) & _starts(data, "89504E470D0A1A0A"), F.struct(_big(data, 16, 4).alias("width"), _big(data, 20, 4).alias("height")))


def gif_dimensions(data: Column) -> Column:
    return F.when((F.octet_length(data) >= 10) & _starts(data, "47494638"), F.struct(_little(data, 6).alias("width"), _little(data, 8).alias("height")))


#: Fixed values, of WebP's container: the first chunk's name, where its data has a start code and which, the bits at which
#: width and height begin, their number, and what is stored less than the size.
_WEBP = {
    b"VP8X": (0, b"", 32, 56, 24, 1),
    b"VP8L": (0, b"\x2f", 8, 22, 14, 1),
    b"VP8 ": (3, b"\x9d\x01\x2a", 48, 64, 14, 0),
}
#: Bytes of the longest of these headers, container included; a shorter file has no size.
_WEBP_BYTES = 30
#: Fixed values, of JPEG's markers: those that begin a frame, and those without a length.
_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_BARE = frozenset([0x00, 0x01, *range(0xD0, 0xD9)])
_SCAN, _END = 0xDA, 0xD9
_MARKER = re.compile(rb"\xff+([^\xff])", re.DOTALL)


def webp(data: bytes) -> tuple[int, int] | None:
    layout = _WEBP.get(data[12:16]) if data.startswith(b"RIFF") and data[8:12] == b"WEBP" and len(data) >= _WEBP_BYTES else None
    if layout is None:
        return None
    at, code, width, height, bits, less = layout
    body = data[20:_WEBP_BYTES]
    if not body.startswith(code, at):
        return None
    packed, mask = int.from_bytes(body, "little"), (1 << bits) - 1
    return (packed >> width & mask) + less, (packed >> height & mask) + less


def jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, payload) of each segment before the first scan; bytes between segments are passed over."""
    found = _MARKER.search(data) if data.startswith(b"\xff\xd8\xff") else None
    while found and (marker := found[1][0]) not in (_SCAN, _END):
        end = found.end()
        if marker not in _BARE:
            size = int.from_bytes(data[end : end + 2], "big")
            if size < 2:
                return
            yield marker, data[end + 2 : end + size]
            end += size
        found = _MARKER.search(data, end)


def jpeg(data: bytes) -> tuple[int, int] | None:
    """The size that the first frame's header states, behind a byte of precision: lines, then samples a line."""
    header = next((payload for marker, payload in jpeg_segments(data) if marker in _FRAMES), b"")
    return (int.from_bytes(header[3:5], "big"), int.from_bytes(header[1:3], "big")) if len(header) >= 5 else None


@F.pandas_udf(StructType([StructField("width", LongType()), StructField("height", LongType())]))
def _walked(data: pd.Series) -> pd.DataFrame:
    found = [(webp(d) or jpeg(d)) if d is not None else None for d in data]
    return pd.DataFrame({"width": [f[0] if f else None for f in found], "height": [f[1] if f else None for f in found]}, dtype="Int64")


def dimensions(data: Column) -> Column:
    """struct(width, height) of PNG, GIF, WebP or JPEG bytes; null fields if there are none."""
    head = F.substring(data, 1, PROBE_BYTES)
    walked = _walked(head)
    size = F.coalesce(png_dimensions(head), gif_dimensions(head), walked)
    return F.when(size["width"].isNotNull(), size)


def looks_like_image(data: Column) -> Column:
    webp_ = (F.octet_length(data) >= 12) & _starts(data, "52494646") & (F.hex(F.substring(data, 9, 4)) == "57454250")
    return _starts(data, "89504E47") | _starts(data, "47494638") | webp_ | _starts(data, "FFD8FF") | _starts(data, "3C737667") | _starts(data, "3C3F786D6C")
