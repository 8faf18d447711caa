"""Benchmark decontamination by spaced seeds.

Tokens are runs of ASCII letters, digits and bytes over 0x7F, after Unicode case folding.  Each fixed
mask looks at some of ``SPAN`` consecutive tokens and ignores the others; windows of a document
and of a benchmark item that agree under a mask are a hit.  Around a hit both are aligned, and
the best run of the item's tokens is taken, where a match counts 1 and a substitution -3.  A run
of ``OVERLAP`` tokens or more is an overlap, a run of the whole item if that is shorter.  So is a
whole item with one substitution anywhere, or two if it has ``TWO_FROM`` tokens or more.

The masks find all of these in items of more tokens than ``SPAN``.  An item of ``LEAST`` to ``SPAN`` tokens
is sought whole, by seeds that each ignore one of its tokens.  A shorter one is an overlap where it is, without
substitutions, a whole line or sentence, or several: inside of one, ordinary text can't be told from it.

Null and empty texts contain nothing and match nothing.  Ids may be null or of any type, and repeat: every row
of either side is a document or an item of its own.

The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text, one after the other, so a larger one takes
more passes over the documents, not more memory of the driver or a task.  Documents are never shuffled.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from . import _vec
from ._spark import forget, written

MASKS = ("110110101101", "111001011011", "101101110011", "110111001101")
SPAN = 12
LEAST = 6
OVERLAP = 13
SUBSTITUTION = -3
TWO_FROM = 16
BLOCK_BYTES = 2 << 20
_FILTER_BITS = 22

_MULT = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(b"\n\r.!?;:")] = True
_IS_TOKEN = np.zeros(256, bool)
_IS_TOKEN[48:58] = _IS_TOKEN[65:91] = _IS_TOKEN[97:123] = _IS_TOKEN[128:] = True


def _folded(texts: _vec.Texts) -> _vec.Texts:
    """The texts with Unicode case folding; A-Z may stay in those that are ASCII."""
    wide = np.concatenate(([0], np.cumsum(texts.buf > 127)))[texts.off]
    if not len(texts) or wide[-1] == wide[0]:
        return texts
    data, off = texts.buf.tobytes(), texts.off.tolist()
    parts = [data[a:b] for a, b in itertools.pairwise(off)]
    for k in np.flatnonzero(np.diff(wide)).tolist():
        parts[k] = parts[k].decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape")
    return _vec.Texts(np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))))


def tokens(texts: _vec.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each token, the token offsets of the texts, and whether a line or sentence begins with the token.

    The last has one entry more, since one may begin behind the last token.
    """
    texts = _folded(texts)
    spaced = _vec.Texts(np.where(_IS_TOKEN[texts.buf], texts.buf, np.uint8(32)), texts.off)
    begins, ends, at = spaced.words()
    breaks = np.concatenate(([0], np.cumsum(_IS_BREAK[texts.buf])))
    opens = np.ones(len(begins) + 1, bool)
    opens[1:-1] = breaks[begins[1:]] > breaks[ends[:-1]]
    opens[at] = True
    return spaced.span_hashes(begins, ends, lower=True), at, opens


def _seed(hashes: np.ndarray, picked: list[int], span: int, salt: int) -> np.ndarray:
    n = max(0, len(hashes) - span + 1)
    out = np.full(n, np.uint64(salt), np.uint64)
    for k in picked:
        out += hashes[k : k + n] * _MULT[k]
    return _vec.mix(out)


def _seeds(hashes: np.ndarray, kinds: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """(span, seeds) of each kind; those of a whole item are one sum less the token that is ignored."""
    whole, summed = 0, hashes
    for span, picked, salt, short in kinds:
        if not short or len(hashes) < span:
            yield span, _seed(hashes, picked, span, salt)
            continue
        n = len(hashes) - span + 1
        if whole != span:
            whole, summed = span, sum(hashes[k : k + n] * _MULT[k] for k in range(span))
        ignored = [hashes[k : k + n] * _MULT[k] for k in set(range(span)) - set(picked)]
        yield span, _vec.mix(summed + np.uint64(salt) - (ignored[0] if ignored else np.uint64(0)))


class Block:
    """The seeds of some benchmark items, sorted, with a bitmap in front."""

    def __init__(self, items: list[tuple]):
        self.items = [i for i, _ in items]
        texts = _vec.strings(pa.array([t for _, t in items], pa.string()))
        hashes, off, _ = tokens(texts)
        self.tokens = [hashes[off[i] : off[i + 1]] for i in range(len(items))]
        short = sorted({len(t) for t in self.tokens if 0 < len(t) <= SPAN})
        #: (span, positions looked at, salt, whether for whole items of just that length)
        self.kinds = [(SPAN, [k for k, c in enumerate(m) if c == "1"], s, False) for s, m in enumerate(MASKS)]
        self.kinds += [(n, [k for k in range(n) if k != j], 100 * n + j, True) for n in short if n >= LEAST for j in range(n)]
        self.kinds += [(n, list(range(n)), 100 * n + 99, True) for n in short if n < LEAST]
        keys, item, at = [], [], []
        for i, own in enumerate(self.tokens):
            for span, picked, salt, whole in self.kinds:
                if len(own) == span if whole else len(own) >= span:
                    seeds = _seed(own, picked, span, salt)
                    keys.append(seeds)
                    item.append(np.full(len(seeds), i, np.int32))
                    at.append(np.arange(len(seeds), dtype=np.int32))
        self.keys, self.item, self.at = (np.concatenate(x) if x else np.zeros(0, d) for x, d in ((keys, np.uint64), (item, np.int32), (at, np.int32)))
        by = np.argsort(self.keys, kind="stable")
        self.keys, self.item, self.at = self.keys[by], self.item[by], self.at[by]
        self.bitmap = np.zeros(1 << _FILTER_BITS, bool)
        self.bitmap[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, hashes: np.ndarray, off: np.ndarray, opens: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, token of the text at which the item would begin), once each."""
        out: set[tuple[int, int, int]] = set()
        for span, seeds in _seeds(hashes, self.kinds):
            some = np.flatnonzero(self.bitmap[seeds >> np.uint64(64 - _FILTER_BITS)])
            text = np.searchsorted(off, some, "right") - 1
            within = some + span <= off[text + 1]
            if span < LEAST:
                within[within] = opens[some[within]] & opens[some[within] + span]
            some, text = some[within], text[within]
            a, b = np.searchsorted(self.keys, seeds[some]), np.searchsorted(self.keys, seeds[some], "right")
            which = _vec.gather(a, b - a)
            out.update(zip(np.repeat(text, b - a).tolist(), self.item[which].tolist(), (np.repeat(some, b - a) - self.at[which]).tolist(), strict=True))
        return out

    def overlap(self, own: np.ndarray, item: int, begin: int) -> tuple[int, int, int]:
        """(first token, tokens, substitutions) of the best run, if it is long enough, or of the whole item; else no tokens."""
        other = self.tokens[item]
        a, b = max(0, -begin), min(len(other), len(own) - begin)
        same = own[begin + a : begin + b] == other[a:b]
        sums = np.concatenate(([0], np.cumsum(np.where(same, 1, SUBSTITUTION))))
        low = np.minimum.accumulate(sums)
        end = int(np.argmax(sums - low))
        first = int(np.argmin(sums[: end + 1]))
        length, wrong = end - first, int((~same[first:end]).sum())
        if length >= min(OVERLAP, len(other)):
            return begin + a + first, length, wrong
        if len(same) == len(other) >= LEAST and (wrong := int((~same).sum())) <= 1 + (len(other) >= TWO_FROM):
            return begin, len(other), wrong
        return 0, 0, 0


def _found(block: Block, column: pa.Array) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text, item) to (tokens that match, first token negated, tokens) of the best run of each pair that overlaps."""
    best: dict[tuple, tuple[int, int, int]] = {}
    for a, _, texts in _vec.slices(_vec.strings(column)):
        hashes, off, opens = tokens(texts)
        for text, item, begin in block.hits(hashes, off, opens):
            first, length, wrong = block.overlap(hashes[off[text] : off[text + 1]], item, int(begin - off[text]))
            if length:
                key = (a + text, item)
                best[key] = max(best.get(key, (0, 0, 0)), (length - wrong, -first, length))
    return best


def _scan(block: Block, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = sorted(_found(block, batch.column(1)).items())
            ids = batch.column(0).take(pa.array([i for (i, _), _ in best], pa.int64()))
            items = pa.array([block.items[j] for (_, j), _ in best], kind)
            numbers = [[x[k] for _, x in best] for k in range(3)]
            rest = ([-f for f in numbers[1]], numbers[2], [n - r for r, _, n in zip(*numbers, strict=True)])
            yield pa.RecordBatch.from_arrays([ids, items, *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "item_id", "token", "n_tokens", "n_substituted"])

    return run


def _without(block: Block, at: int):
    """The rows whose text, in column ``at``, overlaps no item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[i for i, _ in _found(block, batch.column(at))]] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[Block, bool]]:
    """Each block of the benchmark, and whether it is the last; only one is in memory."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        yield Block(sorted(((r.item_id, r.text) for r in own), key=lambda r: (r[1], str(r[0])))), k == blocks - 1


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and benchmark item that overlap: the longest run of the pair.

    doc_id, item_id, token (its first in the document), n_tokens, n_substituted.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = docs.select(F.col(id_col).alias("doc_id")), benchmark.select(F.col(item_col).alias("item_id"))
    schema = StructType([*ids[0].schema.fields, *ids[1].schema.fields, *(StructField(c, LongType()) for c in ("token", "n_tokens", "n_substituted"))])
    kind = to_arrow_type(schema["item_id"].dataType)
    found: DataFrame | None = None
    for block, last in _blocks(benchmark, item_col, item_text_col):
        own = rows.mapInArrow(_vec.tidy(_scan(block, kind)), schema)
        own = own if last else written(own)
        found = own if found is None else found.unionAll(own)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, all columns, that overlap no benchmark item.  Of a benchmark of several blocks each but the last writes what it keeps."""
    at, before = docs.columns.index(text_col), None
    for block, last in _blocks(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(_vec.tidy(_without(block, at)), docs.schema)
        if not last:
            docs = written(docs)
            forget(*filter(None, [before]))
            before = docs
    return docs
