"""Lexical retrieval packing of documents into token sequences.

1. Each document becomes its token ids, which are written once.  A term is a pre-token, the ids up to one that ends a
   word (each id, if the vocabulary doesn't mark ends), by 32 bits of a hash.
2. The number of documents that have a term is counted over the whole corpus, in ``1 << SLOTS`` slots of
   hashes (rare terms of a very large corpus share slots), and so is the mean length.
3. Documents are dealt by content: first by the frequent term that says most about them, then by the two
   first terms of a draw weighted towards rare ones, which documents draw alike the more they share.  The order is cut into shards of
   about ``SHARD_BYTES`` of text, at bounds taken from a sample of ``SAMPLE`` documents a shard, chosen by a hash.
4. Each shard has a BM25 inverted index, with the corpus's statistics.  A sequence starts with a seed document;
   the index returns the unused documents nearest to it, best first, and they fill the window greedily.
   The document that does not fit is cut there, and what is left of it is the next seed.  Windows are
   full, therefore; the last one of a shard is split into powers of two, so that there is no padding at all.

A document is its token ids and then ``end_id``; a null text is empty and yields ``end_id`` alone.  Rows may share
a doc_id, or have none: each is a document.  Of equal scores the document that comes first in the order is taken.
Memory is bounded by a shard and the word cache; a document larger than a shard is one by itself.  Copies are
dealt by doc_id, so a large group of them falls into many shards.  Shards depend on the documents, not on their
partitions, and number their sequences themselves, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import functools
import math
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec
from ._spark import written

WINDOW = 4096
SHARD_BYTES = 8 << 20
K1, B = 1.2, 0.75
#: Words that a worker's cache of token ids may hold before it starts anew.
CACHE_WORDS = 2_400_000
#: Bits of a term's hash by which documents that have it are counted.
SLOTS = 20
#: Documents a shard that are drawn to find the shards' bounds.
SAMPLE = 64
#: Partitions of the exchange, at most; a task takes one shard after the other.
PARTS = 32_768
#: A term of this share of all documents or more is frequent.
FREQUENT = 0.02


def _distinct(texts: _vec.Texts) -> tuple[np.ndarray, ...]:
    """(begins, ends, hashes of the words, word offsets of the texts, an index for each distinct word, which of them each word is)."""
    begins, ends, at = texts.words()
    hashes = texts.span_hashes(begins, ends)
    _, where, which = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = ends - begins
    lead = where[which]
    blocks = _vec.blocks(texts.buf)
    if not ((sizes == sizes[lead]).all() and _vec.same(blocks, begins, blocks, begins[lead], sizes).all()):
        # Two words of one hash: by their bytes.
        data, seen = texts.buf.tobytes(), {}
        which = np.array([seen.setdefault(data[x:y], len(seen)) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)])
        _, where = np.unique(which, return_index=True)
    return begins, ends, hashes, at, where, which


class WordIds:
    """Token ids of words, from a cache by word hash; a word whose bytes differ from the cached one's is no hit.

    Holds for tokenizers that split at white space before anything else and drop it, so that
    a text's ids are those of its words, one after the other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: What the vocabulary puts at the end of a pre-token's last piece.
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if self.suffix and w.endswith(self.suffix)]] = True
        self.clear()

    def clear(self) -> None:
        #: (hashes, first id, number of ids, first byte, number of bytes) of words, by hash
        self.runs = [tuple(np.zeros(0, kind) for kind in (np.uint64, *[np.uint32] * 4))]
        self.flat, self.bytes = _vec.Growing(np.uint32), _vec.Growing(np.uint8)

    def places(self, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and number of the ids of distinct words in ``ids``."""
        if sum(len(r[0]) for r in self.runs) > CACHE_WORDS:
            self.clear()
        begin, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        sizes = ends - begins
        at_byte = np.zeros(len(hashes), np.int64)
        for keys, first, number, byte, n_bytes in self.runs:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = (keys[at] == hashes) & (n_bytes[at] == sizes)
                begin[hit], count[hit], at_byte[hit] = first[at[hit]], number[at[hit]], byte[at[hit]]
        hit = np.flatnonzero(begin >= 0)
        begin[hit[~_vec.same(_vec.blocks(buf), begins[hit], self.bytes.blocks(), at_byte[hit], sizes[hit])]] = -1
        new = np.flatnonzero(begin < 0)
        if len(new):
            data = buf.tobytes()
            ids, number = self._encode([data[a:b].decode() for a, b in zip(begins[new].tolist(), ends[new].tolist(), strict=True)])
            first = self.flat.size + np.concatenate(([0], np.cumsum(number)[:-1]))
            byte = self.bytes.size + np.concatenate(([0], np.cumsum(sizes[new])[:-1]))
            self.flat.add(ids)
            self.bytes.add(buf[_vec.gather(begins[new], sizes[new])])
            begin[new], count[new] = first, number
            by = np.argsort(hashes[new], kind="stable")
            self.runs.append((hashes[new][by], *(x[by].astype(np.uint32) for x in (first, number, byte, sizes[new]))))
            while len(self.runs) > 1 and len(self.runs[-1][0]) * 2 > len(self.runs[-2][0]):
                last, before = self.runs.pop(), self.runs.pop()
                merged = [np.concatenate(x) for x in zip(before, last, strict=True)]
                by = np.argsort(merged[0], kind="stable")
                self.runs.append(tuple(x[by] for x in merged))
        return begin, count

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after the other, and how many each has.

        Plain words go to the tokenizer many at a time: letters make one of its pre-tokens, a
        mark after them another, and each pre-token's last id shows its end.  A group in which
        the ends don't add up, and every other word, goes there on its own.
        """
        parts = np.array([1 if w.isalpha() else 2 if w[-1] in ".,;:!?" and w[:-1].isalpha() else 0 for w in words], np.int64) * bool(self.suffix)
        alone = np.flatnonzero(parts == 0).tolist()
        plain = np.flatnonzero(parts)
        found, which, sizes = [], [], []
        for a in range(0, len(plain), 1000):
            group = plain[a : a + 1000]
            (own,) = self.tokenizer.encode_batch_fast([" ".join([words[k] for k in group])], add_special_tokens=False)
            own = np.array(own.ids, np.uint32)
            ends = np.flatnonzero(self.ends[own]) + 1
            if len(ends) != parts[group].sum() or not len(ends) or ends[-1] != len(own):
                alone += group.tolist()
                continue
            found.append(own)
            which.append(group)
            sizes.append(np.diff(ends[np.cumsum(parts[group]) - 1], prepend=0))
        for own in self.tokenizer.encode_batch_fast([words[k] for k in alone], add_special_tokens=False):
            found.append(np.array(own.ids, np.uint32))
            sizes.append(np.array([len(own.ids)]))
        which = np.concatenate([*which, np.array(alone, np.int64)])
        sizes = np.concatenate(sizes)
        back = np.argsort(which)
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return np.concatenate(found)[_vec.gather(begin[back], sizes[back])], sizes[back]

    @property
    def ids(self) -> np.ndarray:
        return self.flat.room


@functools.lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    """The cache of a Python worker, which runs many tasks."""
    return WordIds(path)


def _read(path: str, end_id: int, kind: str):
    """(doc_id, tie, text) to (doc_id, tie, ids, n_bytes); ids are numbers of this kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path)
        for batch in batches:
            for a, b, texts in _vec.slices(_vec.strings(batch.column(2))):
                begins, ends, hashes, at, where, which = _distinct(texts)
                first, number = words.places(hashes[where], begins[where], ends[where], texts.buf)
                count = number[which]
                tokens = words.ids[_vec.gather(first[which], count)]
                off = np.concatenate(([0], np.cumsum(count)))[at]
                size = np.diff(off) + 1
                ids = np.full(int(size.sum()), end_id, kind)
                ids[np.arange(len(tokens)) + np.repeat(np.arange(len(size)), size - 1)] = tokens
                off = np.concatenate(([0], np.cumsum(size))) * ids.itemsize
                column = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (0, 1)), column, pa.array(np.diff(texts.off))], ["doc_id", "tie", "ids", "n_bytes"])

    return run


_RNG = np.random.Generator(np.random.PCG64(31))
_BY_ID = _RNG.integers(0, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BY_PLACE = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Vocabulary:
    """How ids are written, and which of them end a word."""

    kind: str
    ends: np.ndarray

    @staticmethod
    def of(path: str, end_id: int) -> Vocabulary:
        words = WordIds(path)
        return Vocabulary("<u2" if max(len(words.ends), end_id + 1) <= 1 << 16 else "<u4", words.ends if words.suffix else np.ones(len(words.ends), bool))

    def terms(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, count) of each term of the documents, in order, and how many terms each document has in all."""
        last = self.ends[np.minimum(ids, len(self.ends) - 1)]
        last[off[1:] - 1] = True  # the end of the document, and what stands before it
        last[np.maximum(off[1:] - 2, off[:-1])] = True
        ends = np.flatnonzero(last) + 1
        starts = np.concatenate(([0], ends[:-1]))
        place = np.arange(len(ids)) - np.repeat(starts, ends - starts)
        by_id = _BY_ID[ids & 0xFFFF] + (ids >> 16 if ids.itemsize > 2 else np.uint64(0))
        hashes = _vec.mix(np.add.reduceat(by_id * _BY_PLACE[np.minimum(place, 63)] + (place > 63) * place.astype(np.uint64), starts)) if len(ids) else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(ends, off, "right")))
        real = starts < off[doc + 1] - 1
        pair, count = np.unique(doc[real].astype(np.uint64) << np.uint64(32) | hashes[real] >> np.uint64(32), return_counts=True)
        return (pair >> np.uint64(32)).astype(np.int64), pair.astype(np.uint32), count, np.bincount(doc[real], minlength=len(off) - 1)


def _slices(vocabulary: Vocabulary, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last + 1, ids, offsets) of runs of rows."""
    for a, b, texts in _vec.slices(_vec.strings(batch.column("ids"))):
        ids = np.frombuffer(texts.buf, vocabulary.kind)
        yield a, b, ids, texts.off // ids.itemsize


def _slot(terms: np.ndarray) -> np.ndarray:
    return terms >> np.uint32(32 - SLOTS)


def _count(vocabulary: Vocabulary):
    """How many documents of a task have terms of each slot; as -1 all terms, as -2 all documents, as -3 all bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The ids are written; a worker that goes on to other steps needs no words for them.
        _word_ids.cache_clear()
        total, rest = np.zeros(1 << SLOTS, np.int64), np.zeros(3, np.int64)
        for batch in batches:
            for a, b, ids, off in _slices(vocabulary, batch):
                _, terms, _, length = vocabulary.terms(ids, off)
                total += np.bincount(_slot(terms), minlength=len(total))
                rest += (length.sum(), b - a, 0)
            rest[2] += batch.column("n_bytes").to_numpy().sum()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1, -2, -3], some)).astype(np.int32)), pa.array(np.concatenate((rest, total[some])))], ["slot", "n"])

    return run


@dataclass
class Corpus:
    """Statistics of all documents."""

    n: int
    n_bytes: int
    mean_terms: float
    idf: np.ndarray  # of each slot; none is below zero

    @staticmethod
    def of(slots: np.ndarray, counts: np.ndarray) -> Corpus:
        df, rest = np.zeros(1 << SLOTS, np.int64), dict(zip(slots[slots < 0].tolist(), counts[slots < 0].tolist(), strict=True))
        df[slots[slots >= 0]] = counts[slots >= 0]
        n = rest.get(-2, 0)
        # A term of half of all documents or more has no weight that tells them apart.
        idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0) if n else df
        return Corpus(n, rest.get(-3, 0), max(1.0, rest.get(-1, 0) / max(n, 1)), idf.astype(np.float32))


def _keys(corpus: Corpus, doc: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Where documents stand in the order: 15 bits of a frequent term, 24 each of two drawn ones."""
    out = np.zeros(n, np.int64)
    if not len(doc):
        return out
    idf = corpus.idf[_slot(terms)]
    full, begin, row = np.unique(doc, return_index=True, return_inverse=True)

    def first(score: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the term with the smallest score in each document, and where it is; 0 if that is infinite."""
        least = np.minimum.reduceat(score, begin)
        at = np.flatnonzero((score == least[row]) & np.isfinite(score))
        _, lead = np.unique(row[at], return_index=True)
        at = at[lead]
        found = np.zeros(len(full), np.int64)
        found[row[at]] = (_vec.mix(terms[at].astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
        return found, at

    frequent = idf <= np.log((1 - FREQUENT) / FREQUENT)
    coarse, _ = first(np.where(frequent & (idf > 0), -idf * counts, np.inf), 15)
    draw = (_vec.mix(terms.astype(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    with np.errstate(divide="ignore"):
        score = np.where(idf > 0, -np.log(draw + 1e-18) / np.maximum(idf, 1e-6).astype(np.float64) ** 2, np.inf)
    one, at = first(score, 24)
    score[at] = np.inf
    two, _ = first(score, 24)
    out[full] = coarse << 48 | one << 24 | two
    return out


def _place(corpus: Corpus, vocabulary: Vocabulary):
    """(tie, ids, ...) to the same with the key in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_keys(corpus, *vocabulary.terms(ids, off)[:3], b - a) for a, b, ids, off in _slices(vocabulary, batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), *batch.columns], ["key", *batch.schema.names])

    return run


class Shard:
    """Documents with their ids and an inverted index."""

    def __init__(self, batches: list[pa.RecordBatch], corpus: Corpus, vocabulary: Vocabulary):
        self.doc_ids = [i for b in batches for i in b.column("doc_id").to_pylist()]
        ids, sizes, weights, n = [], [], [], 0
        # A slice at a time: finding terms takes tens of bytes for each byte of ids.
        for batch in batches:
            for a, b, own, off in _slices(vocabulary, batch):
                ids.append(own)
                sizes.append(np.diff(off))
                doc, terms, weight = self._weights(*vocabulary.terms(own, off), corpus)
                weights.append((doc + np.int32(n), terms, weight))
                n += b - a
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        self.off = np.concatenate(([0], np.cumsum(self.sizes)))
        doc, terms, weight = (np.concatenate(x) for x in zip(*weights, strict=True))
        del ids, weights
        self._index(doc, terms, weight)

    @staticmethod
    def _weights(doc: np.ndarray, terms: np.ndarray, tf: np.ndarray, length: np.ndarray, corpus: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, BM25 weight) of the terms that have one."""
        idf = corpus.idf[_slot(terms)]
        keep = idf > 0
        terms, tf, doc, idf = terms[keep], tf[keep].astype(np.float32), doc[keep], idf[keep]
        norm = (K1 * (1 - B + B * length / corpus.mean_terms)).astype(np.float32)
        return doc.astype(np.int32), terms, idf * tf * np.float32(K1 + 1) / (tf + norm[doc])

    def _index(self, doc: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> None:
        n = len(self.doc_ids)
        distinct, term, df = np.unique(terms, return_inverse=True, return_counts=True)
        # Terms that only one document has find no neighbour.
        keep = df[term] > 1
        doc, term, weight = doc[keep], term[keep].astype(np.int32), weight[keep]
        self.doc_terms, self.doc_off = term, np.searchsorted(doc, np.arange(n + 1))
        by = np.argsort(self.doc_terms, kind="stable")
        self.post_doc, self.post_weight = doc[by], weight[by]
        self.post_off = np.searchsorted(self.doc_terms[by], np.arange(len(distinct) + 1))
        # Terms of many of the shard's documents have a row of weights each instead.
        size = np.diff(self.post_off)
        frequent = np.flatnonzero(size * 8 > n)
        self.row = np.full(len(distinct), -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), n), np.float32)
        at = _vec.gather(self.post_off[frequent], size[frequent])
        self.rows[np.repeat(np.arange(len(frequent)), size[frequent]), self.post_doc[at]] = self.post_weight[at]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents against all terms of the seed."""
        own = self.doc_terms[self.doc_off[seed] : self.doc_off[seed + 1]]
        row = self.row[own]
        rare = own[row < 0]
        at = _vec.gather(self.post_off[rare], self.post_off[rare + 1] - self.post_off[rare])
        score = np.bincount(self.post_doc[at], self.post_weight[at], minlength=len(self.doc_ids))
        chosen = np.zeros(len(self.rows), np.float32)
        chosen[row[row >= 0]] = 1
        return score + chosen @ self.rows if len(self.rows) else score

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents by BM25 against all terms of the seed, best first, then the others in order."""
        score = self.scores(seed)
        score[used] = -1.0
        top = min(32, len(score))
        best = np.argpartition(-score, top - 1)[:top]
        # Ties with the last of them are settled by order among all.
        if (score >= score[best].min()).sum() > top:
            best = np.flatnonzero(score >= score[best].min())
        best = best[np.lexsort((best, -score[best]))]
        yield from (int(i) for i in best if score[i] >= 0)
        seen = set(best.tolist())
        yield from (int(i) for i in np.argsort(-score, kind="stable") if score[i] >= 0 and int(i) not in seen)

    def pack(self, window: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, start, length, sequence, offset) of each piece."""
        used = np.zeros(len(self.doc_ids), bool)
        placed, carried, sequence, cursor = 0, None, 0, 0
        while carried is not None or placed < len(used):
            room, held = window, []
            if carried is None:
                while used[cursor]:
                    cursor += 1
                seed, start = cursor, 0
                used[seed] = True
                placed += 1
            else:
                seed, start = carried
            carried = None
            queue = None
            doc = seed
            while True:
                size = min(room, int(self.sizes[doc]) - start)
                held.append((doc, start, size))
                room -= size
                if start + size < self.sizes[doc]:
                    carried = (doc, start + size)
                if not room or placed == len(used):
                    break
                queue = queue or self.neighbours(seed, used)
                doc, start = next(queue), 0
                used[doc] = True
                placed += 1
            # A window that stays short is split into powers of two.
            left = window - room
            limits = [window] if not room else [1 << k for k in reversed(range(left.bit_length())) if left >> k & 1]
            offset = 0
            for doc, start, size in held:
                while size:
                    now = min(size, limits[0] - offset)
                    yield doc, start, now, sequence, offset
                    start, size, offset = start + now, size - now, offset + now
                    if offset == limits[0]:
                        limits.pop(0)
                        offset = 0
                        sequence += 1


_COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack(corpus: Corpus, vocabulary: Vocabulary, window: int, shard_bytes: int, with_ids: bool):
    """Rows (part, doc_id, ids, n_bytes), in order, to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = 0

        def out(part: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal sequences
            shard = Shard(held, corpus, vocabulary)
            rows, tokens = [], []
            for doc, start, length, sequence, offset in shard.pack(window):
                ids = shard.ids[shard.off[doc] + start : shard.off[doc] + start + length].astype("<u4")
                rows.append((shard.doc_ids[doc], start, length, zlib.crc32(ids.tobytes()), int(shard.sizes[doc]), (part << 32) + sequences + sequence, offset))
                if with_ids:
                    tokens.append(ids.astype(np.int32))
            sequences += sequence + 1
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], held[0].column("doc_id").type), *(pa.array(c, pa.int64()) for c in columns[1:])]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(tokens, pa.list_(pa.int32()))] * with_ids, ["doc_id", *_COLUMNS] + ["ids"] * with_ids)

        held, size, part = [], 0, -1
        for batch in batches:
            parts, sizes = batch.column("part").to_numpy(), batch.column("n_bytes").to_numpy()
            a = 0
            while a < batch.num_rows:
                if held and (parts[a] != part or size >= shard_bytes):
                    yield from out(part, held)
                    sequences = sequences if parts[a] == part else 0
                    held, size = [], 0
                part = int(parts[a])
                b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), shard_bytes - size)) + 1)
                b = min(b, a + int(np.searchsorted(parts[a:], part, "right")))
                held.append(batch.slice(a, b - a))
                size += int(sizes[a:b].sum())
                a = b
        if held:
            yield from out(part, held)

    return run


def _bounds(read: DataFrame, corpus: Corpus, vocabulary: Vocabulary, shards: int) -> list[tuple[int, int]]:
    """Where the shards begin in the order of (key, tie), from a sample of documents, weighted by their bytes."""
    share = min(1.0, shards * SAMPLE / max(corpus.n, 1))
    drawn = read.where(F.pmod(F.xxhash64("tie", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("tie", "ids", "n_bytes")
    rows = drawn.mapInArrow(_vec.tidy(_place(corpus, vocabulary)), "key long, tie long, ids binary, n_bytes long").select("key", "tie", "n_bytes").toArrow()
    key, tie, size = (rows.column(c).to_numpy() for c in ("key", "tie", "n_bytes"))
    by = np.lexsort((size, tie, key))
    total = np.cumsum(size[by] + 1)
    at = np.unique(np.searchsorted(total, total[-1] * np.arange(1, shards) / shards)) if len(by) else np.zeros(0, np.int64)
    return sorted({(int(key[i]), int(tie[i])) for i in by[at]})


def _part(bounds: list[tuple[int, int]]):
    keys, ties = (np.array([b[k] for b in bounds], np.int64) for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tie = batch.column("key").to_numpy(), batch.column("tie").to_numpy()
            a, b = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            part = a.copy()
            for k in np.flatnonzero(a < b):
                part[k] += np.searchsorted(ties[a[k] : b[k]], tie[k], "right")
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), *batch.columns], ["part", *batch.schema.names])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
    kind = docs.schema[id_col].dataType.simpleString()
    # What parts documents of one key, copies above all: the doc_id, or without one the row.
    row = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col, row).alias("tie"), F.col(text_col).alias("text"))
    vocabulary = Vocabulary.of(tokenizer, end_id)
    columns = f"doc_id {kind}, tie long, ids binary, n_bytes long"
    read = written(rows.mapInArrow(_vec.tidy(_read(tokenizer, end_id, vocabulary.kind)), columns))
    slots = read.select("ids", "n_bytes").mapInArrow(_vec.tidy(_count(vocabulary)), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    corpus = Corpus.of(slots.column("slot").to_numpy(), slots.column("n").to_numpy())
    shards = max(1, math.ceil(corpus.n_bytes / shard_bytes))
    place, part = _place(corpus, vocabulary), _part(_bounds(read, corpus, vocabulary, shards))
    # One function, so that a task has one Python worker.
    placed = read.mapInArrow(_vec.tidy(lambda batches: part(place(batches))), f"part long, key long, {columns}")
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(max(least, min(shards, PARTS)), "part").sortWithinPartitions("part", "key", "tie", "n_bytes")
    ddl = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _COLUMNS) + (", ids array<int>" if with_ids else "")
    # A part that is larger than the sample told is cut at twice a shard.
    return dealt.mapInArrow(_vec.tidy(_pack(corpus, vocabulary, window, 2 * shard_bytes, with_ids)), ddl)
