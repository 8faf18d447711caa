"""Exact removal of repeated byte strings by suffix sorting.

A byte of a document goes if a ``LENGTH``-byte string that covers it also starts in a document
with a smaller doc_id.  Strings are judged on the input; overlaps count; matches never cross
documents.  Null texts are empty, and texts of under ``LENGTH`` bytes lose nothing.  A document
whose doc_id is null loses nothing, and others lose nothing to it.  Rows that share a doc_id are documents
of their own: none is smaller than the other, so they lose nothing to each other, and each loses its own repeats only.

Only suffixes that can have a partner are sorted.  Of each window of ``LENGTH`` bytes, the
``GRAM``-byte gram with the smallest hash is its anchor, so equal windows have equal anchors.

1. Anchors that occur in two documents or more are found by their hashes.  Each flush of
   documents sends one record for a hash, and knows already that those it has seen in two
   documents are shared, so a passage in a third of all documents costs a record a flush.
2. For each shared anchor, its context (every window that it can stand for) goes to the task
   of its hash.  Equal contexts of a flush are merged, with the smallest doc_id.
3. There the windows are deep-shallow sorted: multikey quicksort on characters of eight bytes
   to depth ``SHALLOW``, then blind tries order the groups that still share a prefix.  Equal
   windows end up together, and all but those of the smallest document are marked.

Documents are dealt once by doc_id; the three steps that read texts reuse that exchange.
Exact copies of a whole text are marked by their digest and take no part in the sort.

Anchors and contexts fall into buckets of which a task has one in memory at a time; the JVM sorts its rows by bucket.
The number of partitions is bounded whatever the input's.  A flush sends a record for a bucket, for ``GROUPS`` groups
of buckets if there are more, which a second exchange then splits, so that records stay large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec
from ._spark import partitions, written

LENGTH, GRAM = 50, 20
#: Grams in a window.
SPAN = LENGTH - GRAM + 1
#: Bytes around an anchor that its windows can cover.
CONTEXT = 2 * (LENGTH - GRAM) + GRAM
#: Bytes that multikey quicksort looks at before the blind tries take over.
SHALLOW = 32
#: Bytes of text after which a task emits what it has gathered.
FLUSH = 8 << 20
#: Windows that are sorted at once.
SORT_AT_ONCE = 400_000
#: Bytes of an anchor's hash that are sent.
HASH_BYTES = 5
#: Partitions of an exchange, and groups of buckets, at most.
PARTS, GROUPS = 8192, 4096
#: Bytes of records that are split again at once.
RESPLIT = 32 << 20
#: Bits of a position; those above hold the tag of the row, which tells rows of one doc_id apart.
PLACE_BITS = 32
_PLACE = (1 << PLACE_BITS) - 1


class BlindTrie:
    """Orders strings of one length; inner nodes hold only the position at which their strings part."""

    __slots__ = ("strings", "root")

    def __init__(self, string: bytes, member: int):
        self.strings = {string: [member]}
        self.root: bytes | list = string

    def insert(self, string: bytes, member: int) -> None:
        # Blind descent: only the parting bytes are looked at.
        node = self.root
        while isinstance(node, list):
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        if node == string:
            self.strings[string].append(member)
            return
        # The leaf shows how far the string agrees; the new branch belongs there.
        size = len(string)
        differing = int.from_bytes(node, "big") ^ int.from_bytes(string, "big")
        at = size - (differing.bit_length() + 7) // 8
        self.strings[string] = [member]
        parent, key, below = None, None, self.root
        while isinstance(below, list) and below[0] < at:
            parent, key, below = below, string[below[0]], below[1][string[below[0]]]
        if isinstance(below, list) and below[0] == at:
            below[1][string[at]] = string
            return
        branch = [at, {node[at]: below, string[at]: string}]
        if parent is None:
            self.root = branch
        else:
            parent[1][key] = branch

    def ordered(self) -> Iterator[list[int]]:
        """The members of each distinct string, strings in order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield self.strings[node]


def _characters(rows: np.ndarray, row: np.ndarray, at: np.ndarray, size: int = 8) -> np.ndarray:
    """``size`` bytes from column ``at`` of each ``row``, as a big-endian number."""
    flat = rows.reshape(-1)
    base = row * rows.shape[1] + at
    out = np.zeros(len(row), np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | flat[base + k]
    return out


def deep_shallow(rows: np.ndarray, row: np.ndarray, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sort the strings rows[row, at : at + length] within their groups.

    Returns the order and, for each place of it, the number of its class of equal strings.
    """
    order = np.argsort(group, kind="stable")
    rank = group[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = rank[1:] != rank[:-1]
    depth = 0
    # Multikey quicksort: all groups by their next character; equal ones go on to the one after.
    while depth < min(SHALLOW, length):
        first = np.flatnonzero(fresh)
        many = np.diff(np.append(first, len(order))) > 1
        places = _vec.gather(first[many], np.diff(np.append(first, len(order)))[many])
        if not len(places):
            break
        own = order[places]
        size = min(8, length - depth)
        key = _characters(rows, row[own], at[own] + depth, size)
        number = np.cumsum(fresh)[places]
        by = np.lexsort((key, number))
        order[places] = own[by]
        key, number = key[by], number[by]
        fresh[places[1:]] |= (key[1:] != key[:-1]) | (number[1:] != number[:-1])
        depth += size
    if depth < length:
        # Blind tries: every trie starts with the first string of its group.  Those equal to it
        # join its leaf in one step; only groups with other strings need insertions.
        first = np.flatnonzero(fresh)
        sizes = np.diff(np.append(first, len(order)))
        many = sizes > 1
        places = _vec.gather(first[many], sizes[many])
        leaf = np.repeat(first[many], sizes[many])
        own, lead = order[places], order[leaf]
        same = np.ones(len(places), bool)
        for d in range(depth, length, 8):
            size = min(8, length - d)
            same &= _characters(rows, row[own], at[own] + d, size) == _characters(rows, row[lead], at[lead] + d, size)
        for a in np.unique(leaf[~same]):
            b = a + int(sizes[np.searchsorted(first, a)])
            members = order[a:b]
            tails = [rows[row[m], at[m] + depth : at[m] + length].tobytes() for m in members]
            trie = BlindTrie(tails[0], members[0])
            for m, tail in zip(members[1:], tails[1:], strict=True):
                trie.insert(tail, m)
            place = a
            for equal in trie.ordered():
                order[place : place + len(equal)] = equal
                fresh[place] = True
                fresh[place + 1 : place + len(equal)] = False
                place += len(equal)
    return order, np.cumsum(fresh) - 1


def _sliding(op, values: np.ndarray, width: int) -> np.ndarray:
    """op over each run of ``width`` values, by doubling."""
    have = 1
    while 2 * have <= width:
        values = op(values[:-have], values[have:])
        have *= 2
    if have < width:
        values = op(values[: len(values) - (width - have)], values[width - have :])
    return values


_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def anchors(texts: _vec.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, smallest hash of each window, positions of the anchors, their texts).

    Windows that no text holds whole have the hash ``_NONE``.
    """
    hashes = texts.grams(GRAM)
    if len(texts.buf) < LENGTH:
        none = np.zeros(0, np.int64)
        return hashes, np.zeros(0, np.uint64), none, none
    hashes &= ~np.uint64(1)
    least = _sliding(np.minimum, hashes, SPAN)
    for a, b in zip(texts.off[:-1], texts.off[1:], strict=True):
        least[max(a, b - LENGTH + 1) : b] = _NONE
    real = least != _NONE
    most = np.where(real, least, np.uint64(0))
    padded = np.concatenate((np.zeros(SPAN - 1, np.uint64), most, np.zeros(len(hashes) - len(least), np.uint64)))
    chosen = np.flatnonzero(_sliding(np.maximum, padded, SPAN)[: len(hashes)] == hashes)
    return hashes, least, chosen, np.searchsorted(texts.off, chosen, "right") - 1


def _windows(hashes: np.ndarray, least: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last window, as bytes before the anchor, for which each anchor stands (it has some)."""
    low, high = np.full(len(at), -1, np.int64), np.full(len(at), -1, np.int64)
    for back in range(SPAN):
        j = at - back
        fits = (j >= 0) & (j < len(least))
        fits[fits] = least[j[fits]] == hashes[at[fits]]
        low[fits] = back
        high[fits & (high < 0)] = back
    return low, high


_FLOW = pa.schema([("bucket", pa.int32()), ("dest", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_FLOW_DDL = "bucket int, dest int, a binary, b binary, c binary, d binary"


def _flow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FLOW)], schema=_FLOW)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Offsets of the runs of equal keys, with the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]))


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[np.ndarray, _vec.Texts, pa.RecordBatch]]]:
    """(doc_ids, texts, rows) slices, in groups of about FLUSH bytes."""
    held, size = [], 0
    for batch in batches:
        if batch.column(0).null_count:
            batch = batch.filter(batch.column(0).is_valid())
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, texts in _vec.slices(_vec.strings(batch.column(1))):
            held.append((ids[a:b], texts, batch.slice(a, b - a)))
            size += len(texts.buf)
            if size >= FLUSH:
                yield held
                held, size = [], 0
    if held:
        yield held


def _emit_anchors(buckets: int, groups: int, dests: int, width: int):
    """Documents to anchor records by group of buckets, and by destination the hashes known to be shared."""

    def run(batches):
        for held in _flushes(batches):
            all_hashes, all_docs = [], []
            for ids, texts, _ in held:
                hashes, _, at, text = anchors(texts)
                all_hashes.append(hashes[at])
                all_docs.append(ids[text])
            h, d = np.concatenate(all_hashes), np.concatenate(all_docs)
            by = np.lexsort((d, h))
            h, d = h[by], d[by]
            own = np.ones(len(h), bool)
            own[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d = h[own], d[own]
            runs = _runs(h)
            sizes = np.diff(runs)
            known = np.repeat(sizes > 1, sizes)
            rows = _destinations(d[known], dests, _narrow(h[known]))
            # One record for each hash, and its document; those that this flush has answered come last, without.
            first = runs[:-1]
            rows += _anchor_rows(_bucket(h[first], buckets) % groups, h[first], d[first], sizes > 1, width)
            if rows:
                yield _flow(rows)

    return run


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _anchor_rows(bucket: np.ndarray, h: np.ndarray, d: np.ndarray, answered: np.ndarray, width: int) -> list[tuple]:
    by = np.lexsort((d, answered, bucket))
    h, d, answered, bucket = h[by], d[by], answered[by], bucket[by]
    rows = []
    cut = _runs(bucket)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own = d[a:b][~answered[a:b]]
        docs = _runs(own) if len(own) else np.zeros(1, np.int64)
        rows.append((int(bucket[a]), None, _vec.pack(_narrow(h[a:b], width)), _vec.pack(own[docs[:-1]]), _vec.pack(np.diff(docs).astype(np.uint32)), None))
    return rows


def _anchors_of(rows: list[dict], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, documents, whether they are yet to be answered) of anchor records."""
    hs = [_widen(r["a"], width) for r in rows]
    ds = [np.repeat(np.frombuffer(r["b"], np.int64), np.frombuffer(r["c"], np.uint32)) for r in rows]
    is_open = np.concatenate([np.arange(len(h)) < len(d) for h, d in zip(hs, ds, strict=True)])
    h, d = np.concatenate(hs), np.zeros(len(is_open), np.int64)
    d[is_open] = np.concatenate(ds)
    return h, d, is_open


def _split_anchors(buckets: int):
    def use(rows):
        h, d, is_open = _anchors_of(rows, 8)
        return _anchor_rows(_bucket(h, buckets), h, d, ~is_open, HASH_BYTES)

    return lambda batches: _held_by_bucket(batches, use, RESPLIT)


def _narrow(h: np.ndarray, width: int = HASH_BYTES) -> np.ndarray:
    """The low ``width`` bytes of each hash: with the bucket, enough to tell a task's hashes apart.

    Hashes that agree in them only send a few more contexts to be compared.
    """
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]


def _widen(b: bytes, width: int = HASH_BYTES) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


_LOW = np.uint64((1 << 8 * HASH_BYTES) - 1)


def _destinations(docs: np.ndarray, dests: int, *columns: np.ndarray) -> list[tuple]:
    """Values of documents as rows (dest, documents, their numbers of values, values): one for each destination.

    A row for each document would make documents times buckets of them.
    """
    dest = (_vec.mix(docs.astype(np.uint64)) % np.uint64(dests)).astype(np.int64)
    by = np.lexsort((docs, dest))
    dest, docs, columns = dest[by], docs[by], [c[by] for c in columns]
    rows = []
    cut = _runs(dest)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own = _runs(docs[a:b])
        rows.append((None, int(dest[a]), _vec.pack(docs[a:b][own[:-1]]), _vec.pack(np.diff(own).astype(np.uint32)), *[_vec.pack(c[a:b]) for c in columns], *[None] * (2 - len(columns))))
    return rows


def _to_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of destinations to one row for each document: (doc_id, a, b) with all its values."""
    docs, values, width = [], [[], []], [0, 0]
    for batch in batches:
        for row in batch.to_pylist():
            count = np.frombuffer(row["b"], np.uint32)
            docs.append(np.repeat(np.frombuffer(row["a"], np.int64), count))
            for k, name in enumerate("cd"):
                if row[name] is not None:
                    width[k] = len(row[name]) // int(count.sum())
                    values[k].append(np.frombuffer(row[name], np.uint8).reshape(-1, width[k]))
    if not docs:
        return
    docs = np.concatenate(docs)
    by = np.argsort(docs, kind="stable")
    docs = docs[by]
    columns = [np.concatenate(v)[by] if v else None for v in values]
    cut = _runs(docs)
    for at in range(0, len(cut) - 1, 5000):
        spans = list(zip(cut[at : at + 5000], cut[at + 1 : at + 5001], strict=False))
        arrays = [pa.array([None if c is None else _vec.pack(c[a:b]) for a, b in spans], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([int(docs[a]) for a, _ in spans], pa.int64()), *arrays], ["doc_id", "a", "b"])


def _held_by_bucket(batches, use, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Pass rows that have a destination through; hand the others to ``use``, a bucket at a time, or ``limit`` bytes of it.

    Rows come sorted by bucket.
    """
    held, size = [], 0

    def out():
        rows = use(held)
        for a in range(0, len(rows), 20_000):
            yield _flow(rows[a : a + 20_000])

    for batch in batches:
        done = batch.filter(batch.column(0).is_null())
        if done.num_rows:
            yield done
        for row in batch.filter(batch.column(0).is_valid()).to_pylist():
            if held and (row["bucket"] != held[0]["bucket"] or limit and size > limit):
                yield from out()
                held, size = [], 0
            held.append(row)
            size += sum(len(row[c] or b"") for c in "abcd")
    if held:
        yield from out()


def _shared_anchors(dests: int):
    def use(rows):
        h, d, is_open = _anchors_of(rows, HASH_BYTES)
        by = np.argsort(h, kind="stable")
        h, d, is_open = h[by], d[by], is_open[by]
        sizes = np.diff(_runs(h))
        shared = np.repeat(sizes > 1, sizes) & is_open
        return _destinations(d[shared], dests, _narrow(h[shared]))

    return lambda batches: _held_by_bucket(batches, use)


def _emit_contexts(buckets: int, groups: int, dests: int):
    """Documents with their shared hashes to contexts by group of buckets, and marks that the flush itself shows."""

    def run(batches):
        for held in _flushes(batches):
            hs, docs, poss, lows, highs, ctxs = [], [], [], [], [], []
            for ids, texts, batch in held:
                lists = batch.column(batch.schema.get_field_index("lists")).to_pylist()
                if not any(lists):
                    continue
                hashes, least, at, text = anchors(texts)
                keep = np.zeros(len(at), bool)
                cut = np.searchsorted(text, np.arange(len(texts) + 1))
                small = hashes[at] & _LOW
                for i, packs in enumerate(lists):
                    if packs:
                        keep[cut[i] : cut[i + 1]] = np.isin(small[cut[i] : cut[i + 1]], _widen(packs))
                at, text = at[keep], text[keep]
                if not len(at):
                    continue
                low, high = _windows(hashes, least, at)
                begin, end = texts.off[text], texts.off[text + 1]
                spots = (at - (LENGTH - GRAM))[:, None] + np.arange(CONTEXT)
                inside = (spots >= begin[:, None]) & (spots < end[:, None])
                ctx = np.where(inside, texts.buf[np.clip(spots, 0, len(texts.buf) - 1)], 0).astype(np.uint8)
                hs.append(hashes[at])
                docs.append(ids[text])
                tags = batch.column(batch.schema.get_field_index("tag")).to_numpy(zero_copy_only=False)
                poss.append((at - begin) + (tags[text] << PLACE_BITS))
                lows.append(low)
                highs.append(high)
                ctxs.append(ctx)
            if not hs:
                continue
            h, d, pos, low, high, ctx = map(np.concatenate, (hs, docs, poss, lows, highs, ctxs))
            first, marks = _merge(h, d, pos, low, high, ctx)
            h, d, pos, low, high, ctx = h[first], d[first], pos[first], low[first], high[first], ctx[first]
            yield _flow(_marks(dests, *marks) + _context_rows(_bucket(h, buckets) % groups, h, d, pos, low, high, ctx))

    return run


def _context_rows(bucket: np.ndarray, h, d, pos, low, high, ctx) -> list[tuple]:
    by = np.argsort(bucket, kind="stable")
    rows = []
    # Contexts are text, and the largest part of what is shuffled.
    cut = _runs(bucket[by])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own = by[a:b]
        rows.append((int(bucket[own[0]]), None, _vec.pack(h[own]), _vec.compress(_vec.pack(ctx[own])), _vec.pack(np.stack((d[own], pos[own]))), _vec.pack(np.stack((low[own], high[own])).astype(np.uint8))))
    return rows


def _contexts_of(rows: list[dict]) -> tuple:
    h = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows])
    ctx = np.concatenate([np.frombuffer(_vec.decompress(r["b"], len(r["a"]) // 8 * CONTEXT), np.uint8).reshape(-1, CONTEXT) for r in rows])
    d, pos = np.concatenate([np.frombuffer(r["c"], np.int64).reshape(2, -1) for r in rows], axis=1)
    low, high = np.concatenate([np.frombuffer(r["d"], np.uint8).reshape(2, -1) for r in rows], axis=1).astype(np.int64)
    return h, d, pos, low, high, ctx


def _split_contexts(buckets: int):
    def use(rows):
        found = _contexts_of(rows)
        return _context_rows(_bucket(found[0], buckets), *found)

    return lambda batches: _held_by_bucket(batches, use, RESPLIT)


def _merge(h, d, pos, low, high, ctx) -> tuple[np.ndarray, tuple]:
    """Merge equal contexts: places of the smallest document of each, and (documents, begins, ends) covered in the others."""
    # Two 64-bit hashes of a context and its range, eight bytes at a time.
    keys = [_vec.mix(h + salt + (low * SPAN + high).astype(np.uint64)) for salt in (np.uint64(1), np.uint64(2))]
    for a in range(0, CONTEXT, 8):
        part = np.ascontiguousarray(ctx[:, a : a + 8]).view("<u8").reshape(-1)
        keys = [_vec.mix(k + part * m) for k, m in zip(keys, _MULTIPLIERS, strict=True)]
    by = np.lexsort((pos, d, keys[1], keys[0]))
    fresh = np.ones(len(by), bool)
    fresh[1:] = (np.diff(keys[0][by]) != 0) | (np.diff(keys[1][by]) != 0)
    lead = by[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    # Hashes bring equal contexts together; whether they are is seen byte by byte.
    equal = (ctx[by] == ctx[lead]).all(1) & (low[by] == low[lead]) & (high[by] == high[lead]) & (h[by] == h[lead])
    later = (d[by] > d[lead]) & equal
    own = by[later]
    # A document's other places with its own first context still take part.
    return by[~later], (d[own], pos[own] - low[own], pos[own] - high[own] + LENGTH)


def _marks(dests: int, docs: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[tuple]:
    """The covered ranges of documents, merged, as rows of destinations."""
    by = np.lexsort((begins, docs))
    docs, begins, ends = docs[by], begins[by], ends[by]
    tags, begins, ends = begins >> PLACE_BITS, begins & _PLACE, ends & _PLACE
    if len(docs):
        # Far enough apart, ranges of different rows can be merged in one go.
        step = int(ends.max()) + 1
        fresh = np.concatenate(([True], (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])))
        row = np.cumsum(fresh) - 1
        begins, ends = _union(begins + row * step, ends + row * step)
        row = begins // step
        docs, tags = docs[fresh][row], tags[fresh][row]
        begins, ends = begins - row * step, ends - row * step
    high = tags << PLACE_BITS
    return _destinations(docs, dests, (begins | high)[:, None], (ends | high)[:, None])


def _union(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges that are sorted by their begin; ranges that touch become one."""
    if not len(begins):
        return begins, ends
    reach = np.maximum.accumulate(ends)
    new = np.ones(len(begins), bool)
    new[1:] = begins[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return begins[first], reach[np.append(first[1:] - 1, len(begins) - 1)]


def _sort_contexts(dests: int):
    def use(rows):
        h, d, pos, low, high, ctx = _contexts_of(rows)
        first, marks = _merge(h, d, pos, low, high, ctx)
        out = [marks]
        by = first[np.argsort(h[first], kind="stable")]
        sizes = np.diff(_runs(h[by]))
        by = by[np.repeat(sizes > 1, sizes)]
        h, ctx, d, pos, low, high = h[by], ctx[by], d[by], pos[by], low[by], high[by]
        cut = _runs(h)
        total = np.concatenate(([0], np.cumsum(low - high + 1)))
        a = 0
        while a < len(cut) - 1:
            b = max(a + 1, int(np.searchsorted(total[cut], total[cut[a]] + SORT_AT_ONCE, "right")) - 1)
            span = slice(cut[a], cut[b])
            out.append(_sort_windows(h[span], ctx[span], d[span], pos[span], low[span], high[span]))
            a = b
        return _marks(dests, *map(np.concatenate, zip(*out, strict=True)))

    return lambda batches: _held_by_bucket(batches, use)


def _sort_windows(h, ctx, d, pos, low, high) -> tuple:
    """(documents, begins, ends) of the windows of these contexts that a smaller document has too."""
    count = low - high + 1
    row = np.repeat(np.arange(len(h)), count)
    back = _vec.gather(high, count)
    # Equal windows have their anchor at the same place.
    group = np.cumsum(np.concatenate(([0], h[1:] != h[:-1])))[row] * SPAN + back
    order, number = deep_shallow(ctx, row, LENGTH - GRAM - back, group)
    first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(number) else number
    least = np.minimum.reduceat(d[row[order]], first)[number] if len(number) else number
    covered = order[d[row[order]] > least]
    begin = pos[row[covered]] - back[covered]
    return d[row[covered]], begin, begin + LENGTH


def _covered(text: np.ndarray, tag: int, copied: bool, marks: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal ranges of a text that go."""
    if copied and len(text) >= LENGTH:
        return np.array([0]), np.array([len(text)])
    if not marks:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, ends = (np.frombuffer(marks[c], np.int64) for c in "ab")
    own = begins >> PLACE_BITS == tag
    begins, ends = begins[own] & _PLACE, ends[own] & _PLACE
    begins, ends = begins[begins < len(text)], np.minimum(ends[begins < len(text)], len(text))
    by = np.argsort(begins, kind="stable")
    return _union(begins[by], ends[by])


def _gone(size: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    steps = np.zeros(size + 1, np.int8)
    steps[begins] += 1
    steps[ends] -= 1
    return np.cumsum(steps[:-1]) > 0


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, begins and ends of what goes) of each row (doc_id, text, tag, copied, marks)."""
    texts = _vec.strings(batch.column(1))
    for i, (tag, copied, marks) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)):
        text = texts.buf[texts.off[i] : texts.off[i + 1]]
        yield text, *_covered(text, tag, copied, marks)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, tag, copied, marks) to (doc_id, n_bytes, begins, ends, kept)."""
    for batch in batches:
        out: dict = {"n": [], "begins": [], "ends": [], "kept": []}
        for text, begins, ends in _ranges(batch):
            out["n"].append(len(text))
            out["begins"].append(begins.tolist())
            out["ends"].append(ends.tolist())
            out["kept"].append(text[~_gone(len(text), begins, ends)].tobytes())
        spans = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["begins"], spans), pa.array(out["ends"], spans), pa.array(out["kept"], pa.binary())], ["doc_id", "n_bytes", "begins", "ends", "kept"])


def _cut_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, tag, copied, marks, rest) to (doc_id, text, rest, emptied), characters kept or removed as a whole.

    emptied: nothing but white space is left of a text that had more.
    """
    for batch in batches:
        out, emptied = [], []
        for text, begins, ends in _ranges(batch):
            # Continuation bytes follow the byte that begins their character.
            lead = np.flatnonzero((text & 0xC0) != 0x80)
            gone = _gone(len(text), begins, ends)
            out.append(text[np.repeat(~gone[lead], np.diff(np.append(lead, len(text))))].tobytes().decode())
            emptied.append(len(begins) > 0 and not out[-1].strip() and bool(text.tobytes().decode().strip()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(5), pa.array(emptied, pa.bool_())], ["doc_id", "text", "rest", "emptied"])


def _with_marks(docs: DataFrame, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    """(doc_id, text, tag, copied, marks) and a struct ``rest`` of further columns: what of each document goes.

    All readers of the dealt texts take ``rest`` along, since the optimizer would deal them again without it.
    """
    own = [F.struct(*rest).alias("rest")] if rest else []
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *own)
    # Rows without a doc_id are dealt evenly; nothing that is sent to a doc_id is for them.
    docs = docs.withColumn("tag", F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1))).withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    names = docs.columns
    buckets = partitions(docs, mb=8)
    groups, n = min(buckets, GROUPS), min(buckets, PARTS)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    prints = docs.select("doc_id", "tag", digest.alias("print"))
    # Written, so that the join has two plain exchanges, of which Spark can split a hot group of copies.
    firsts = written(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copies = prints.join(firsts, "print").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("tag").alias("copies")).withColumnRenamed("doc_id", "key")

    def by_bucket(flow: DataFrame, split) -> DataFrame:
        """The flow with one bucket's rows after the other in a partition."""
        if groups < buckets:
            flow = flow.repartition(n, "bucket", "dest").sortWithinPartitions("bucket").mapInArrow(_vec.tidy(split(buckets)), _FLOW_DDL)
        return flow.repartition(n, "bucket", "dest").sortWithinPartitions("bucket")

    dealt = docs.repartition(n, "key")
    copied = F.col("doc_id").isNotNull() & F.coalesce(F.array_contains("copies", F.col("tag")), F.lit(False))
    single = dealt.join(copies.hint("shuffle_hash"), "key", "left").withColumn("copied", copied)
    distinct = single.where(~F.col("copied")).select(*names)
    by_doc = "doc_id long, a binary, b binary"
    found = distinct.mapInArrow(_vec.tidy(_emit_anchors(buckets, groups, n, 8 if groups < buckets else HASH_BYTES)), _FLOW_DDL)
    shared = by_bucket(found, _split_anchors).mapInArrow(_vec.tidy(_shared_anchors(n)), _FLOW_DDL)
    lists = shared.repartition(n, "dest").mapInArrow(_vec.tidy(_to_documents), by_doc).select(F.col("doc_id").alias("key"), F.col("a").alias("lists"))
    # A left join: an inner one would push a null check below the exchange, which then couldn't be reused.
    contexts = distinct.join(lists.hint("shuffle_hash"), "key", "left").select(*names, "lists").mapInArrow(_vec.tidy(_emit_contexts(buckets, groups, n)), _FLOW_DDL)
    marked = by_bucket(contexts, _split_contexts).mapInArrow(_vec.tidy(_sort_contexts(n)), _FLOW_DDL)
    marks = marked.repartition(n, "dest").mapInArrow(_vec.tidy(_to_documents), by_doc).select(F.col("doc_id").alias("key"), F.struct("a", "b").alias("marks"))
    rows = single.join(marks.hint("shuffle_hash"), "key", "left")
    return rows.select("doc_id", "text", "tag", "copied", F.when(F.col("doc_id").isNotNull(), F.col("marks")).alias("marks"), *["rest"] * bool(rest))


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_bytes, begins and ends of the removed byte ranges, and kept (binary)."""
    ddl = "doc_id long, n_bytes long, begins array<long>, ends array<long>, kept binary"
    return _with_marks(docs, id_col, text_col, []).mapInArrow(_vec.tidy(_cut), ddl)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """The documents, all columns, with texts without the repeated bytes; a null text is empty.

    Of a character that a range cuts, its first byte decides: it stays or goes as a whole.  ``drop_emptied`` leaves
    out documents of which nothing but white space remains, unless they came so.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)] or [id_col]
    kind = docs.select(F.struct(*rest).alias("rest")).schema["rest"].dataType.simpleString()
    rows = _with_marks(docs, id_col, text_col, rest).mapInArrow(_vec.tidy(_cut_characters), f"doc_id long, text string, rest {kind}, emptied boolean")
    if drop_emptied:
        rows = rows.where(~F.col("emptied"))
    own = {id_col: F.col("doc_id").cast(docs.schema[id_col].dataType), text_col: F.col("text")}
    return rows.select(*[own.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])
