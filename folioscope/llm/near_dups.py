"""MinHash near-duplicate detection.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered; a document's set holds the
distinct ``words``-word shingles, or the whole sequence as one shingle if it has fewer words.
Documents whose sets have a Jaccard similarity of at least ``percent`` / 100 are linked.

1. Documents with equal sets become one class, a node of its own.
2. Every class gets ``BANDS * ROWS`` minima under universal hashes a * x + b modulo 2^64 (the
   high bits decide).  Sixteen bits of each are the signature; ROWS of them are a band's key.
3. Classes that share a band are paired with one pivot of the bucket.  Signatures and set sizes drop the pairs that can't
   be linked before any text is fetched; the full sets confirm the others.  Then the classes of a bucket
   that are not yet in its largest component are paired with some members of that, and what is left
   is compared with all others whose sets are near enough in size, in blocks of bounded bytes, by signature
   and then by full sets.
4. Connected components by alternating large-star and small-star.

At a similarity of 0.85 a pair shares no band with probability 2e-8, at 0.80 with 3e-6.  No bucket is capped;
a bucket's pairs are never emitted, only links that connect components.

Null and empty texts have an empty set and are linked with nothing.  A document whose doc_id is null
gets the component of its equals, if they have one, and is not kept.  Rows that share a doc_id are documents
of their own; those with the same text too have the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec
from ._spark import forget, written

BANDS, ROWS = 24, 4
#: Standard deviations by which a signature may fall short of the threshold before the pair is dropped.
SLACK = 5.0
#: Members of a bucket that one block holds, about, and bytes of their texts.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Members of a bucket's main component with which the others are compared first.
PIVOTS = 4

_RNG = np.random.Generator(np.random.PCG64(77))
_A = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MULT = _RNG.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: _vec.Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and their offsets."""
    hashes, at = texts.word_hashes(lower=True)
    count = np.diff(at)
    n = np.maximum(len(hashes) - words + 1, 0)
    shingles = np.zeros(n, np.uint64)
    for k in range(words):
        shingles += hashes[k : k + n] * _MULT[k]
    shingles = _vec.mix(shingles)
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(count):
        a, c = at[i], count[i]
        if c >= words:
            own = np.unique(shingles[a : a + c - words + 1])
        else:
            with np.errstate(over="ignore"):
                own = _vec.mix((hashes[a : a + c] * _MULT[:c]).sum(dtype=np.uint64, keepdims=True))
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def signatures(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """16 bits of each minimum: a row for each set; the rows of empty sets are zero."""
    out = np.zeros((len(off) - 1, BANDS * ROWS), np.uint16)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        for k in range(BANDS * ROWS):
            out[full, k] = (_vec.mix(np.minimum.reduceat(sets * _A[k] + _B[k], off[full])) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _vec.slices(_vec.strings(batch.column(2))):
                sets, off = shingle_sets(texts, words)
                size = np.diff(off)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(_vec.mix(sets * _MULT[k]), dtype=np.uint64))) for k in (14, 15)]
                keys = [(s[off[1:]] - s[off[:-1]]).view(np.int64) for s in sums]
                flat = signatures(sets, off).reshape(-1).view(np.uint8)
                width = 2 * BANDS * ROWS
                sig = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.arange(0, (b - a + 1) * width, width, dtype=np.int32)), pa.py_buffer(flat)])
                own = [batch.column(k).slice(a, b - a) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(size), pa.array(keys[0]), pa.array(keys[1]), sig], ["doc_id", "tag", "n_shingles", "key1", "key2", "sig"])

    return run


def _enough(share: np.ndarray, percent: int) -> np.ndarray:
    """Whether so many equal minima allow a similarity of percent / 100."""
    s, n = percent / 100, BANDS * ROWS
    return share >= n * s - SLACK * np.sqrt(n * s * (1 - s))


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a similarity of percent / 100."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _possible(percent: int):
    """Rows (x, y, sizes and signatures of both) to the (x, y) whose signatures and sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_x, n_y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            sig_x, sig_y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS) for k in (4, 5))
            keep = _enough((sig_x == sig_y).sum(-1), percent) & (100 * np.minimum(n_x, n_y) >= percent * np.maximum(n_x, n_y))
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _confirm(words: int, percent: int):
    """Rows (x, y, text_x, text_y) to the linked (x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _vec.strings(batch.column(2)), _vec.strings(batch.column(3))
            ids = batch.column(0).to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            a = 0
            while a < batch.num_rows:
                b = a + 1
                while b < batch.num_rows and left.off[b + 1] - left.off[a] + right.off[b + 1] - right.off[a] < _vec.SLICE_BYTES:
                    b += 1
                # A pivot stands in many rows; its set is made once a slice.
                _, first, which = np.unique(ids[a:b], return_index=True, return_inverse=True)
                sx, ox = shingle_sets(_taken(left, a + first), words)
                sy, oy = shingle_sets(_taken(right, np.arange(a, b)), words)
                for i, x in enumerate(which.tolist()):
                    keep[a + i] = _linked(sx[ox[x] : ox[x + 1]], sy[oy[i] : oy[i + 1]], percent)
                a = b
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _taken(texts: _vec.Texts, rows: np.ndarray) -> _vec.Texts:
    sizes = texts.off[rows + 1] - texts.off[rows]
    return _vec.Texts(texts.buf[_vec.gather(texts.off[rows], sizes)], np.concatenate(([0], np.cumsum(sizes))))


def _across(words: int, percent: int):
    """Blocks (band, odd, members) to links between components; odd and members: (node, comp, sig, text).

    Only pairs of different components are compared, in the first band that they share, by
    signature and then by their full sets.  A confirmed pair makes one component of two, so a
    block yields fewer links than it has components, whatever the number of its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                band, odd, members = row["band"], row["odd"], row["members"]
                place = {m["node"]: i for i, m in enumerate(members)}
                every = members + [m for m in odd if m["node"] not in place]
                place |= {m["node"]: i for i, m in enumerate(every)}
                label = np.array([m["comp"] for m in every], np.int64)
                sigs = np.frombuffer(b"".join(m["sig"] for m in every), np.uint16).reshape(len(every), -1)
                sets: dict[int, np.ndarray] = {}

                def shingles(i: int, every=every, sets=sets) -> np.ndarray:
                    if i not in sets:
                        sets[i] = shingle_sets(_vec.strings(pa.array([every[i]["text"]], pa.string())), words)[0]
                    return sets[i]

                links = []
                for m in odd:
                    i = place[m["node"]]
                    same = sigs[: len(members)] == sigs[i]
                    earlier = same[:, : band * ROWS].reshape(len(members), band, ROWS).all(-1).any(-1) if band else np.zeros(len(members), bool)
                    share = same.sum(-1)
                    near = np.flatnonzero(_enough(share, percent) & ~earlier & (label[: len(members)] != label[i]))
                    for j in near[np.argsort(-share[near], kind="stable")].tolist():
                        if label[i] != label[j] and _linked(shingles(i), shingles(j), percent):
                            label[label == label[j]] = label[i]
                            links.append((every[i]["node"], every[j]["node"]))
                x, y = (np.array([e[c] for e in links], np.int64) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["x", "y"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of the undirected edges (x, y); comp is the smallest node reachable.

    Alternates large-star and small-star until the edges are stars: each links a smallest node, which no edge
    has as its larger end, to one that has no other edge.  Each step is an aggregation for the smallest neighbour
    and a join back; no neighbourhood is collected.
    """
    now = written(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x < y").distinct())
    while True:
        ends = now.select(F.col("x").alias("u"), F.lit(1).alias("as_x"), F.lit(0).alias("as_y")).union(now.select("y", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.max("as_x").alias("as_x"), F.sum("as_y").alias("as_y")).where("as_x + as_y > 1").isEmpty():
            out = now.select(F.col("y").alias("node"), F.col("x").alias("comp")).union(now.select("x", "x").distinct())
            out._folioscope_path = now._folioscope_path
            return out
        # Large star: link each larger neighbour to the smallest of the neighbourhood.
        both = now.union(now.select("y", "x")).toDF("u", "v")
        # Written, so that Spark can split the edges of a hub in the join.
        smallest = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(smallest, "u").select(F.col("m").alias("x"), F.col("v").alias("y")).distinct()
        # Small star: link each smaller neighbour, and the node itself, to the smallest one.
        least = large.groupBy("y").agg(F.min("x").alias("m"))
        small = large.join(least, "y").select(F.col("m").alias("x"), F.col("x").alias("y")).union(least.select("m", "y"))
        new = written(small.where("x < y").distinct())
        forget(now, smallest)
        now = new


def _links(nodes: DataFrame, members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, comp) for all nodes (written)."""

    def confirmed(pairs: DataFrame) -> DataFrame:
        # Pivots are joined last, when a row is large enough for Spark to see that they are hot.
        sigs = {c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")) for c in "xy"}
        full = {c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "xy"}
        pairs = pairs.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        pairs = pairs.join(sigs["y"], "y").join(sigs["x"], "x").select("x", "y", "n_x", "n_y", "sig_x", "sig_y").mapInArrow(_vec.tidy(_possible(percent)), "x long, y long")
        return pairs.join(full["y"], "y").join(full["x"], "x").select("x", "y", "text_x", "text_y").mapInArrow(_vec.tidy(_confirm(words, percent)), "x long, y long")

    def joined(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """The labels with the components of these links made one; works on the components, not on the links before."""
        x, y = (labels.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")) for c in "xy")
        found = components(pairs.join(x, "x").join(y, "y").select(F.col("cx").alias("x"), F.col("cy").alias("y")))
        new = found.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        out = written(labels.join(new, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")))
        forget(found, labels)
        return out

    def open_buckets(labels: DataFrame) -> DataFrame:
        """The members of buckets of three or more that are not all connected, with their and the bucket's main component."""
        placed = members.where("n > 2").select("bucket", "band", "node").join(labels, "node")
        sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
        main = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main")).where("parts > 1").drop("parts")
        main = written(main)
        out = written(placed.join(main, "bucket"))
        forget(main)
        return out

    labels = written(nodes.select("node", F.col("node").alias("comp")))
    labels = joined(labels, confirmed(members.select(F.col("pivot").alias("x"), F.col("node").alias("y"))))
    still = open_buckets(labels)
    if not still.isEmpty():
        # More pivots out of the main component connect most of the others.
        own = written(still.where("comp = main").groupBy("bucket").agg(*[F.min_by("node", F.xxhash64("node", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)]))
        tries = still.where("comp <> main").join(own, "bucket").select(F.explode(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("x"), F.col("node").alias("y"))
        labels = joined(labels, confirmed(tries))
        forget(own, still)
        still = open_buckets(labels)
    if not still.isEmpty():
        # The rest, exhaustively: what is not in the main component against all others, in blocks.  Sets that can be
        # linked have sizes in one cell or in neighbouring ones.
        cell = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / percent)) if percent < 100 else F.col("n_shingles"))
        sized = written(still.join(nodes.select("node", "sig", cell.alias("cell")), "node").join(texts, "node"))
        parts = sized.groupBy("bucket", "cell").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("text")) / BLOCK_BYTES)).alias("parts"))
        parts = written(parts)
        member = F.struct("node", "comp", "sig", "text")
        placed = sized.join(parts, ["bucket", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")))
        # Written too, so that the join has plain exchanges.
        blocks = written(placed.groupBy("bucket", "band", "cell", "block").agg(F.collect_list(member).alias("members")).drop("block"))
        odd = placed.where("comp <> main").groupBy("bucket", "cell", "block").agg(F.collect_list(member).alias("odd")).drop("block")
        odd = written(odd.select("bucket", "odd", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell")))
        more = odd.join(blocks, ["bucket", "cell"]).select("band", "odd", "members").mapInArrow(_vec.tidy(_across(words, percent)), "x long, y long")
        labels = joined(labels, more)
        forget(sized, parts, blocks, odd)
    forget(still)
    return labels


def _verdicts(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """doc_id, tag (a hash of the text), n_shingles, component_id, and whether the row stays (written)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))
    sketch = written(docs.mapInArrow(_vec.tidy(_sketch(words)), "doc_id long, tag long, n_shingles long, key1 long, key2 long, sig binary"))
    keys = ["n_shingles", "key1", "key2"]
    # A class is known by the smallest doc_id that it has, and that one's text.  Its number comes with the written table.
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("lead")
    classes = sketch.where("n_shingles > 0").groupBy(*keys).agg(lead, F.any_value("sig").alias("sig"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), *keys, F.col("lead.doc_id").alias("rep"), F.col("lead.tag").alias("first"), "sig"))

    bands = classes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.col("sig").substr(i * 2 * ROWS + 1, F.lit(2 * ROWS)))).alias("band", "part")).select("node", "band", F.xxhash64("band", "part").alias("bucket"))
    # Written, so that the join has two plain exchanges, of which Spark can split a hot bucket.
    shared = written(bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1"))
    members = written(bands.join(shared, "bucket"))
    nodes = written(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "rep", "first", "n_shingles", "sig"))
    found = docs.join(nodes.select("node", "rep", "first"), (F.col("tag") == F.col("first")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    texts = written(found.groupBy("node").agg(F.any_value("text").alias("text")))
    labels = _links(nodes, members, texts, words, percent)
    groups = written(classes.select("node", "rep", "first").join(labels, "node").groupBy("comp").agg(F.min("rep").alias("group"), F.min("first").alias("group_first")))
    placed = written(classes.drop("sig").join(labels, "node", "left").join(groups, "comp", "left").select(*keys, F.when(F.col("comp").isNotNull(), F.col("group")).otherwise(F.col("rep")).alias("group"), F.coalesce("group_first", "first").alias("first")))
    out = sketch.select("doc_id", "tag", *keys).join(placed, keys, "left")
    # Of a group without any doc_id the smallest hash of a text stays.
    stays = F.when(F.col("n_shingles") == 0, True).when(F.col("group").isNull(), F.col("tag") == F.col("first")).otherwise(F.col("doc_id").eqNullSafe(F.col("group")))
    out = written(out.select("doc_id", "tag", "n_shingles", F.coalesce("group", "doc_id").alias("component_id"), stays.alias("stays")))
    forget(sketch, classes, shared, members, nodes, texts, labels, groups, placed)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that links reach, kept whether it is the own one.
    """
    rows = _verdicts(docs, id_col, text_col, words, percent)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, that are kept: of each group the one with the smallest doc_id.

    Verdicts are those of rows, by doc_id and text, so of two texts with one doc_id one may go and the other
    stay.  A group without any doc_id keeps one text.  Repeated rows, of the same doc_id and text, stay or go together.
    """
    gone = _verdicts(docs, id_col, text_col, words, percent).where("not stays").select(F.col("doc_id").alias("__gone"), "tag").distinct()
    names = docs.columns
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("hash"))
    rows = rows.join(gone, (F.col("hash") == F.col("tag")) & F.col("id").eqNullSafe(F.col("__gone")), "left_anti")
    return rows.select(*[F.col("row")[c].alias(c) for c in names])
