"""Toxicity by class-conditional Kneser-Ney models.

A word is the bytes of a white-space separated string (A-Z lowered) between two border bytes.
Two models of order ``ORDER`` give the probability of each byte after the ``ORDER - 1`` before it,
one learnt from toxic and one from ordinary documents.  The highest order has counts of its own
class; below it both share the Kneser-Ney continuation counts of all labelled text, so that
what is rare in both classes says little about either.  Of every run of ``PASSAGE`` words the log-likelihood under the
toxic model less that under the ordinary one is divided by its bytes; a document has that of its most toxic run, since
toxic expressions get rarer, a byte, as documents get longer.  A document of fewer words is one run.  A logistic function,
fitted on labelled documents set apart from the counts, makes it a score.

Counts come from all rows to learn from and are kept by the n-grams themselves: up to four bytes
and their number fit a key, so none are hashed together, and the model grows with the distinct n-grams
of the corpus.  What is shipped to the tasks is the log ratio of each n-gram that was seen, and that
of backing off in each context.

Null and empty texts have the log ratio 0.  If one of the classes has no documents, every score
is the share of toxic documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _vec

ORDER = 4
#: Words of a run whose log-likelihoods are compared.
PASSAGE = 4
#: Labelled documents that fit the logistic function, about.
CALIBRATE = 10_000


@dataclass
class Model:
    grams: np.ndarray  # keys of the n-grams seen, sorted
    gram: np.ndarray  # log ratio of each
    contexts: np.ndarray  # keys of their contexts, sorted
    context: np.ndarray  # log ratio of backing off in each
    slope: float
    offset: float


def _keys(words: _vec.Texts, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte after the first of each word: its word, and the key of the n-gram: its number of bytes, and its bytes."""
    sizes = np.diff(words.off)
    word = np.repeat(np.arange(len(sizes)), sizes - 1)
    at = _vec.gather(words.off[:-1] + 1, sizes - 1)
    size = np.minimum(at + 1 - words.off[word], order)
    key = size << 32
    for k in range(order):
        key += np.where(k < size, words.buf[np.maximum(at - k, 0)].astype(np.int64) << 8 * k, 0)
    return word, key


def _suffix(keys: np.ndarray, order: int) -> np.ndarray:
    """The keys of the n-grams' last ``order`` bytes, or of all if they have less."""
    size = np.minimum(keys >> 32, order)
    return size << 32 | keys & ((1 << 8 * size) - 1)


def _context(keys: np.ndarray) -> np.ndarray:
    """The keys of the n-grams without their last byte."""
    return ((keys >> 32) - 1) << 32 | (keys & 0xFFFFFFFF) >> 8


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their two counts."""
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, np.stack([np.bincount(which, c, len(distinct)) for c in counts])


def _look_up(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of what is sought among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return at, keys[at] == sought


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (order, n-gram, toxic, ordinary), added up for each task."""
    totals = [(np.zeros(0, np.int64), np.zeros((2, 0)))] * (ORDER + 1)
    held: list[list] = [[] for _ in totals]

    def add_up(n):
        parts = [totals[n], *held[n]]
        totals[n] = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts], 1))
        held[n].clear()

    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, texts in _vec.slices(_vec.strings(batch.column(0))):
            which, at, _, words = _vec.bordered(texts)
            if not len(which):
                continue
            label = np.repeat(toxic[a:b], np.diff(at))
            by_class = [np.bincount(which[label == c], minlength=len(words)) for c in (0, 1)]
            for n in range(1, ORDER + 1):
                word, key = _keys(words, n)
                held[n].append(_summed(key, np.stack([c[word] for c in by_class])))
                if sum(len(k) for k, _ in held[n]) > max(200_000, len(totals[n][0])):
                    add_up(n)
    for n in range(1, ORDER + 1):
        add_up(n)
        keys, counts = totals[n]
        for k in range(0, len(keys), 100_000):
            some = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[some]), n, np.int32)), pa.array(keys[some]), *(pa.array(counts[c, some].astype(np.int64)) for c in (1, 0))], ["n", "gram", "toxic", "ordinary"])


def _discount(counts: np.ndarray) -> float:
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(one / (one + 2 * two)) if one else 0.5


def _ratios(rows: dict[int, dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a model holds, of the counts of each order by sorted n-grams."""
    shorter, below = np.zeros(0, np.int64), np.zeros(0)  # the n-grams an order lower, and their probabilities

    def backed_off(keys, n):
        return below[_look_up(shorter, _suffix(keys, n - 1))[0]] if n > 1 else np.full(len(keys), 1 / 256)  # under order 1 all bytes are alike

    for n in range(1, ORDER):
        keys = rows[n]["gram"]
        # In how many different (n + 1)-grams an n-gram ends.
        continued = np.bincount(_look_up(keys, _suffix(rows[n + 1]["gram"], n))[0], minlength=len(keys)).astype(float)
        d = _discount(continued)
        _, context = np.unique(_context(keys), return_inverse=True)
        total = np.maximum(np.bincount(context, continued)[context], 1)
        kinds = np.bincount(context, continued > 0)[context]
        own = np.maximum(continued - d, 0) / total + np.minimum(1, d * np.maximum(kinds, 1) / total) * backed_off(keys, n)
        shorter, below = keys, np.maximum(own, 1e-9)
    r = rows[ORDER]
    contexts, context = np.unique(_context(r["gram"]), return_inverse=True)
    under = backed_off(r["gram"], ORDER)
    logs, back = [], []
    for c in ("toxic", "ordinary"):
        count = r[c].astype(float)
        d = _discount(r[c])
        total = np.bincount(context, count)
        kinds = np.bincount(context, count > 0)
        rest = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        rest = np.maximum(rest, 1e-6)
        p = np.maximum(count - d, 0) / np.maximum(total[context], 1) + rest[context] * under
        logs.append(np.log(p))
        back.append(np.log(rest))
    return r["gram"], (logs[0] - logs[1]).astype(np.float32), contexts, (back[0] - back[1]).astype(np.float32)


def _log_ratios(model: Model):
    """(doc_id, text) to (doc_id, the largest length-normalised log ratio of its runs of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, texts in _vec.slices(_vec.strings(batch.column(1))):
                which, at, sizes, words = _vec.bordered(texts)
                if not len(which):
                    continue
                word, key = _keys(words, ORDER)
                ratio = np.zeros(len(key))
                for keys, values, sought in ((model.contexts, model.context, _context(key)), (model.grams, model.gram, key)):
                    place, seen = _look_up(keys, sought)
                    ratio[seen] = values[place[seen]]
                own = np.bincount(word, ratio, len(words))[which]
                bytes_ = (sizes + 1)[which]
                sums, lengths = (np.concatenate(([0.0], np.cumsum(x, dtype=np.float64))) for x in (own, bytes_))
                begin, end = (np.repeat(x, np.diff(at)) for x in (at[:-1], at[1:]))
                first = np.arange(len(which))
                last = np.minimum(first + PASSAGE, end)
                value = (sums[last] - sums[first]) / (lengths[last] - lengths[first])
                value[(first > begin) & (first + PASSAGE > end)] = -np.inf  # shorter than the others
                full = np.flatnonzero(np.diff(at))
                out[a + full] = np.maximum.reduceat(value, at[full])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "ratio"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic function, by Newton's method on standardised x."""
    mean, spread = x.mean(), x.std() or 1.0
    z, w = (x - mean) / spread, np.zeros(2)
    rows = np.stack((z, np.ones_like(z)), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        hess = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2)
        w -= np.linalg.solve(hess, rows.T @ (weight * (p - y)) + 1e-3 * w)
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def fit(labelled: DataFrame, calibrate: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 5) -> Model:
    """Learn from all rows; those where ``calibrate`` holds fit the logistic function, the others are counted.

    A class without a row for one of the two has all its rows in both.
    """
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("toxic"), calibrate.alias("apart"))
    sizes = rows.groupBy("apart", "toxic").count().collect()
    total = {c: sum(r["count"] for r in sizes if r.toxic == c) for c in (0, 1)}
    flat = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, 0.0)
    flat.offset = float(np.log((total[1] + 0.5) / (total[0] + 0.5)))
    if not total[0] or not total[1]:
        return flat
    fitting = {c: sum(r["count"] for r in sizes if r.toxic == c and r.apart) for c in (0, 1)}
    counting = {c: sum(r["count"] for r in sizes if r.toxic == c and r.apart is False) for c in (0, 1)}
    both = F.col("toxic").isin([c for c in (0, 1) if not fitting[c] or not counting[c]])
    counts = rows.where(~F.col("apart") | both).select("text", "toxic").mapInArrow(_vec.tidy(_count), "n int, gram long, toxic long, ordinary long")
    table = counts.groupBy("n", "gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toArrow().sort_by("gram")
    columns = {c: table.column(c).to_numpy() for c in table.column_names}
    by_order = {n: {c: v[columns["n"] == n] for c, v in columns.items()} for n in range(1, ORDER + 1)}
    model = Model(*_ratios(by_order), 0.0, 0.0)
    fitting = {c: fitting[c] if fitting[c] and counting[c] else total[c] for c in (0, 1)}
    # At least half of CALIBRATE from each class, if it has them; rows stand for those that were not drawn.
    share = {c: min(1.0, max(CALIBRATE / sum(fitting.values()), CALIBRATE / 2 / fitting[c])) for c in (0, 1)}
    drawn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, int(share[1] * (1 << 20))).otherwise(int(share[0] * (1 << 20)))
    found = rows.where(F.col("apart") | both).where(drawn).select("toxic", "text").mapInArrow(_vec.tidy(_log_ratios(model)), "toxic int, ratio double").collect()
    y, x = np.array([r.toxic for r in found], float), np.array([r.ratio for r in found])
    if not len(y) or y.min() == y.max():
        return flat
    model.slope, model.offset = _logistic(x, y, np.where(y == 1, 1 / share[1], 1 / share[0]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score from 0 to 1 and predicted for each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_vec.tidy(_log_ratios(model)), f"doc_id {kind}, ratio double")
    p = 1 / (1 + F.exp(-(F.col("ratio") * model.slope + model.offset)))
    return rows.select("doc_id", p.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
