"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its subwords, the hashed byte n-grams of its words (A-Z lowered) with
a border before and after, followed by a linear softmax; both layers are trained by stochastic gradient descent in numpy.  Since the
model is linear after the average, prediction adds up one row of class scores for each n-gram.

The classifier is fitted on a bounded sample: about ``per_class`` labelled documents of each
language (all, if there are fewer), chosen by a hash of doc_id.  A quarter of them calibrates:
a temperature makes the softmax a probability, and ``reject_below`` is the confidence under
which at most ``REJECT_RATE`` of rightly predicted calibration documents fall, ``MOST`` at most:
a document in two of the languages is not rejected.
Every text is predicted whole.  A null text or one without a letter is ``und`` with score 0.
If there are no labelled documents, everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _vec

GRAMS = (2, 3, 4)
BUCKETS = 1 << 14
DIM = 16
EPOCHS = 6
RATE = 2.0
PER_CLASS = 500
REJECT_RATE = 0.001
MOST = 0.4


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages: embedding times output layer
    bias: np.ndarray
    temperature: float
    reject_below: float


def _subwords(texts: _vec.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of each word's distinct word, word offsets of the texts, buckets of the distinct words' n-grams, their offsets)."""
    which, at, sizes, words = _vec.bordered(texts)
    ids, owner = [], []
    for k in GRAMS:
        hashes = words.grams(k)
        count = np.maximum(sizes + 3 - k, 0)
        ids.append((hashes[_vec.gather(words.off[:-1], count)] >> np.uint64(50)).astype(np.int64))
        owner.append(np.repeat(np.arange(len(sizes)), count))
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    by = np.argsort(owner, kind="stable")
    return which, at, ids[by], np.searchsorted(owner[by], np.arange(len(sizes) + 1))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, n-gram buckets, their shares): at most BUCKETS entries a row."""
    for batch in batches:
        langs = batch.column(0)
        for a, b, texts in _vec.slices(_vec.strings(batch.column(1))):
            which, at, ids, off = _subwords(texts)
            counts = []
            for i in range(b - a):
                own = which[at[i] : at[i + 1]]
                counts.append(np.bincount(ids[_vec.gather(off[own], off[own + 1] - off[own])], minlength=BUCKETS))
            used = [np.flatnonzero(c) for c in counts]
            shares = [c[u] / max(1, c.sum()) for c, u in zip(counts, used, strict=True)]
            yield pa.RecordBatch.from_arrays([langs.slice(a, b - a), pa.array([_vec.pack(u.astype(np.int32)) for u in used]), pa.array([_vec.pack(s.astype(np.float32)) for s in shares])], ["lang", "ids", "shares"])


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, per_class: int = PER_CLASS, seed: int = 7) -> Model:
    """Fit on the rows where ``learn`` holds and the language is known."""
    usable = F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}")
    known = docs.where(usable if learn is None else usable & learn)
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, per_class / sizes[k]))])
    drawn = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1 << 20)) < share[F.col(lang_col)] * (1 << 20)
    rows = known.where(drawn).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_vec.tidy(_bags), "lang string, ids binary, shares binary").toArrow()
    index = {k: i for i, k in enumerate(languages)}
    bags = sorted(zip((index[k] for k in rows.column("lang").to_pylist()), rows.column("ids").to_pylist(), rows.column("shares").to_pylist(), strict=True))
    del rows
    data = [(y, np.frombuffer(i, np.int32), np.frombuffer(s, np.float32)) for y, i, s in bags]
    rng = np.random.default_rng(seed)
    rng.shuffle(data)
    held = data[: len(data) // 4] or data
    train = data[len(data) // 4 :] or data
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(train)):
            y, ids, shares = train[k]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = shares @ embed[ids]
            error = _softmax(mean @ out + bias)
            error[y] -= 1
            step = out @ error
            out -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            embed[ids] -= rate * 8 * shares[:, None] * step
    scores = embed @ out
    logits = np.array([shares @ scores[ids] + bias for _, ids, shares in held])
    truth = np.array([y for y, _, _ in held])
    heat = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())
    p = _softmax(logits / heat)
    right = p.max(-1)[p.argmax(-1) == truth]
    reject = min(MOST, float(np.quantile(right, REJECT_RATE))) if len(right) else 0.0
    return Model(languages, scores.astype(np.float32), bias, float(heat), reject)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, b, texts in _vec.slices(_vec.strings(batch.column(1))):
                which, at, ids, off = _subwords(texts)
                owner = np.repeat(np.arange(len(off) - 1), np.diff(off))

                def summed(by_word: np.ndarray, which=which, at=at) -> np.ndarray:
                    return np.diff(np.concatenate(([0.0], np.cumsum(by_word[which])))[at])

                count = summed(np.diff(off).astype(np.float64))
                total = np.stack([summed(np.bincount(owner, model.scores[:, c][ids], len(off) - 1)) for c in range(len(model.languages))], 1)
                p = _softmax((total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
                best[a:b], score[a:b] = p.argmax(-1), p.max(-1)
            lang = np.where(lettered, np.array(model.languages, object)[best], "und")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.where(lettered, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected for each document."""
    lettered = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lettered.alias("lettered"))
    if not model.languages:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(_vec.tidy(_predict(model)), f"doc_id {kind}, lang_pred string, score double")
    return found.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("score") < model.reject_below))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language the model does not reject."""
    names = docs.columns
    at = names.index(text_col)

    predict = _predict(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(at), batch.column(len(names))], ["doc_id", "text", "lettered"])
            (found,) = predict(iter([own]))
            keep = (np.array(found.column(1)) != "und") & (np.array(found.column(2)) >= model.reject_below)
            yield batch.select(range(len(names))).filter(pa.array(keep))

    if not model.languages:
        return docs.where(F.lit(False))
    flag = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("__lettered")
    return docs.select("*", flag).mapInArrow(_vec.tidy(run), docs.schema)
