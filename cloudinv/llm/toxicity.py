"""Toxicity of documents by a factorization machine over hashed terms."""

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudinv.llm.common import held_out, read, texts, words
from cloudinv.llm.labelled import FOLDS, HELD, training_rows

BUCKETS = 1 << 20
PER_CLASS = 4000
MOST = 2048
MARKS = b".,;:!?\"'()[]{}<>*#$%&|-_/\\"
THRESHOLD = 0.5


def _hashed(word: bytes) -> set[int]:
    """The hashed terms of a word: itself without marks at its ends, and its first 4 and 5 bytes."""
    bare = word.strip(MARKS) or word
    return {xxhash.xxh64_intdigest(t) % BUCKETS for t in (b"w" + bare, b"4" + bare[:4], b"5" + bare[:5])}


def terms(text: str) -> np.ndarray:
    """The distinct hashed terms of ``text``, sorted."""
    found = {t for word in set(words(text)) for t in _hashed(word)}
    return np.sort(np.fromiter(found, np.int64, len(found)))


@dataclass
class Model:
    """P(toxic) = sigmoid(bias + sum of weights + sum over pairs of their factors' products)."""

    bias: float
    known: np.ndarray  # sorted hashed terms
    weights: np.ndarray
    factors: np.ndarray
    id: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def learned(self) -> bool:
        """Whether any term tells the classes apart; if none does, all documents score alike."""
        return len(self.known) > 0

    def logit(self, text: str, seen: dict[bytes, tuple[int, ...]]) -> float:
        """``seen``: a cache of words, kept between texts."""
        found = {p for own in map(seen.__getitem__, set(words(text))) if own for p in own}
        at = np.sort(np.fromiter(found, np.int64, len(found)))
        v = self.factors[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return self.bias + float(self.weights[at].sum()) + pairs


class _Positions(dict):
    """Word -> where its terms stand in a model; most words have none there."""

    def __init__(self, model: Model, limit: int = 300_000):
        self.place, self.limit = {int(t): i for i, t in enumerate(model.known)}, limit

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = tuple(self.place[t] for t in _hashed(word) if t in self.place)
        return found


def fit(rows: list[np.ndarray], labels: np.ndarray, rank: int = 4, epochs: int = 12, steps: int = 600, batch: int = 128,
        most: int = MOST, deviates: float = 4.0, rate: float = 0.02, shrink: float = 0.02, sizes: dict[int, int] | None = None) -> Model:
    """Mini-batch Adam on the logistic loss.

    Terms take part if their share of documents differs between the classes by over ``deviates``
    standard errors, at most the ``most`` that differ most, so that long clean documents gather
    no noise. Classes weigh the same. With one class only, no rows, or no such term, nothing is
    learned: the model is the share of toxic ones in ``sizes``, the classes' sizes before sampling
    (those of ``labels`` if not given; a half without any).
    """
    rng = np.random.default_rng(0)
    positive = int(labels.sum())
    sizes = {1: positive, 0: len(labels) - positive} if sizes is None else sizes
    share, nothing = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2), np.zeros(0)
    plain = Model(float(np.log(share / (1 - share))), nothing.astype(np.int64), nothing, np.zeros((0, rank)))
    if not positive or positive == len(labels):
        return plain
    docs, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r, y in zip(rows, labels):
        docs[r] += 1
        toxic[r] += y
    ids = np.flatnonzero(docs)
    docs, toxic = docs[ids], toxic[ids]
    share, rest = docs / len(labels), len(labels) - positive
    error = np.sqrt(share * (1 - share) * (1 / positive + 1 / rest)) + 1e-9
    z = np.abs(toxic / positive - (docs - toxic) / rest) / error
    ids = np.sort(ids[np.argsort(-z, kind="stable")[:most]][: int((z > deviates).sum())])
    if not len(ids):
        return plain
    cols = [np.searchsorted(ids, r[np.isin(r, ids, assume_unique=True)]) for r in rows]
    n = len(ids)
    bias, w, v = 0.0, np.zeros(n), rng.normal(0, 0.01, (n, rank))
    moments = [np.zeros_like(x) for x in (w, w, v, v)]
    b1 = b2 = 0.0
    weight = np.where(labels == 1, len(labels) / (2 * positive), len(labels) / (2 * (len(labels) - positive)))
    step = 0
    for _ in range(max(epochs, math.ceil(steps * batch / len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            sizes = np.fromiter((len(cols[i]) for i in own), np.int64, len(own))
            index, doc = np.concatenate([cols[i] for i in own]), np.repeat(np.arange(len(own)), sizes)
            vi = v[index]
            sums = np.stack([np.bincount(doc, vi[:, f], len(own)) for f in range(rank)], axis=1)
            squares = np.bincount(doc, (vi**2).sum(axis=1), len(own))
            z = bias + np.bincount(doc, w[index], len(own)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) * weight[own] / len(own)
            gw = np.bincount(index, g[doc], n)
            gv = np.stack([np.bincount(index, g[doc] * (sums[doc, f] - vi[:, f]), n) for f in range(rank)], axis=1)
            gw += shrink * w / n
            gv += shrink * v / n
            step += 1
            for x, grad, m, s in ((w, gw, moments[0], moments[1]), (v, gv, moments[2], moments[3])):
                m += 0.1 * (grad - m)
                s += 0.001 * (grad**2 - s)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)
            gb = float(g.sum())
            b1, b2 = b1 + 0.1 * (gb - b1), b2 + 0.001 * (gb**2 - b2)
            bias -= rate * (b1 / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.999**step)) + 1e-6)
    return Model(bias, ids, w, v)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from at most ``per_class`` labelled documents of each class outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t).astype(np.int32) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(found, pa.list_(pa.int32()))],
                ["doc_id", "label", "terms"],
            )

    rows, sizes = training_rows(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels, "toxic", per_class)
    found = rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, terms array<int>")
    # Of rows that share an id one comes to the driver.
    one = F.min(F.struct("label", "terms")).alias("one")
    found = found.groupBy("doc_id").agg(one).select("doc_id", "one.label", "one.terms").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    flat = found.column("terms").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    values, ends = flat.values.to_numpy(), flat.offsets.to_numpy()
    y = found.column("label").to_numpy()
    return fit([values[ends[i] : ends[i + 1]] for i in order], y[order], sizes=sizes)


#: The words this Python worker has seen, for the model it uses.
_SEEN: dict[str, _Positions] = {}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the score of each row; a column ``score`` is replaced.

    Only ``text`` is read; a null or empty text has the score of the bias alone.
    """
    kept = docs.drop("score")
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        model = broadcast.value
        if model.id not in _SEEN:
            _SEEN.clear()
            _SEEN[model.id] = _Positions(model)
        z = np.array([model.logit(t, _SEEN[model.id]) for t in text], dtype=float)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return kept.withColumn("score", of(F.coalesce("text", F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with ``score`` (toxic likelier when higher), by a model learned from ``labels``."""
    return score(docs, train(docs, labels, per_class))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those scored at or above ``threshold``.

    Where the labels teach nothing (none, one class only, or no term that tells the classes apart)
    no document is known to be toxic, and all stay.
    """
    model = train(docs, labels)
    if not model.learned:
        return docs
    scored = score(docs.withColumn("__kept", F.col("score")) if "score" in docs.columns else docs, model)
    clean = scored.where(F.col("score") < threshold)
    return clean.drop("score").withColumnRenamed("__kept", "score").select(*docs.columns)


def op9_toxicity(spark, sf_dir) -> DataFrame:
    """Scores of all ``documents``; null and empty texts have the score of the bias alone.

    ``predicted`` follows the score even where the labels teach nothing and every score is the share
    of toxic labels; :func:`drop_toxic` keeps all documents then.
    """
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels"))).select(
        "doc_id",
        held_out("doc_id", FOLDS, HELD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
