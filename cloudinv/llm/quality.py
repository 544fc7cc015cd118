"""Text quality by the votes of the nearest labelled documents in a latent-semantic space.

Documents become vectors of hashed words and of word shapes (``a``, ``A.``, ``a%``, ``|``, and a
mark for a word that repeats the one before). A truncated singular value decomposition of a
bounded labelled sample gives the latent space. The labelled vectors are broadcast, and every
document is compared with all of them, block by block.
"""

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudinv.llm.common import held_out, read, texts
from cloudinv.llm.labelled import FOLDS, HELD, training_rows

WORDS, SHAPES = 4096, 1024
SIZE = WORDS + SHAPES
REPEAT = SIZE - 1
RANK = 96
PER_CLASS = 2048
NEIGHBOURS = 15
POWER = 8
#: How much of a vector's length the shapes have, and the words.
SHAPE_PART, WORD_PART = 0.9, 0.4359
BLOCK = 256
THRESHOLD = 0.3

_CLASS = np.array([ord("x")] * 256, np.uint8)
_CLASS[[*range(33, 127)]] = [*range(33, 127)]
_CLASS[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = ord("a")
_CLASS[[*range(ord("A"), ord("Z") + 1)]] = ord("A")
_CLASS[[*range(ord("0"), ord("9") + 1)]] = ord("0")
_TABLE = _CLASS.tobytes()


def shape(word: bytes) -> bytes:
    """Letters as ``a`` or ``A``, digits as ``0``, other characters themselves; runs count once."""
    kinds = word[:64].translate(_TABLE)
    return bytes(c for i, c in enumerate(kinds) if not i or kinds[i - 1] != c)


class _Buckets(dict):
    """Word -> bucket of the word, bucket of its shape, as one number."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        w = xxhash.xxh64_intdigest(word.lower()) % WORDS
        s = xxhash.xxh64_intdigest(shape(word)) % (SHAPES - 1)
        found = self[word] = w * SHAPES + s
        return found


_BUCKETS = _Buckets()


def counts(text: str) -> np.ndarray:
    """How often each word bucket and shape bucket occurs, and how many words repeat the last."""
    words = text.encode("utf-8", "surrogatepass").split()
    both = np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, len(words))
    out = np.zeros(SIZE, np.float32)
    out[:WORDS] = np.bincount(both // SHAPES, minlength=WORDS)
    out[WORDS:] = np.bincount(both % SHAPES, minlength=SHAPES)
    out[REPEAT] = np.count_nonzero(both[1:] == both[:-1])
    return out


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as vectors: weighted words, and square roots of the shapes' shares."""
    w = np.log1p(found[:, :WORDS]) * idf
    s = np.sqrt(found[:, WORDS:] / np.maximum(1, found[:, WORDS:-1].sum(axis=1, keepdims=True)))
    w *= WORD_PART / np.maximum(1e-9, np.linalg.norm(w, axis=1, keepdims=True))
    s *= SHAPE_PART / np.maximum(1e-9, np.linalg.norm(s, axis=1, keepdims=True))
    return np.concatenate([w, s], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))


@dataclass
class Model:
    """Bounded by its parameters: SIZE x RANK and 2 PER_CLASS x RANK numbers."""

    idf: np.ndarray
    axes: np.ndarray
    points: np.ndarray
    labels: np.ndarray
    weights: np.ndarray  # documents of its class that a point stands for
    prior: float
    id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scores(self, found: np.ndarray) -> np.ndarray:
        """Share of the neighbours' votes for label 1; the prior where nothing is alike."""
        if not len(self.points):
            return np.full(len(found), self.prior)
        like = _unit(vectors(found, self.idf) @ self.axes) @ self.points.T
        k = min(NEIGHBOURS, like.shape[1])
        near = np.argpartition(-like, k - 1, axis=1)[:, :k] if k < like.shape[1] else np.tile(np.arange(k), (len(like), 1))
        votes = np.maximum(0, np.take_along_axis(like, near, 1)).astype(np.float64) ** POWER * self.weights[near]
        total = votes.sum(axis=1)
        given = (votes * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.where(total > 0, np.clip(given, 0, 1), self.prior)


def fit(found: np.ndarray, labels: np.ndarray, sizes: dict[int, int], rank: int = RANK) -> Model:
    """Latent space and neighbours from rows of counts; no rows give a score of a half."""
    everything = sum(sizes.values())
    prior = (sizes.get(1, 0) + 1) / (everything + 2)
    n, rng = len(found), np.random.default_rng(0)
    idf = np.log((n + 1) / ((found[:, :WORDS] > 0).sum(axis=0) + 1)).astype(np.float32) + 0.1
    x = vectors(found, idf)
    rank = min(rank, n)
    if not rank:
        return Model(idf, np.zeros((SIZE, 0), np.float32), x[:, :0], labels, labels, prior)
    # Randomised range finder with two rounds of subspace iteration.
    q = np.linalg.qr(x @ rng.standard_normal((SIZE, rank + 8), dtype=np.float32))[0]
    for _ in range(2):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)
    held = np.bincount(labels, minlength=2)
    weights = np.array([sizes.get(c, 0) / max(1, held[c]) for c in (0, 1)])[labels]
    return Model(idf, axes, _unit(x @ axes), labels, weights, prior)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from at most ``per_class`` labelled documents of each class outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, value = texts(batch, "text"), [], []
            for t in rows:
                c = counts(t)
                index.append(np.flatnonzero(c).astype(np.int32))
                value.append(c[index[-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(index, pa.list_(pa.int32())),
                 pa.array(value, pa.list_(pa.float32()))],
                ["doc_id", "label", "at", "n"],
            )

    rows, sizes = training_rows(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels, "quality", per_class)
    got = rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, at array<int>, n array<float>")
    got = got.dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    found = np.zeros((got.num_rows, SIZE), np.float32)
    row = 0
    for batch in got.to_batches():
        for at, n in zip(batch.column("at"), batch.column("n")):
            found[row, at.values.to_numpy()] = n.values.to_numpy()
            row += 1
    return fit(found, got.column("label").to_numpy().astype(np.int64), sizes)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the score of each row; a column ``score`` is replaced.

    Only ``text`` is read; a null or empty text has the score of the prior.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        out = [np.zeros(0)]
        for at in range(0, len(text), BLOCK):
            found = np.stack([counts(t) for t in text.iloc[at : at + BLOCK]])
            own = broadcast.value.scores(found)
            out.append(np.where(found.any(axis=1), own, broadcast.value.prior))
        return pd.Series(np.concatenate(out))

    return docs.drop("score").withColumn("score", of(F.coalesce("text", F.lit(""))))


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with ``score`` (label 1 likelier when higher), learned from ``labels.quality``."""
    return score(docs, train(docs, labels, per_class))


def op2_quality_votes(spark, sf_dir) -> DataFrame:
    found = quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select(
        "doc_id",
        held_out("doc_id", FOLDS, HELD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
