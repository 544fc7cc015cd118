"""Hard negatives: for each anchor and each of its positives, wrong-label rows that score nearly as high.

Vectors lie in blocks of bounded size, and so do the anchors. Every block of anchors meets every
block of vectors, as an equi-join of block rows. The scores of a pair of blocks are one matrix
product by Strassen's recursion over 64-bit integers. Each anchor keeps a heap of its best
positives; heaps of several blocks merge into one. In a second pass each positive's score opens a
window, and a heap for each window keeps the best negatives in it.

A pair of blocks ships some 8 MB and asks for 8192 x 8192 inner products, so the shuffle is small
beside the arithmetic, however many pairs there are.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudinv.llm.common import read, stored
from cloudinv.llm.vectors import BLOCK, finite, packed, unpacked

SCALE = 256.0
EVERY = 100
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 80, 100
#: Vectors of one block, and anchors and vectors of one tile of it.
SIZE, ROWS, COLUMNS = 8192, 512, 2048
#: Strassen's recursion ends at this side of a tile.
LEAF = 16


def _even(n: int, depth: int) -> int:
    return -(-n // 2**depth) * 2**depth


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of whole numbers by Strassen's seven products, padded with zeros to halve evenly.

    64-bit sums wrap around, which loses nothing: results that fit 64 bits are exact whatever the
    sums on the way were.
    """
    (m, d), n = a.shape, b.shape[1]
    depth = 0
    while min(m, d, n) > leaf * 2**depth:
        depth += 1
    left = np.zeros((_even(m, depth), _even(d, depth)), a.dtype)
    right = np.zeros((_even(d, depth), _even(n, depth)), b.dtype)
    left[:m, :d], right[:d, :n] = a, b
    return _seven(left, right, depth)[:m, :n]


def _seven(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if not depth:
        return a @ b
    quarter = lambda x: [x[i : i + x.shape[0] // 2, j : j + x.shape[1] // 2]
                         for i in (0, x.shape[0] // 2) for j in (0, x.shape[1] // 2)]
    (a11, a12, a21, a22), (b11, b12, b21, b22) = quarter(a), quarter(b)
    pairs = [
        (a11 + a22, b11 + b22), (a21 + a22, b11), (a11, b12 - b22), (a22, b21 - b11),
        (a11 + a12, b22), (a21 - a11, b11 + b12), (a12 - a22, b21 + b22),
    ]
    p = [_seven(x, y, depth - 1) for x, y in pairs]
    return np.block([[p[0] + p[3] - p[4] + p[6], p[2] + p[4]], [p[1] + p[3], p[0] - p[1] + p[2] + p[5]]])


def scores(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit numbers; one that does not fit is an error."""
    most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (anchors, vectors)]
    if most[0] * most[1] * max(1, anchors.shape[1]) < 2**63:
        return strassen(anchors, vectors.T)
    found = strassen(anchors.astype(object), vectors.T.astype(object))
    if any(not -(2**63) <= int(x) < 2**63 for x in found.flat):
        raise OverflowError("an inner product does not fit a long")
    return found.astype(np.int64)


class Heap:
    """The ``k`` best of what was pushed: highest score first, ties by smaller id. Heaps merge."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def push(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(self.id) == self.k:
            # Equal scores may still have a smaller id.
            hopeful = score >= self.score[-1]
            score, ids = score[hopeful], ids[hopeful]
        if len(score) > 4 * self.k:
            near = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[near], ids[near]
        if len(ids):
            score, ids = np.concatenate((self.score, score)), np.concatenate((self.id, ids))
            best = np.lexsort((ids, ~score))[: self.k]
            self.score, self.id = score[best], ids[best]

    def merge(self, other: "Heap") -> None:
        self.push(other.score, other.id)


def _tiles(anchors: np.ndarray, vectors: np.ndarray):
    """(rows, columns, scores) tile by tile."""
    for i in range(0, len(anchors), ROWS):
        for j in range(0, len(vectors), COLUMNS):
            yield range(i, min(i + ROWS, len(anchors))), slice(j, j + COLUMNS), scores(
                anchors[i : i + ROWS], vectors[j : j + COLUMNS]
            )


def _positives(k: int, anchors, vectors) -> tuple:
    """(place, 0, id, score) of each anchor's best rows of its own label."""
    (own, label, a), (ids, labels, v) = anchors, vectors
    held = {}
    mine = np.flatnonzero(np.isin(label, labels))
    for rows, part, s in _tiles(a[mine], v):
        for at, row in enumerate(rows):
            place = int(mine[row])
            fit = np.flatnonzero((labels[part] == label[place]) & (ids[part] != own[place]))
            held.setdefault((place, 0), Heap(k)).push(s[at, fit], ids[part][fit])
    return _rows(held)


def _negatives(k: int, low: int, high: int, anchors, vectors, windows) -> tuple:
    """(place, rank of the positive, id, score) of the best rows of other labels in each window.

    ``windows`` has (place, rank of the positive, positive's score).
    """
    (own, label, a), (ids, labels, v) = anchors, vectors
    opened: dict[int, list] = {}
    for place, rank, score in windows:
        # Whole-number bounds of low * score <= 100 * x <= high * score.
        least, most = -(-low * score // 100), high * score // 100
        if least <= most:
            opened.setdefault(place, []).append((rank, least, most))
    held = {}
    mine = np.array(sorted(opened), np.int64)
    for rows, part, s in _tiles(a[mine], v):
        for at, row in enumerate(rows):
            place = int(mine[row])
            here = s[at]
            fit = (labels[part] != label[place]) & (ids[part] != own[place])
            for rank, least, most in opened[place]:
                inside = np.flatnonzero(fit & (here >= least) & (here <= most))
                if len(inside):
                    held.setdefault((place, rank), Heap(k)).push(here[inside], ids[part][inside])
    return _rows(held)


def _rows(held: dict) -> tuple:
    """place, rank, id, score as arrays."""
    sizes = [len(h.id) for h in held.values()]
    keys = np.repeat(np.array(list(held), np.int64).reshape(-1, 2), sizes, axis=0)
    join = lambda name: np.concatenate([np.zeros(0, np.int64), *(getattr(h, name) for h in held.values())])
    return keys[:, 0], keys[:, 1], join("id"), join("score")


def _blocks(rows: DataFrame, size: int, label: str) -> tuple[DataFrame, int]:
    """Rows dealt evenly by a hash, whatever ids repeat, packed and stored; and how many blocks there are."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.repartition(n, F.xxhash64("vec_id", F.monotonically_increasing_id()))
    blocks = stored(packed(dealt.sortWithinPartitions(F.size("embedding")), SCALE, size), label)
    return blocks, max(1, blocks.count())


def _met(anchors: DataFrame, vectors: DataFrame, n_anchors: int, n_vectors: int) -> DataFrame:
    """Every block of anchors beside every block of vectors; each pair of buckets is a key of its own."""
    bucket = lambda n: F.pmod(F.xxhash64("part"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    right = vectors.select(
        *[F.col(c).alias(f"v_{c}") for c in vectors.columns], bucket(n_vectors).alias("v"), every(n_anchors).alias("a")
    )
    left = anchors.select("*", bucket(n_anchors).alias("a"), every(n_vectors).alias("v"))
    return left.join(right, ["a", "v"]).where("dim = v_dim")


_FOUND = "part long, place long, at long, id long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    """The heaps of all blocks merged: ``rank`` from 1."""
    order = Window.partitionBy("part", "place", "at").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, size: int = SIZE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Both inputs have ``vec_id``, ``label`` and ``embedding``; other columns are not read. The score
    is the integer inner product of floor(256 x). An anchor's positives are its ``positives`` best
    rows of the same label; the negatives of each are the ``negatives`` best rows of another label
    whose score lies between ``low`` and ``high`` hundredths of the positive's. Ties go to the
    smaller vec_id. Rows with a null id, label or vector or with a null or non-finite component
    take no part. Vectors of unlike length do not meet; those without components score 0. Rows with
    the anchor's own id are neither its positives nor its negatives. Repeated rows count each,
    repeated anchors have rows each. No positives or no negatives give no rows. A component or
    score beyond a long is an error.
    """
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite()
    columns = F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")
    rows, n_rows = _blocks(vectors.where(usable).select(*columns), size, "vectors")
    asked, n_asked = _blocks(anchors.where(usable).select(*columns), size, "anchors")
    inputs = [f.split()[0] for f in BLOCK.split(", ")]

    def run(search, extra: tuple[str, ...] = ()):
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, dim, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                    here = search(unpacked(dim, *rest[:3]), unpacked(dim, *rest[3:6]), *rest[6:])
                    columns = (np.full(len(here[0]), part), *here)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in _FOUND.split(", ")]
                    )

        def found(left: DataFrame) -> DataFrame:
            pairs = _met(left, rows, n_asked, n_rows)
            return pairs.select(*inputs, "v_ids", "v_labels", "v_cells", *extra).mapInArrow(over, _FOUND)

        return found

    own = _best(run(lambda a, v: _positives(positives, a, v))(asked), positives)
    own = stored(own.select("part", "place", F.col("rank").cast("long").alias("at"), "id", "score"), "positives")
    # At most ``positives`` windows for each anchor of a block.
    windows = own.groupBy("part").agg(F.collect_list(F.struct("place", "at", "score")).alias("windows"))
    search = lambda a, v, windows: _negatives(
        negatives, low, high, a, v, [(w["place"], w["at"], w["score"]) for w in windows]
    )
    opened = stored(asked.join(windows, "part"), "windows")
    best = _best(run(search, ("windows",))(opened), negatives)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(data, "<i8")
                columns = np.full(len(own), part), np.arange(len(own)), own
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "place", "anchor_id"])

    named = asked.select("part", "ids").mapInArrow(ids, "part long, place long, anchor_id long")
    positive = own.select("part", "place", "at", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.join(positive, ["part", "place", "at"]).join(named, ["part", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def op11_hard_negatives(spark, sf_dir) -> DataFrame:
    """Negatives of the anchors, rows whose id a hundred divides; see :func:`mine`.

    Every seventh id has its label moved on by one before. Null ids, labels and vectors take no part.
    """
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return mine(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
anchors AS (SELECT *, row_number() OVER () AS anchor FROM good WHERE vec_id % 100 = 0),
scored AS (
  SELECT a.anchor, a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
         CAST(coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(a.v, c.v)]), 0) AS BIGINT) AS score
  FROM anchors a JOIN good c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
positives AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM scored WHERE same)
  WHERE place <= 5),
negatives AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, n.id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same
  WHERE 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5
"""
