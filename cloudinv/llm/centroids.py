"""Centroid clustering in whole numbers, with lower bounds from Ptolemy's inequality.

A few pivots are fixed at the start, and every vector keeps its distances to them. For pivots p, s
and any x, c: d(x, c) d(p, s) >= |d(x, p) d(c, s) - d(x, s) d(c, p)|. So the distance to a centroid is
bounded from below by cached numbers alone, for each pair of pivots. The bounds are rounded down,
and a centroid whose bound does not exceed the best distance found is checked exactly.

Vectors are written once with their cached distances and never shuffled; a round is one scan
that adds up each task's sums by cluster.
"""

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudinv.llm.common import read, stored
from cloudinv.llm.vectors import finite, whole

SCALE = 1024.0
DIM = 64
CLUSTERS, ROUNDS, SEED = 8, 10, 3
#: Pivots, taken far apart from so many vectors with the least hashes.
PIVOTS, SAMPLE = 6, 2048
#: Doubles carry 53 bits; a bound is lowered by far more than a few roundings can add to it.
SLACK = 2.0**-44
#: Squared distances of components below this fit 64 bits, others are Python numbers.
SMALL = 2**27


def squares(cells: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a point, in 64 bits where they fit."""
    most = max(int(x.max(initial=0)) - min(0, int(x.min(initial=0))) for x in (cells, point))
    if most >= SMALL:
        cells, point = cells.astype(object), point.astype(object)
    away = cells - point
    return (away * away).sum(axis=1)


def _root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


def spread(cells: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` unlike rows, each the farthest from those before it."""
    picked: list[int] = []
    near = None
    for _ in range(min(count, len(cells))):
        at = 0 if near is None else int(np.argmax(near))
        if near is not None and near[at] == 0:
            break
        picked.append(at)
        away = squares(cells, cells[at])
        near = away if near is None else np.minimum(near, away)
    return cells[picked]


class Pivots:
    """Fixed points, and the distances of every pair of them."""

    def __init__(self, points: np.ndarray):
        self.points = points
        away = self.distances(points)
        self.pairs = [(i, j, away[i, j]) for i, j in itertools.combinations(range(len(points)), 2)]

    def distances(self, cells: np.ndarray) -> np.ndarray:
        columns = [_root(squares(cells, p)) for p in self.points]
        return np.stack(columns, axis=1) if columns else np.zeros((len(cells), 0))

    def bounds(self, cached: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Squared lower bounds of vectors (rows) to centroids (columns), rounded down."""
        own = self.distances(centroids)
        least = np.zeros((len(cached), len(centroids)))
        for i, j, apart in self.pairs:
            one, two = cached[:, i, None] * own[None, :, j], cached[:, j, None] * own[None, :, i]
            gap = np.abs(one - two) - (one + two) * SLACK
            np.maximum(least, gap / (apart * (1 + SLACK)), out=least)
        return least * least * (1 - SLACK)


def assign(
    cells: np.ndarray, cached: np.ndarray, pivots: Pivots, centroids: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance, centroids checked exactly) of each vector; ties to the smaller number."""
    least = pivots.bounds(cached, centroids)
    cluster = least.argmin(axis=1)
    checked = np.ones(len(cells), np.int64)
    best = np.zeros(len(cells), object)
    for c in range(len(centroids)):
        rows = np.flatnonzero(cluster == c)
        best[rows] = squares(cells[rows], centroids[c])
    if all(int(b) < 2**62 for b in best):
        best = best.astype(np.int64)
    tried = cluster.copy()
    for c in range(len(centroids)):
        # Only a bound above the best distance rules a centroid out, so that ties are seen.
        rows = np.flatnonzero((tried != c) & (least[:, c] <= best.astype(np.float64) * (1 + SLACK)))
        checked[rows] += 1
        away = squares(cells[rows], centroids[c])
        better = (away < best[rows]) | ((away == best[rows]) & (c < cluster[rows]))
        if away.dtype == object:
            best = best.astype(object)
        best[rows[better]], cluster[rows[better]] = away[better], c
    return cluster, best, checked


def _arrow(columns, names, kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _floats(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM,
    n_pivots: int = PIVOTS,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_checked for each kept vector.

    Kept are vectors with exactly ``dim`` components, none null or non-finite; other columns than
    ``vec_id`` and ``embedding`` are not read. Components become floor(1024 x). The first centroids
    are the vectors with the smallest sha256 of ``seed:vec_id``. Each round assigns every vector to
    the nearest centroid (squared Euclidean distance, ties to the smaller number) and replaces a
    centroid by floor(sum / count) of its vectors; a centroid without vectors stays. After the
    rounds vectors are assigned once more, which the columns show. ``n_checked`` counts centroids
    whose distance was computed for the vector, the others were ruled out by their bounds.

    Repeated rows count each; of rows with one id the smaller vector comes first as a centroid. Rows
    with a null id are clustered too, and come last as centroids. Fewer vectors than ``clusters``
    give fewer centroids, none give no rows. A component or distance beyond a long is an error.
    """
    spark = vectors.sparkSession
    kept = vectors.where(finite() & (F.size("embedding") == dim)).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")
    )
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), "embedding").limit(max(clusters, SAMPLE)).toArrow()
    sample = whole(first.column("embedding").combine_chunks(), SCALE)[0].reshape(-1, dim)
    centroids, pivots = sample[:clusters].copy(), Pivots(spread(sample, n_pivots))
    width = len(pivots.points)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = whole(batch.column(1), SCALE)[0].reshape(-1, dim)
            cached = pivots.distances(cells)
            columns = batch.column(0), [r.tobytes() for r in cells], [r.tobytes() for r in cached]
            yield _arrow(columns, ["vec_id", "cells", "cached"], (pa.int64(), pa.binary(), pa.binary()))

    table = stored(kept.mapInArrow(prepare, "vec_id long, cells binary, cached binary"), "vectors")

    def assigned(batch: pa.RecordBatch, points: np.ndarray):
        cells = _floats(batch.column("cells"), dim, "<i8")
        return cells, *assign(cells, _floats(batch.column("cached"), width, "<f8"), pivots, points)

    def moved(points: np.ndarray) -> np.ndarray:
        """The centroids after one round."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(points), dim + 1), object)
            for batch in batches:
                cells, own, *_ = assigned(batch, points)
                if np.abs(cells).max(initial=0) >= SMALL:
                    cells = cells.astype(object)
                for c in np.unique(own):
                    rows = cells[own == c]
                    sums[c] += np.array([*(int(x) for x in rows.sum(axis=0)), len(rows)], object)
            c, i = np.nonzero(sums)
            total = pa.array([int(x) for x in sums[c, i]], pa.decimal128(38, 0))
            yield _arrow((c, i, total), ["cluster", "i", "total"], (pa.int32(), pa.int32(), total.type))

        sums = table.mapInArrow(run, "cluster int, i int, total decimal(38,0)")
        # One row for each cluster and component comes back.
        sums = {(r["cluster"], r["i"]): int(r["s"]) for r in sums.groupBy("cluster", "i").agg(F.sum("total").alias("s")).collect()}
        new = points.copy()
        for c in range(len(points)):
            if n := sums.get((c, dim)):
                new[c] = [sums.get((c, i), 0) // n for i in range(dim)]
        return new

    for _ in range(rounds):
        if not len(centroids):
            break
        after = moved(centroids)
        if (after == centroids).all():
            break  # Every later round gives the same.
        centroids = after

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(centroids):
                _, own, away, checked = assigned(batch, centroids)
                if any(int(a) >= 2**63 for a in away):
                    raise OverflowError("a squared distance does not fit a long")
                columns = batch.column("vec_id"), own, away.astype(np.int64), checked
                yield _arrow(columns, ["vec_id", "cluster", "distance", "n_checked"], (pa.int64(), pa.int32(), pa.int64(), pa.int64()))

    rows = stored(table.mapInArrow(last, "vec_id long, cluster int, distance long, n_checked long"), "clustered")
    parts = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = sum(int(r["s"]) for r in parts)
    if inertia >= 2**63:
        raise OverflowError("the inertia does not fit a long")
    digest = lambda c: hashlib.sha256(",".join(str(int(x)) for x in centroids[c]).encode()).hexdigest()
    facts = spark.createDataFrame(
        [(r["cluster"], int(r["s"]), inertia, digest(r["cluster"])) for r in parts],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # One row for each cluster.
    return rows.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_checked"
    )


def op13_ptolemaic_clusters(spark, sf_dir) -> DataFrame:
    """The clusters of all ``embeddings``; see :func:`cluster`, also for null, repeated and too few rows."""
    return cluster(read(spark, sf_dir, "embeddings")).drop("n_checked")


def _oracle() -> str:
    """Round after round as tables of one statement."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE len(embedding) = {DIM} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (
  SELECT * FROM (
    SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept)
  WHERE c < {CLUSTERS})"""]
    for n in range(ROUNDS + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT k.row, min(CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(k.v, c.v)]) AS HUGEINT) * {CLUSTERS} + c.c) AS best
  FROM kept k CROSS JOIN c{n} c GROUP BY k.row)""")
        if n < ROUNDS:
            steps.append(f"""
c{n + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
    SELECT c, list(x ORDER BY i) AS v FROM (
      SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
        SELECT a.best % {CLUSTERS} AS c, i, sum(k.v[i]) AS s, count(*) AS n
        FROM a{n} a JOIN kept k ON a.row = k.row CROSS JOIN range(1, {DIM + 1}) t(i) GROUP BY ALL))
    GROUP BY c) m ON c.c = m.c)""")
    return f"""
WITH {",".join(steps)}
SELECT k.vec_id, CAST(a.best % {CLUSTERS} AS INTEGER) AS cluster, CAST(a.best // {CLUSTERS} AS BIGINT) AS distance,
       CAST(sum(a.best // {CLUSTERS}) OVER (PARTITION BY a.best % {CLUSTERS}) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.best // {CLUSTERS}) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN kept k ON a.row = k.row JOIN c{ROUNDS} c ON a.best % {CLUSTERS} = c.c
"""


ORACLE = _oracle()
