"""Exact top-k by inner product with Fagin's threshold algorithm, in blocks.

Vectors are packed into blocks of bounded size by the nearest of a few sampled pivots, so that what
a block holds is alike; so are the queries. Within a block each dimension has its list of vectors in
sorted order. A query reads each list from the end that its component rewards, to equal depths, and
scores each vector it meets for the first time (random access). Its threshold is the best score that
a vector not met yet could have: the sum over dimensions of its component times the list's next
value. It stops when the threshold is below its k-th score.

The k-th score is known early: each block of queries first meets one block of its own pivot. That
gives every query a floor. The thresholds at depth zero, from the ends of all lists, then tell which
queries a block of vectors can still serve; only those queries and blocks are shipped.
"""

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudinv.llm.common import read, stored
from cloudinv.llm.vectors import finite, whole

SCALE = 64.0
K = 20
EVERY = 20
#: Vectors of one block, queries of one block, and most components of a block of either.
BLOCK, QUERIES, CELLS = 8192, 2048, 1 << 19
#: Most pivots, and blocks whose bounds are looked at together.
PIVOTS, TOGETHER = 256, 256
#: Entries read of each list in the first round; each round reads twice as deep.
FIRST = 8
#: Share of a block from which a query that has met it scores the rest at once: reading on would cost more.
ENOUGH = 0.25
EXACT = 2.0**53
#: The floor of a query of which no k scores are known.
NO_FLOOR = -(2**63)


def assigned(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, embedding, ``home`` (the nearest pivot of its length, or -1), and ``turn``, which deals rows evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            column = batch.column(1)
            dims = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims) - dims
            home = np.full(len(dims), -1, np.int32)
            for dim in np.unique(dims).tolist():
                if dim in pivots:
                    own, points = np.flatnonzero(dims == dim), pivots[dim]
                    with np.errstate(all="ignore"):
                        near = flat[starts[own][:, None] + np.arange(dim)] @ points.T - (points**2).sum(axis=1) / 2
                    home[own] = near.argmax(axis=1)
            turns = turn + np.arange(len(dims), dtype=np.int64)
            turn += len(dims)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), column, pa.array(home), pa.array(turns)], ["vec_id", "embedding", "home", "turn"]
            )

    return vectors.select("vec_id", "embedding").mapInArrow(
        run, "vec_id long, embedding array<double>, home int, turn long"
    )


def packed(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """Blocks of at most ``size`` rows of :func:`assigned` with one home and one length.

    A row has the block's number, home, length, ids, components, and each list's highest and lowest
    value, all as 64-bit numbers. A home with more rows is dealt over as many tasks as it has blocks.
    A task holds one open block.
    """
    names = [prefix + n for n in ("block", "home", "dim", "ids", "cells", "high", "low")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count, key = TaskContext.get().partitionId() << 32, [], 0, None

        def out():
            ids, cells = (np.concatenate(x).astype("<i8") for x in zip(*held))
            cells = cells.reshape(len(ids), key[2])
            binary = [pa.array([x.tobytes()], pa.binary()) for x in (ids, cells, cells.max(axis=0), cells.min(axis=0))]
            first = [pa.array([x], t) for x, t in ((number, pa.int64()), (key[0], pa.int32()), (key[2], pa.int32()))]
            return pa.RecordBatch.from_arrays(first + binary, names)

        for batch in batches:
            homes, parts, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cells, starts = whole(batch.column(3), SCALE)
            dims = np.diff(starts)
            edge = np.flatnonzero((homes[1:] != homes[:-1]) | (parts[1:] != parts[:-1]) | (dims[1:] != dims[:-1])) + 1
            for at, end in zip([0, *edge.tolist()], [*edge.tolist(), len(ids)]):
                while at < end:
                    own = int(homes[at]), int(parts[at]), int(dims[at])
                    most = max(1, min(size, CELLS // own[2]))
                    if held and (own != key or count >= most):
                        yield out()
                        number, held, count = number + 1, [], 0
                    key, to = own, min(end, at + most - count)
                    held.append((ids[at:to], cells[starts[at] : starts[to]]))
                    count, at = count + to - at, to
        if held:
            yield out()

    # At most one row for each pivot.
    parts = rows.groupBy("home").agg(F.ceil(F.count("*") / size).cast("long").alias("parts"))
    dealt = rows.join(F.broadcast(parts), "home").withColumn("part", F.col("turn") % F.col("parts"))
    ordered = dealt.repartition("home", "part").sortWithinPartitions("home", "part", F.size("embedding"))
    kinds = ("long", "int", "int", "binary", "binary", "binary", "binary")
    return ordered.select("home", "part", "vec_id", "embedding").mapInArrow(
        run, ", ".join(f"{n} {t}" for n, t in zip(names, kinds))
    )


def _numbers(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, dim)


def _kind(a: np.ndarray, b: np.ndarray, dim: int):
    """Doubles where all sums of products are exact in them, Python's numbers where not."""
    most = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    return np.float64 if most(a) * most(b) * max(1, dim) < EXACT else object


def thresholds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The best score that each query could have with components between ``low`` and ``high``."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class Block:
    """Vectors of one length, with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray):
        self.ids, self.cells = ids, cells
        self.order = np.argsort(cells, axis=0, kind="stable")
        self.sorted = np.take_along_axis(cells, self.order, 0)
        #: Pairs of a query and a vector that were scored.
        self.scored = 0

    def top(
        self, own: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, vector id, score) of each query's k best here, but for vectors with its own id.

        Vectors scored below a query's floor may be left out.
        """
        n, dims = self.cells.shape
        kind = _kind(queries, self.cells, dims)
        q, cells = queries.astype(kind), self.cells.astype(kind)
        least = np.full(len(q), NO_FLOOR) if floors is None else floors.copy()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
        met, depth = np.zeros((len(q), n), bool), 0
        # A tie could still have a smaller id, so equal bounds go on.
        alive = np.flatnonzero(self._threshold(q, 0) >= least)

        def take(i, rows, scores):
            self.scored += len(rows)
            best[i] = self._better(best[i], rows, scores, own[i], k, least[i])
            if len(best[i][1]) == k:
                least[i] = max(least[i], best[i][1].min())

        while len(alive):
            to = min(n, max(FIRST, 2 * depth))
            upper, lower = self.order[n - to : n - depth], self.order[depth:to]
            rest = []
            for i in alive.tolist():
                new = np.zeros(n, bool)
                new[upper[:, q[i] > 0]] = new[lower[:, q[i] < 0]] = True
                new &= ~met[i]
                if to == n or met[i].sum() + new.sum() > ENOUGH * n:
                    rest.append(i)
                    continue
                met[i] |= new
                rows = np.flatnonzero(new)
                take(i, rows, cells[rows] @ q[i])
            for at in range(0, len(rest), 256):
                some = rest[at : at + 256]
                for i, scores in zip(some, q[some] @ cells.T):
                    rows = np.flatnonzero(~met[i])
                    take(i, rows, scores[rows])
            alive, depth = np.setdiff1d(alive, rest), to
            alive = alive[self._threshold(q[alive], depth) >= least[alive]] if len(alive) else alive
        sizes = [len(b[0]) for b in best]
        who = np.repeat(np.arange(len(q)), sizes)
        rows = np.concatenate([b[0] for b in best]) if len(q) else np.zeros(0, np.int64)
        score = np.concatenate([b[1] for b in best]) if len(q) else np.zeros(0, np.int64)
        return who, self.ids[rows], score

    def _threshold(self, q: np.ndarray, depth: int) -> np.ndarray:
        """Each query's threshold when ``depth`` entries of its lists are read."""
        high, low = self.sorted[len(self.sorted) - 1 - depth], self.sorted[depth]
        return thresholds(q, high.astype(q.dtype), low.astype(q.dtype))

    def _better(self, best, rows, scores, own, k, least):
        keep = (self.ids[rows] != own) & (scores >= least).astype(bool)
        rows, scores = rows[keep], scores[keep]
        if not len(rows):
            return best
        exact = scores.dtype != object
        if exact and len(rows) > 4 * k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= cut], scores[scores >= cut]
        scores = scores.astype(np.int64) if exact else np.array([_long(x) for x in scores], np.int64)
        rows, scores = np.concatenate((best[0], rows)), np.concatenate((best[1], scores))
        # ~x orders as -x does, and has no overflow.
        first = np.lexsort((self.ids[rows], ~scores))[:k]
        return rows[first], scores[first]


def _long(x: int) -> int:
    if not -(2**63) <= x < 2**63:
        raise OverflowError("an inner product does not fit a long")
    return x


def blocks(vectors: DataFrame, queries: DataFrame, block: int = BLOCK, per: int = QUERIES) -> tuple[DataFrame, DataFrame]:
    """Usable vectors and queries in written blocks by the same pivots, which are a bounded sample of the vectors."""

    def usable(df: DataFrame) -> DataFrame:
        good = F.col("vec_id").isNotNull() & finite() & (F.size("embedding") > 0)
        return df.where(good).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))

    rows, asked = usable(vectors), usable(queries)
    most = min(PIVOTS, math.ceil(rows.count() / block))
    pivots = defaultdict(set)
    for (v,) in rows.orderBy(F.xxhash64("vec_id", "embedding")).limit(most).select("embedding").collect():
        pivots[len(v)].add(tuple(v))
    pivots = {dim: np.array(sorted(points)) for dim, points in pivots.items()}
    # What each row's home is, and its turn, are written, so that a task run again deals the same.
    return tuple(
        stored(packed(stored(assigned(df, pivots), p + "homes"), size, p), p + "blocks")
        for df, size, p in ((rows, block, "v_"), (asked, per, "q_"))
    )


def with_floors(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The blocks of queries with ``floors``: their k-th scores in one block of vectors of their home."""
    place = F.row_number().over(Window.partitionBy("home", "dim").orderBy("v_block")) - 1
    heads = rows.select(F.col("v_home").alias("home"), F.col("v_dim").alias("dim"), "v_block").withColumn("place", place)
    held = heads.groupBy("home", "dim").agg(F.count("*").alias("held"))
    homed = (
        asked.select("q_block", F.col("q_home").alias("home"), F.col("q_dim").alias("dim"))
        .join(held, ["home", "dim"]).withColumn("place", F.pmod(F.xxhash64("q_block"), "held").cast("int"))
        .join(heads, ["home", "dim", "place"]).select("q_block", "v_block")
    )
    homed = (
        asked.select("q_block", "q_dim", "q_ids", "q_cells").join(stored(homed, "homed"), "q_block", "left")
        .join(rows.select("v_block", "v_ids", "v_cells"), "v_block", "left")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, dim, q_ids, q_cells, v_ids, v_cells in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(q_ids, "<i8")
                floors = np.full(len(own), NO_FLOOR)
                if v_ids is not None:
                    here = Block(np.frombuffer(v_ids, "<i8"), _numbers(v_cells, dim))
                    who, _, score = here.top(own, _numbers(q_cells, dim), k)
                    full = np.flatnonzero(np.bincount(who, minlength=len(own)) == k)
                    lowest = np.full(len(own), 2**63 - 1)
                    np.minimum.at(lowest, who, score)
                    floors[full] = lowest[full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([floors.astype("<i8").tobytes()], pa.binary())], ["f_block", "floors"]
                )

    found = homed.select("q_block", "q_dim", "q_ids", "q_cells", "v_ids", "v_cells").mapInArrow(
        run, "f_block long, floors binary"
    )
    return stored(asked.join(stored(found, "floors"), F.col("q_block") == F.col("f_block")).drop("f_block"), "asked")


def meetings(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """q_block, v_block, places: the queries whose threshold at depth zero reaches their floor in a block.

    Every block of queries meets the bounds of all blocks of vectors, TOGETHER at a time, which are
    some thousandth of the vectors themselves.
    """
    n = max(1, math.ceil(rows.count() / TOGETHER))
    bounds = (
        rows.withColumn("together", F.pmod(F.xxhash64("v_block"), F.lit(n))).groupBy("together", "v_dim")
        .agg(F.collect_list(F.struct("v_block", "v_high", "v_low")).alias("bounds"))
    )
    each = asked.withColumn("together", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))
    pairs = each.join(bounds.withColumnRenamed("v_dim", "q_dim"), ["together", "q_dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, dim, cells, floors, bounds in zip(*(c.to_pylist() for c in batch.columns)):
                queries, least = _numbers(cells, dim), np.frombuffer(floors, "<i8")
                high, low = (np.concatenate([_numbers(b[c], dim) for b in bounds]) for c in ("v_high", "v_low"))
                kind = _kind(queries, np.concatenate((high, low)), dim)
                reach = thresholds(queries.astype(kind), high.astype(kind), low.astype(kind)) >= least[:, None]
                found = [(b["v_block"], np.flatnonzero(r)) for b, r in zip(bounds, reach.T) if r.any()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(found), pa.int64()), pa.array([b for b, _ in found], pa.int64()),
                     pa.array([at.astype("<i4").tobytes() for _, at in found], pa.binary())],
                    ["m_query", "m_block", "places"],
                )

    return stored(
        pairs.select("q_block", "q_dim", "q_cells", "floors", "bounds").mapInArrow(run, "m_query long, m_block long, places binary"),
        "meetings",
    )


def topk(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, per: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest scores (all, if fewer).

    Both sides have ``vec_id`` and ``embedding``; other columns are not read. The score is the
    integer inner product of floor(64 x). Ties go to the smaller vec_id. Vectors that are null or
    empty, or hold null or non-finite components, take no part, nor do null ids. A query does not
    meet rows with its own vec_id, nor vectors of another length. Repeated rows are candidates
    each; repeated query rows have their ranks each. A score or component beyond a long is an error.

    No query passes through the driver, and no task holds more than one block of each side.
    """
    rows, asked = blocks(vectors, queries, block, per)
    asked = with_floors(asked, rows, k)
    # Each pair of blocks is a row of its own, so that pairs spread evenly over the tasks.
    pairs = (
        meetings(asked, rows)
        .join(rows.select("v_block", "v_ids", "v_cells"), F.col("m_block") == F.col("v_block"))
        .join(asked.select("q_block", "q_dim", "q_ids", "q_cells", "floors"), F.col("m_query") == F.col("q_block"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["asked", "place", "query_id", "vec_id", "score"]
        for batch in batches:
            for number, dim, q_ids, q_cells, floors, places, v_ids, v_cells in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.frombuffer(places, "<i4")
                own, least = np.frombuffer(q_ids, "<i8")[at], np.frombuffer(floors, "<i8")[at]
                here = Block(np.frombuffer(v_ids, "<i8"), _numbers(v_cells, dim))
                who, found, score = here.top(own, _numbers(q_cells, dim)[at], k, least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (np.full(len(who), number), at[who].astype(np.int64), own[who], found, score)], names
                )

    found = pairs.select("q_block", "q_dim", "q_ids", "q_cells", "floors", "places", "v_ids", "v_cells")
    found = found.mapInArrow(run, "asked long, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("asked", "place").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op10_exact_topk(spark, sf_dir) -> DataFrame:
    """The queries are the rows of ``embeddings`` whose id the contract names; see :func:`topk` for odd rows."""
    vectors = read(spark, sf_dir, "embeddings")
    return topk(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH good AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""
