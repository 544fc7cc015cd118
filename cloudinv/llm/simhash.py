"""SimHash fingerprints and exact search for close ones with vantage-point trees.

Random 64-bit fingerprints lie at 32 +- 4 bits from any vantage point, so a tree over the whole
distance prunes next to nothing at radius 4. The trees here therefore measure the Hamming
distance within blocks of the bits. Of ``blocks`` disjoint blocks at least one has no more than
``radius // blocks`` of the differing bits, so each block has its own tree with that much smaller
radius, and a pair is found in at least one tree. ``blocks=1`` is the plain tree.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudinv.llm.common import read, stored, text_key, texts, words
from cloudinv.llm.components import components

SHINGLE = 4
RADIUS = 4
BLOCKS = 5
SEED = 42
#: Fingerprints in the sample from which the trees' upper levels are grown on the driver.
SAMPLE = 65_536
#: Fingerprints per leaf that the depth aims at, and the most that are compared in one group.
LEAF, GROUP = 64, 16_384


def fingerprint(tokens: list[bytes], shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes; no tokens give 0."""
    if not tokens:
        return 0
    joined, hashed = b" ".join(tokens), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: max(1, len(tokens) - shingle + 1)].tolist()
    ends = ends[min(shingle, len(tokens)) - 1 :].tolist()
    counts, at = np.zeros(64, np.int64), 0
    while at < len(starts):
        part = b"".join([hashed(joined[s:e], SEED) for s, e in zip(starts[at : at + 8192], ends[at : at + 8192])])
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
        at += 8192
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row (tells apart rows with one doc_id), fp (as a signed long) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(words(t), shingle) for t in texts(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "row", "fp"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, fp long")


@dataclass
class Tree:
    """A complete binary tree over the distance within ``mask``; the children of i are 2i+1, 2i+2."""

    mask: np.uint64
    radius: int
    depth: int
    vantage: np.ndarray
    split: np.ndarray

    def leaves(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into fps, leaf): the home leaf and each leaf whose border is within the radius.

        Points up to ``split`` from the vantage point lie inside, others outside. By the triangle
        inequality a partner of an inner point is at most ``split + radius`` away, so outer
        points up to there go inside as well, and no inner point has to go outside.
        """
        index, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            away = np.bitwise_count((fps[index] ^ self.vantage[node]) & self.mask).astype(np.int64)
            inner, outer = away <= self.split[node] + self.radius, away > self.split[node]
            index = np.concatenate((index[inner], index[outer]))
            node = np.concatenate((2 * node[inner] + 1, 2 * node[outer] + 2))
        return index, node


def grow(sample: np.ndarray, mask: int, radius: int, depth: int) -> Tree:
    mask, rng = np.uint64(mask), np.random.default_rng(SEED)
    inner_nodes = 2**depth - 1
    tree = Tree(mask, radius, depth, np.zeros(inner_nodes, np.uint64), np.zeros(inner_nodes, np.int64))
    held = {0: sample}
    for node in range(inner_nodes):
        own = held.pop(node)
        if len(own):
            best = None
            for v in rng.choice(own, min(8, len(own)), replace=False):
                away = np.bitwise_count((own ^ v) & mask).astype(np.int64)
                split = int(np.median(away))
                for s in (split - 1, split):
                    # The larger child decides; points near the border count on both sides.
                    worst = max((away <= s + radius).sum(), (away > s).sum())
                    if best is None or worst < best[0]:
                        best = worst, v, s, away
            _, tree.vantage[node], tree.split[node], away = best
            inner = away <= tree.split[node]
            held[2 * node + 1], held[2 * node + 2] = own[inner], own[~inner]
        else:
            held[2 * node + 1] = held[2 * node + 2] = own
    return tree


def masks(blocks: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect whatever is within ``radius``, without listing all pairs of a dense group.

    All within the radius of a vantage point are linked to it and need no comparison among
    themselves. Only points up to twice the radius away can be close to one of them.
    """
    left, right = [], []

    def close(a, b):
        for at in range(0, len(a), 512):
            yield at, np.bitwise_count(a[at : at + 512, None] ^ b[None, :]) <= radius

    while len(fps) > 256:
        vantage = fps[0]
        away = np.bitwise_count(fps ^ vantage)
        ball, near = fps[away <= radius], fps[(away > radius) & (away <= 2 * radius)]
        fps = fps[away > radius]
        found = [ball[1:]]
        if len(near):
            hit = np.zeros(len(near), bool)
            for _, found_here in close(ball, near):
                hit |= found_here.any(axis=0)
            found.append(near[hit])
        found = np.concatenate(found)
        left.append(np.full(len(found), vantage))
        right.append(found)
    if len(fps):
        linked = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        if linked.sum() > len(fps):
            least, last = np.arange(len(fps)), None
            while last is None or (least != last).any():
                least, last = np.where(linked, least[None, :], len(fps)).min(axis=1), least
            own = np.flatnonzero(least != np.arange(len(fps)))
            left.append(fps[least[own]])
            right.append(fps[own])
    empty = np.zeros(0, np.uint64)
    left, right = [empty, *left], [empty, *right]
    return np.concatenate(left), np.concatenate(right)


def close_pairs(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all within ``radius`` bits.

    ``nodes``: written rows with distinct ``fp``. The trees come from a bounded sample and only
    decide where fingerprints meet, never whether. A leaf beyond ``group`` fingerprints is cut
    into parts, and each pair of parts is a group of its own.
    """
    count = nodes.count()
    own = radius // blocks
    share = min(1.0, SAMPLE / max(1, count))
    sample = np.sort(np.array([r[0] for r in nodes.select("fp").sample(share, SEED).collect()], np.int64))
    depth = max(0, min(12, math.ceil(math.log2(max(1, count) / LEAF))))
    trees = [grow(sample.view(np.uint64), m, own, depth) for m in masks(blocks)]

    def route(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, tree in enumerate(trees):
                index, leaf = tree.leaves(fps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf * blocks + number), pa.array(fps[index].view(np.int64))], ["leaf", "fp"]
                )

    routed = stored(nodes.select("fp").mapInArrow(route, "leaf long, fp long"), "leaves")
    # One row for each large leaf of the trees: bounded by their size, not by the input.
    large = {r[0]: math.ceil(r[1] / group) for r in routed.groupBy("leaf").count().where(f"count > {group}").collect()}

    def deal(batches):
        for batch in batches:
            leaf, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            parts = np.array([large.get(x, 1) for x in leaf.tolist()], np.int64)
            mine = (fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % parts
            index = np.repeat(np.arange(len(fps)), parts)
            other = np.arange(len(index)) - np.repeat(np.cumsum(parts) - parts, parts)
            mine = mine[index]
            lo, hi = np.minimum(mine, other), np.maximum(mine, other)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf[index]), pa.array(lo * 1_000_000 + hi), pa.array(fps[index])], ["leaf", "part", "fp"]
            )

    def compare(batches):
        held, key = [], None
        for batch in batches:
            leaf, part, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            starts = np.flatnonzero(np.concatenate(([True], (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1]))))
            out = []
            for s, e in zip(starts, [*starts[1:], len(fps)]):
                if key is not None and key != (leaf[s], part[s]):
                    out.append(links(np.concatenate(held), radius))
                    held = []
                key = leaf[s], part[s]
                held.append(fps[s:e].view(np.uint64))
            if out:
                yield _pairs(out)
        if held:
            yield _pairs([links(np.concatenate(held), radius)])

    dealt = routed.mapInArrow(deal, "leaf long, part long, fp long") if large else routed.select("leaf", F.lit(0).cast("long").alias("part"), "fp")
    return (
        dealt.repartition("leaf", "part").sortWithinPartitions("leaf", "part").mapInArrow(compare, "a long, b long")
    )


def _pairs(found) -> pa.RecordBatch:
    columns = [np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, row, fp, label, component_id for each row of ``docs``.

    Rows are linked when their fingerprints differ in at most ``radius`` bits; ``component_id`` is
    the smallest doc_id reachable (null ids are passed over; null if there is no other), ``label``
    a fingerprint that stands for the component. A null text is empty; texts without words have
    fingerprint zero. Repeated rows are members each.

    Copies meet as one fingerprint before anything is compared, so groups of copies cost nothing.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    labels = components(close_pairs(nodes, radius, blocks)).withColumnRenamed("node", "fp")
    labelled = stored(
        nodes.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "labelled"
    )
    least = stored(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    ids = stored(labelled.join(least, "label").select("fp", "label", "component_id"), "ids")
    return rows.join(ids, "fp").select("doc_id", "row", "fp", "label", "component_id")


def near_dedup(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id's (null ids last)."""
    found = near_duplicates(docs, **parameters).groupBy("label", "doc_id", "row").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n")).alias("best")
    keep = stored(found.groupBy("label").agg(best).select("best.doc_id", "best.row", "best.n"), "keep")
    left = docs.withColumn("__row", text_key())

    def kept(which: DataFrame) -> DataFrame:
        on = left["doc_id"].eqNullSafe(which["doc_id"]) & (left["__row"] == which["row"])
        return left.join(which, on, "left_semi").drop("__row")

    if keep.where("n > 1").isEmpty():
        return kept(keep)
    repeated = left.join(
        (r := keep.where("n > 1")), left["doc_id"].eqNullSafe(r["doc_id"]) & (left["__row"] == r["row"]), "left_semi"
    ).dropDuplicates(["doc_id", "__row"])
    return kept(keep.where("n = 1")).unionByName(repeated.drop("__row"))


def op3_simhash_neardup(spark, sf_dir) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")
