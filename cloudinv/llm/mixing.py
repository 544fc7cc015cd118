"""Mixing sources to target weights by fitting a word budget exactly.

Sizes are counted once, and from then on only (id, source, size) rows with their number of
copies move. Per source a histogram says how many documents have each exact size. A budget is
whole passes over the source and a rest. Of the rest every size takes its share of documents,
and what rounding leaves goes through a bounded knapsack over the documents still free. Which documents of a size are
taken follows a seeded hash of their ids: a size with very many of them is cut into bins by that
hash, and only the bin where the count is reached is looked at row by row.
"""

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudinv.llm.common import read, stored

WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED = 1.5, 2, 1
#: Words left to the knapsack: its table has a place for each.
KNAPSACK = 1 << 16
#: Documents of one bin of a size, and copies of one row written by one task.
BIN, COPIES = 4096, 4096


def word_counts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts that lie one after the other; ``ends`` has one place more than texts."""
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    # A text's first byte follows another text, not a blank.
    firsts = ends[:-1][ends[:-1] < ends[1:]]
    begins[firsts] = word[firsts]
    return np.diff(np.concatenate(([0], np.cumsum(begins, dtype=np.int64)))[ends])


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, size) of every row; a null text has size 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).fill_null(b"")
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(texts) else np.zeros(0, np.uint8)
            counts = word_counts(data, ends - ends[0]) if len(texts) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts)], ["doc_id", "source", "size"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col(f"`{text}`").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, source string, size long")


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size, at most ``counts``, add up to the largest sum up to ``budget``.

    For every sum the size that first reached it is kept and how many of it that took, which is
    enough to walk back. Sizes are at least 1.
    """
    taken = np.zeros(len(sizes), np.int64)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by, times = np.full(budget + 1, -1, np.int64), np.zeros(budget + 1, np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        if reached[budget]:
            break
        new = np.flatnonzero(reached[: max(0, budget + 1 - sizes[i])])
        for n in range(1, int(counts[i]) + 1):
            new = new + sizes[i]
            new = new[new <= budget]
            new = new[~reached[new]]
            if not len(new):
                break
            reached[new], by[new], times[new] = True, i, n
    at = int(np.flatnonzero(reached)[-1])
    while at:
        taken[by[at]] = times[at]
        at -= int(times[at] * sizes[by[at]])
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, room: int = KNAPSACK) -> np.ndarray:
    """How many documents of each size to take, so that their words come to ``budget`` or very near.

    Of a budget above half of all words, what to leave is fitted instead, so that many documents
    are free to choose from. All but the last ``room`` words are dealt in proportion to the counts, from the longest size to
    the shortest, where each passes on what it could not use. The rest is a bounded knapsack.
    """
    taken = np.zeros(len(sizes), np.int64)
    words = sum(int(s) * int(c) for s, c in zip(sizes, counts))
    if 2 * budget > words:
        return counts - fit(sizes, counts, words - budget, room)
    bulk = max(0, budget - room)
    over = 0
    for i in np.argsort(-sizes, kind="stable"):
        s, c = int(sizes[i]), int(counts[i])
        if bulk and s:
            # ``over`` has words times ``words``, so that shares stay whole numbers.
            over += s * c * bulk
            taken[i] = min(c, over // (s * words))
            over -= int(taken[i]) * s * words
    rest = budget - sum(int(s) * int(t) for s, t in zip(sizes, taken))
    # Where short documents are too few to use up what was passed on, single longer ones do.
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        if s and rest > room:
            more = min(int(counts[i] - taken[i]), (rest - room) // s)
            taken[i] += more
            rest -= more * s
    # Now less than ``room`` and the shortest free document, or none is free.
    able = np.flatnonzero((sizes > 0) & (taken < counts) & (sizes <= rest))
    if len(able):
        taken[able] += knapsack(sizes[able], (counts - taken)[able], rest)
    return taken


def _share(sources: DataFrame, total: int, share: Fraction, most: int) -> Fraction:
    """Words a unit of weight gets, once sources that reach ``most`` times their size have passed on the rest."""
    unit = Fraction(0)
    while True:
        full = F.col("source_size").cast("decimal(38,0)") * most * unit.denominator <= (
            F.col("weight").cast("decimal(38,0)") * F.lit(str(unit.numerator)).cast("decimal(38,0)")
        )
        left = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if not left["weight"]:
            return unit
        now = (share * total - most * int(left["full"])) / int(left["weight"])
        if now == unit:
            return unit
        unit = now


def _weighted(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Sources in order of their key with their weights; they are ranked range by range."""
    ranged = sources.repartitionByRange("key").sortWithinPartitions("key")
    ranged = stored(ranged.withColumn("range", F.spark_partition_id()), "sources")
    # One number for each range comes to the driver.
    sizes = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}
    before, starts = 0, []
    for number in sorted(sizes):
        starts.append((number, before))
        before += sizes[number]
    at = sources.sparkSession.createDataFrame(starts, "range int, before long")
    place = F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1 + F.col("before")
    cycle = F.array(*[F.lit(w) for w in weights])
    placed = ranged.join(F.broadcast(at), "range")
    return placed.select("key", "source_size", F.element_at(cycle, (place % len(weights)).cast("int") + 1).alias("weight"))


def _copies(rows: DataFrame) -> DataFrame:
    """One row for each copy, numbered by ``copy`` from 0; very many copies are dealt to many tasks first."""
    few = rows.where(F.col("m") <= COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("copy"))
    last = F.col("m") - 1
    many = rows.where(F.col("m") > COPIES).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(COPIES).cast("long"))).alias("start")
    )
    many = many.hint("rebalance").select(
        *rows.columns, F.explode(F.sequence("start", F.least(last, F.col("start") + COPIES - 1))).alias("copy")
    )
    return few.unionByName(many)


def _hashed(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED,
    text: str = "text", room: int = KNAPSACK,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: how often the mix takes each row of ``docs``.

    A row's size is the number of words of its text. Sources in order of code points, null last,
    weigh ``weights``, repeating, and share ``share`` times all words by weight. A target stops at
    ``most`` times its source's size, and the excess is shared again by weight. A source's words
    come to its target, or as near as its sizes allow: a whole pass takes every row once
    more, and the rest of the target takes a row at most once more, so ``copies`` is at most
    ``most``. ``taken`` is copies times size.

    Rows are picked by a seeded hash of doc_id, so reruns agree; rows alike in id, source and size
    may stand for each other. Null ids are rows like any other, null texts have size 0 and are
    never taken beyond whole passes. An empty table gives no rows. Other columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("a"), "source"), F.lit("z"))
    rows = sized(docs, text).withColumn("key", key).groupBy("doc_id", "key", "size").agg(F.count(F.lit(1)).alias("m"))
    rows = stored(rows, "sizes")
    classes = stored(rows.groupBy("key", "size").agg(F.sum("m").alias("n")), "histogram")
    sources = stored(_weighted(classes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights), "weights")
    total = int(sources.agg(F.sum("source_size").cast("decimal(38,0)")).first()[0] or 0)
    unit = _share(sources, total, Fraction(share), most)
    per = F.lit(float(unit)) * F.col("weight")
    target = F.least(F.col("source_size").cast("double") * most, per).alias("target")
    sources = sources.select("key", "source_size", target)

    def fitted(histogram: pd.DataFrame) -> pd.DataFrame:
        histogram = histogram.sort_values("size")
        words = int(histogram["source_size"].iloc[0])
        budget = min(round(histogram["target"].iloc[0]), most * words)
        passes, rest = divmod(budget, words) if words else (0, 0)
        more = fit(histogram["size"].to_numpy(), histogram["n"].to_numpy(), rest, room)
        return histogram[["key", "size", "n", "source_size", "target"]].assign(passes=passes, more=more)

    # The sizes of one source: their number is below the root of twice its words.
    plan = classes.join(sources, "key").groupBy("key").applyInPandas(
        fitted, "key string, size long, n long, source_size long, target double, passes long, more long"
    )
    plan = stored(plan, "plan")
    hashed, ordered = _hashed(seed, "doc_id"), _hashed(seed + 1, "doc_id")
    bins = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / BIN))
    open_ = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    # Plain joins of stored tables are split by adaptive execution where very many rows have one size.
    dealt = stored(rows.join(plan, ["key", "size"]).withColumn("bin", F.when(open_, F.pmod(hashed, bins))), "dealt")
    filled = dealt.where(open_).groupBy("key", "size", "bin", "more").agg(F.sum("m").alias("here"))
    upto = Window.partitionBy("key", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    filled = filled.withColumn("upto", F.sum("here").over(upto))
    cut = filled.where((F.col("upto") >= F.col("more")) & (F.col("upto") - F.col("here") < F.col("more"))).select(
        "key", "size", F.col("bin").alias("cut"), (F.col("more") - F.col("upto") + F.col("here")).alias("left")
    )
    marked = stored(dealt.join(stored(cut, "cuts"), ["key", "size"], "left"), "marked")
    inside = F.coalesce(F.col("bin") == F.col("cut"), F.lit(False))
    within = Window.partitionBy("key", "size").orderBy(ordered, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("m").over(within), F.lit(0))
    left = F.greatest(F.lit(0).cast("long"), F.least("m", F.col("left") - before))
    whole_ = F.when(open_, F.when(F.col("bin") < F.col("cut"), F.col("m")).otherwise(F.lit(0)))
    others = marked.where(~inside).withColumn("extra", F.coalesce(whole_, F.when(F.col("more") > 0, F.col("m")), F.lit(0)).cast("long"))
    chosen = marked.where(inside).withColumn("extra", left).unionByName(others)
    copies = F.col("passes") + F.when(F.col("copy") < F.col("extra"), 1).otherwise(0)
    source = F.when(F.col("key") != "z", F.expr("substring(key, 2)")).alias("source")
    return _copies(chosen).select(
        "doc_id", source, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def op12_source_mix(spark, sf_dir) -> DataFrame:
    """The mix of all ``documents``; see :func:`mix`, also for nulls, empty texts and repeated rows."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
