"""Exact medians without gathering a group in one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudinv.sources.tables import staged

#: A stretch of at most so many different values is ordered by one task.
STRETCH = 100_000
#: Parts of a stretch in one round.
PARTS = 1024


def _reaching(parts: DataFrame, group: str, key: str) -> DataFrame:
    """Of the parts of stretches those that hold one of the two middle ranks.

    A stretch has ``before`` values ahead of it; ``n``, ``min`` and ``max`` are those of the group.
    """
    upto = Window.partitionBy(group, "stretch").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumn("ahead", F.col("before") + F.sum("held").over(upto) - F.col("held"))
    first, second = F.expr("(n + 1) div 2"), F.expr("(n + 2) div 2")
    holds = lambda rank: (rank > F.col("ahead")) & (rank <= F.col("ahead") + F.col("held"))
    return placed.where(holds(first) | holds(second)).select(
        group, "n", "min", "max", F.col("ahead").alias("before"), "lo", "hi", "different", F.col("lo").alias("stretch")
    )


def _within(counts: DataFrame, stretches: DataFrame, group: str) -> DataFrame:
    """Values with the stretch they lie in, of which a group has two at most."""
    own = stretches.withColumnRenamed(group, "_group")
    same = counts[group].eqNullSafe(own["_group"]) & (counts["v"] >= own["lo"]) & (counts["v"] <= own["hi"])
    return counts.join(own, same).drop("_group")


def exact_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group, n, min, max, median`` of a non-negative ``value`` per group.

    Values are first reduced to counts. Logarithmic bins (about 1 % wide, so at most
    some thousands per group) locate the middle ranks. A bin that holds more than ``STRETCH``
    different values is cut into parts of equal width, round after round, until the
    ranks lie in parts that do not; only those are ordered value by value. So no task orders more
    than that, however many different values there are.
    """
    counts = staged(
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(group), F.col(value).alias("v"))
        .agg(F.count(F.lit(1)).alias("c")),
        "counts",
    )
    shape = (F.sum("c").alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("different"))
    bins = counts.groupBy(group, F.floor(F.log2(F.col("v") + 1.0) * 64.0).alias("bin")).agg(*shape)
    whole = Window.partitionBy(group)
    bins = bins.select(
        "*", F.sum("held").over(whole).alias("n"), F.min("lo").over(whole).alias("min"), F.max("hi").over(whole).alias("max"),
        F.lit(0).cast("long").alias("before"), F.lit(0).alias("stretch"),
    )
    stretches = staged(_reaching(bins, group, "bin"), "stretches")
    wide = (F.col("different") > STRETCH) & (F.col("hi") > F.col("lo"))
    while stretches.where(wide).limit(1).count():
        inside = _within(counts, stretches.where(wide), group)
        # The ends always part, so every round gets on.
        share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        part = F.when(F.col("v") == F.col("hi"), PARTS).otherwise(F.least(F.floor(share * PARTS), F.lit(PARTS - 1)))
        parts = inside.groupBy(group, "n", "min", "max", "before", "stretch", part.alias("part")).agg(
            shape[0], F.min("v").alias("lo"), F.max("v").alias("hi"), shape[3]
        )
        narrow = stretches.where(~wide)
        stretches = staged(narrow.unionByName(_reaching(parts, group, "part")), "stretches")
    in_order = (
        Window.partitionBy(group, "stretch").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    values = _within(counts, stretches, group).withColumn("passed", F.col("before") + F.sum("c").over(in_order) - F.col("c"))

    def at(rank: Column) -> Column:
        reached = (rank > F.col("passed")) & (rank <= F.col("passed") + F.col("c"))
        return F.max(F.when(reached, F.col("v")))

    return values.groupBy(group, "n", "min", "max").agg(
        ((at(F.expr("(n + 1) div 2")) + at(F.expr("(n + 2) div 2"))) / 2).alias("median")
    )
