"""Relationship edges and state changes."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudinv.schema import RELATIONSHIPS

_TARGET = ("account_id", "target_type", "target_id")


def edges(df: DataFrame) -> DataFrame:
    """One row per relationship a resource declares."""
    return df.select(
        "account_id",
        F.col("resource_type").alias("source_type"),
        F.col("resource_id").alias("source_id"),
        F.explode(F.from_json("relationships", RELATIONSHIPS)).alias("edge"),
    ).select(
        "account_id",
        "source_type",
        "source_id",
        F.col("edge.name").alias("name"),
        F.col("edge.resourceType").alias("target_type"),
        F.col("edge.resourceId").alias("target_id"),
    )


def _targets(df: DataFrame) -> DataFrame:
    return df.select(
        "account_id",
        F.col("resource_type").alias("target_type"),
        F.col("resource_id").alias("target_id"),
        F.col("arn").alias("target_arn"),
    )


def _named_targets(df: DataFrame) -> DataFrame:
    """Resources of the types that edges lead to; the others are neither sorted nor shuffled.

    The names of these types are a scalar of the plan.
    """
    named = edges(df).agg(F.collect_set("target_type")).scalar()
    return _targets(df.where(F.array_contains(named, F.col("resource_type"))))


def resolve_edges(df: DataFrame) -> DataFrame:
    """Edges with the ARN of their target in the same account, NULL if it is unknown.

    A resource listed more than once is one target, with its smallest ARN.

    The hint gives the known targets a shuffle of their own, so both sides of the join are
    bare shuffles and a target that very many resources point to is split over tasks.
    """
    known = _named_targets(df).groupBy(*_TARGET).agg(F.min("target_arn").alias("target_arn"))
    known = known.hint("rebalance")
    return edges(df).join(known, list(_TARGET), "left")


def edge_counts(df: DataFrame) -> DataFrame:
    """Edges by source type, name and target type, and how many of them resolve.

    Edges are counted per target before the join, so a target that very many resources
    point to is one row in it.
    """
    per_target = (
        edges(df).groupBy("source_type", "name", *_TARGET).agg(F.count(F.lit(1)).alias("n"))
    )
    known = _named_targets(df).select(*_TARGET).distinct().withColumn("known", F.lit(True))
    return (
        per_target.join(known, list(_TARGET), "left")
        .groupBy("source_type", "name", "target_type")
        .agg(
            F.sum("n").alias("edge_count"),
            F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0))
            .cast("bigint")
            .alias("resolved_count"),
        )
    )


def state_changes(
    df: DataFrame,
    keys: tuple[str, ...] = ("account_id", "arn"),
    time: str = "last_seen_at",
    state: str = "state_hash",
    tie: tuple[str, ...] = ("source_key",),
    slice_unit: str = "hour",
) -> DataFrame:
    """Observations whose state differs from the one before, with both states.

    A key is compared within time slices, and only one first and one last observation
    per slice across them, so a key with very many observations is spread over tasks.
    """
    wanted = [*keys, time, *tie, state]
    seen = (
        df.where(F.col(time).isNotNull())
        .select(*dict.fromkeys(wanted))
        .withColumn("slice", F.date_trunc(slice_unit, F.col(time)))
    )
    order: list[str] = [time, *tie, state]
    within = Window.partitionBy(*keys, "slice").orderBy(*order)
    inside = seen.select(
        *keys,
        *[F.col(c) for c in order],
        F.lag(F.struct(state)).over(within).alias("_before"),
    )

    position = F.struct(*order)
    bounds = seen.groupBy(*keys, "slice").agg(
        F.min(position).alias("first"), F.max(position).alias("last")
    )
    across = Window.partitionBy(*keys).orderBy("slice")
    borders = bounds.select(
        *keys,
        *[F.col("first")[c].alias(c) for c in order],
        F.lag(F.struct(F.col("last")[state].alias(state))).over(across).alias("_before"),
    )

    changed: Column = F.col("_before").isNotNull() & ~F.col(state).eqNullSafe(
        F.col("_before")[state]
    )
    return (
        inside.unionByName(borders)
        .where(changed)
        .select(
            *keys,
            F.col(time).alias("changed_at"),
            F.col("_before")[state].alias("previous_state"),
            F.col(state).alias("current_state"),
        )
    )
