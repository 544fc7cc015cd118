"""Fixed aggregations over the live inventory.

All of them start from one small cube, counts by account, type and region, which is
reduced before the shuffle. The distinct counts then run over the cube and not over
the rows, so no row is expanded once per distinct count.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("account_id", "resource_type", "aws_region")


def cube(df: DataFrame, *dimensions: str) -> DataFrame:
    return df.groupBy(*(dimensions or DIMENSIONS)).agg(F.count(F.lit(1)).alias("n"))


def _clamp(limit: int, highest: int) -> int:
    return max(1, min(highest, int(limit)))


def overview(df: DataFrame) -> DataFrame:
    """Totals and the first and last time seen; one row even for an empty table."""
    cells = df.groupBy(*DIMENSIONS).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("last_seen_at").alias("first"),
        F.max("last_seen_at").alias("last"),
    )
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_resources"),
        F.countDistinct("account_id").alias("distinct_accounts"),
        F.countDistinct("resource_type").alias("distinct_resource_types"),
        F.countDistinct("aws_region").alias("distinct_regions"),
        F.min("first").alias("first_seen_at"),
        F.max("last").alias("last_seen_at"),
    )


def by_type(df: DataFrame, limit: int = 25) -> DataFrame:
    """The most frequent resource types."""
    return (
        df.groupBy("resource_type")
        .agg(F.count(F.lit(1)).alias("resource_count"))
        .orderBy(F.desc("resource_count"), F.asc_nulls_last("resource_type"))
        .limit(_clamp(limit, 200))
    )


def by_account(df: DataFrame, limit: int = 25) -> DataFrame:
    """The largest accounts, with how many types and regions they hold."""
    return (
        cube(df)
        .groupBy("account_id")
        .agg(
            F.sum("n").alias("resource_count"),
            F.countDistinct("resource_type").alias("distinct_resource_types"),
            F.countDistinct("aws_region").alias("distinct_regions"),
        )
        .orderBy(F.desc("resource_count"), F.asc_nulls_last("account_id"))
        .limit(_clamp(limit, 500))
    )


def by_region(df: DataFrame) -> DataFrame:
    """Every region, with how many accounts and types it holds."""
    return (
        cube(df)
        .groupBy("aws_region")
        .agg(
            F.sum("n").alias("resource_count"),
            F.countDistinct("account_id").alias("distinct_accounts"),
            F.countDistinct("resource_type").alias("distinct_resource_types"),
        )
        .orderBy(F.desc("resource_count"), F.asc_nulls_last("aws_region"))
    )


def totals(df: DataFrame) -> DataFrame:
    """Rows, accounts and types."""
    return cube(df, "account_id", "resource_type").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
        F.countDistinct("account_id").alias("accounts"),
        F.countDistinct("resource_type").alias("types"),
    )


def ingest_profile(df: DataFrame) -> DataFrame:
    """What a batch holds: rows, distinct accounts, distinct types."""
    return totals(df)
