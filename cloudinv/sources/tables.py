"""The inventory table as zstd parquet partitioned by account."""

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cloudinv.functions.jsonpath import with_payload
from cloudinv.schema import OPERATIONAL, PAYLOAD, PAYLOAD_TEXT
from cloudinv.session import setting, workspace

SORT = ("account_id", "resource_type", "arn")


def clustered(df: DataFrame) -> DataFrame:
    """Bring an account's rows together in partitions of even size.

    The rebalance hint lets adaptive execution split an account that is too large for
    one task and merge small ones; the sort gives tight min/max statistics on type.
    """
    return df.hint("rebalance", "account_id").sortWithinPartitions(*SORT)


def _writer(df: DataFrame, mode: str, rows_per_file: int | None = None):
    writer = df.write.mode(mode).option("compression", "zstd").partitionBy("account_id")
    return writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer


def append(
    df: DataFrame, path: str, payload: bool = False, complete: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Add rows to the table; with ``payload`` the configuration is parsed once, here, for all readers.

    It is parsed where rows are written, so the parsed form is neither shuffled nor sorted. The same
    holds for what ``complete`` adds to rows that come without columns that follow from others, such as
    a hash, which no codec makes smaller on its way. The columns of ``SORT`` are there before.
    """
    rows = clustered(df)
    rows = complete(rows) if complete else rows
    # What the write has shuffled goes when it is done, not when the driver collects its garbage.
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        _writer(with_payload(rows) if payload else rows, "append").parquet(path)


def write_version(df: DataFrame, path: str, rows_per_file: int | None = None) -> None:
    """Write a complete, compacted copy to a folder of its own."""
    _writer(clustered(df), "overwrite", rows_per_file).parquet(path)


def compact_files(
    spark: SparkSession, source: str, target: str, rows_per_file: int | None = None
) -> DataFrame:
    """Rewrite a table of many small files; the source is left as it is."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("compaction needs a target folder other than the source")
    write_version(read_operational(spark, source), target, rows_per_file)
    return read_operational(spark, target)


def export_parquet(df: DataFrame, path: str) -> None:
    """Write rows so that only the accounts they touch are replaced."""
    _writer(clustered(df), "overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def replace_accounts(df: DataFrame, path: str) -> None:
    """The same for rows that already lie account by account: they are not shuffled again."""
    ordered = df.sortWithinPartitions(*SORT)
    _writer(ordered, "overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back."""
    path = workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# -- buckets ---------------------------------------------------------------------------

KEY = ("account_id", "arn")


def _bucketed(spark: SparkSession, path: str, buckets: int) -> str:
    """The catalogue's name for a bucketed folder; the folder itself holds all there is."""
    name = f"inventory_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OPERATIONAL)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return name


def write_buckets(df: DataFrame, path: str, buckets: int) -> None:
    """Write the table in files by hash of the key, so that joins by key need not move it.

    One task writes a bucket: the number of buckets grows with the table. Keys are spread by account
    and ARN, so a large account is in all of them.
    """
    name = _bucketed(df.sparkSession, path, buckets)
    rows = df.select(*OPERATIONAL.names).repartition(buckets, *KEY)
    writer = rows.write.format("parquet").option("compression", "zstd").option("path", path).mode("overwrite")
    writer.bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(name)


def read_buckets(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    return spark.table(_bucketed(spark, path, buckets)).select(*OPERATIONAL.names)


def read_operational(spark: SparkSession, path: str) -> DataFrame:
    """Read the table with its fixed schema, so account ids stay text."""
    return spark.read.schema(OPERATIONAL).parquet(path).select(*OPERATIONAL.names)


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """A table written with ``payload``: the parsed configuration beside its text.

    Questions of the catalogue read it in place of the text. Rows written without it would have
    no members, so all of a table's rows are written alike.
    """
    columns = T.StructType([*OPERATIONAL.fields, T.StructField(PAYLOAD, T.VariantType()), T.StructField(PAYLOAD_TEXT, T.StringType())])
    return spark.read.schema(columns).parquet(path).select(*columns.names)


def count_export(spark: SparkSession, path: str) -> int:
    return spark.read.schema(OPERATIONAL).parquet(path).count()
