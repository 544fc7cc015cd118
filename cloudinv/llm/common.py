"""What the operators share: reading, storing, and words."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudinv.session import workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    Cuts the lineage and survives the loss of executors; what is read back is a plain scan,
    so a join over it is one that adaptive execution can split.
    """
    path = workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: str = "text") -> Column:
    """Tells apart rows that share a doc_id; rows alike in both are alike in all results."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, UPPER, LOWER)


def with_results(docs: DataFrame, results: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``docs`` left joined, null-safe, with ``results`` (whose key columns are named as in keys).

    Columns of ``results`` take the place of columns of ``docs`` with the same name.
    """
    new = [c for c in results.columns if c not in keys]
    left = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in new],
        *[v.alias(f"__{k}") for k, v in keys.items()],
    )
    right = results.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *new)
    on = [left[f"__{k}"].eqNullSafe(right[f"__r_{k}"]) for k in keys]
    joined = left.join(right, on, "left")
    return joined.drop(*[f"__{k}" for k in keys], *[f"__r_{k}" for k in keys])


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id's decimal text leaves the remainder ``part``; null ids do not."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % parts == part, F.lit(False))


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()
