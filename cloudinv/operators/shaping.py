"""From snapshot documents to inventory rows, and the row filters over them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudinv.functions.jsonpath import with_members
from cloudinv.functions.text import contains_all
from cloudinv.functions.times import instant, parse_ts
from cloudinv.schema import OPERATIONAL_COLUMNS, PAYLOAD, PAYLOAD_TEXT


def explode_items(snapshots: DataFrame) -> DataFrame:
    """One row per configuration item; absent and empty lists give none."""
    return snapshots.select(F.explode("configurationItems").alias("item"), "source_key")


def item_columns(ingest_ts, source: Column | None = None) -> list[Column]:
    """The inventory columns of an ``item`` struct, stamped with the ingest time."""
    item = F.col("item")
    stamp = instant(ingest_ts)
    columns = {
        "account_id": item["awsAccountId"],
        "arn": item["ARN"],
        "resource_type": item["resourceType"],
        "resource_id": item["resourceId"],
        "resource_name": item["resourceName"],
        "aws_region": item["awsRegion"],
        "availability_zone": item["availabilityZone"],
        "status": item["configurationItemStatus"],
        "captured_at": parse_ts(item["configurationItemCaptureTime"]),
        "created_at": parse_ts(item["resourceCreationTime"]),
        "state_id": item["configurationStateId"],
        "state_hash": item["configurationStateMd5Hash"],
        "tags": item["tags"],
        "relationships": item["relationships"],
        "configuration": item["configuration"],
        "supplementary_configuration": item["supplementaryConfiguration"],
        "last_seen_at": stamp,
        "source_key": F.col("source_key") if source is None else source,
    }
    return [columns[name].alias(name) for name in OPERATIONAL_COLUMNS]


def identified(account: Column, arn: Column) -> Column:
    """An item counts only with an account and an ARN; empty text is missing."""
    return (F.coalesce(account, F.lit("")) != "") & (F.coalesce(arn, F.lit("")) != "")


def flatten_items(items: DataFrame, ingest_ts, strict: bool = True) -> DataFrame:
    """Inventory rows from exploded items.

    ``strict=False`` is the bulk-export rule: only a NULL account is dropped and the
    source file is not recorded.
    """
    if strict:
        kept = items.where(identified(F.col("item.awsAccountId"), F.col("item.ARN")))
        return kept.select(*item_columns(ingest_ts))
    kept = items.where(F.col("item.awsAccountId").isNotNull())
    return kept.select(*item_columns(ingest_ts)).drop("source_key")


def live(df: DataFrame, as_of, ttl_hours: int = 24) -> DataFrame:
    """Rows seen within the last hours before ``as_of``; no de-duplication."""
    cutoff = instant(as_of) - F.expr(f"interval {int(ttl_hours)} hours")
    return df.where(F.col("last_seen_at") > cutoff)


def of_type(df: DataFrame, *types: str) -> DataFrame:
    return df.where(F.col("resource_type").isin(*types))


def has_value(column: Column) -> Column:
    """Present and not empty."""
    return column.isNotNull() & (column != "")


def search_text(df: DataFrame, column: str, *needles: str) -> DataFrame:
    """Rows whose text holds every needle, upper and lower case alike."""
    return df.where(contains_all(F.col(column), *needles))


def probe(
    df: DataFrame, paths: dict[str, str], keep: tuple[str, ...] = (), column: str = "configuration"
) -> DataFrame:
    """Project named JSON members next to the columns to keep."""
    parsed = [c for c in (PAYLOAD, PAYLOAD_TEXT) if column == "configuration" and c in df.columns]
    rows = df.select(*dict.fromkeys((*keep, *(parsed or [column]))))
    return with_members(rows, paths, column).select(*keep, *paths)
