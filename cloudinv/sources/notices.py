"""Messages that say which objects were created, one JSON document per line."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudinv.sources.snapshots import SUFFIX

# The members of an object-created message that are read.
MESSAGE = (
    "Records array<struct<eventTime string, s3 struct<bucket struct<name string>, "
    "object struct<key string, eTag string, sequencer string>>>>"
)
LOCATION = "s3a://{bucket}/{key}"


def _located(location: str, bucket: Column, key: Column) -> Column:
    """``location`` with bucket and key filled in."""
    before, rest = location.split("{bucket}")
    between, after = rest.split("{key}")
    return F.concat(F.lit(before), bucket, F.lit(between), key, F.lit(after))


def parse_notices(messages: DataFrame, location: str = LOCATION, text: str = "value") -> DataFrame:
    """``path, version, created_at`` of the snapshot files that messages name.

    Keys arrive percent-encoded, blanks as plus signs. ``location`` must give paths as Spark names
    them. Messages without records, such as a test message, and files of other names are passed
    over. The version tells apart objects written under one key.
    """
    record = F.explode(F.from_json(text, MESSAGE)["Records"])
    records = messages.select(record.alias("r"))
    thing = F.col("r.s3.object")
    key = F.url_decode(thing["key"])
    return records.select(
        _located(location, F.col("r.s3.bucket.name"), key).alias("path"),
        F.nullif(F.concat_ws("/", thing["sequencer"], thing["eTag"]), F.lit("")).alias("version"),
        F.col("r.eventTime").try_cast("timestamp").alias("created_at"),
    ).where(F.col("path").endswith(SUFFIX.removeprefix("*")))


def stream_notices(
    spark: SparkSession,
    folder: str,
    location: str = LOCATION,
    horizon: str = "1 day",
    files_per_batch: int = 25,
) -> DataFrame:
    """``path, version, created_at, arrived_at``: every created file once, as its message arrives.

    A message that is delivered again within ``horizon`` of its first arrival is dropped. Time
    is that of arrival, so a message that comes late is not lost, whatever its own time says.
    Only the folder of messages is listed, never those of the snapshots.
    """
    messages = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return (
        parse_notices(messages, location)
        .withColumn("arrived_at", F.current_timestamp())
        .withWatermark("arrived_at", horizon)
        .dropDuplicatesWithinWatermark(["path", "version"])
    )
