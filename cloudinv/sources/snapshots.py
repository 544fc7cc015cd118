"""Configuration snapshot files: gzipped JSON documents, one per file."""

import re
from datetime import date, datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudinv.functions.text import source_key
from cloudinv.schema import CORRUPT, SNAPSHOT

SUFFIX = "*.json.gz"
DEFAULT_REGION = "eu-west-2"
# What a listing of files has.
_LISTED = "path string, modificationTime timestamp, length long, content binary"


def today() -> date:
    return datetime.now(timezone.utc).date()


Day = date | str | list[date | str] | None


def snapshot_glob(root: str, region: str = "*", day: Day = None, account: str = "*") -> str:
    """Folder pattern of the delivery layout; month and day carry no leading zero.

    With a day, or a list of days, only their folders are listed.
    """
    if day is None:
        dated = "*/*/*"
    else:
        days = [
            date.fromisoformat(d) if isinstance(d, str) else d
            for d in (day if isinstance(day, list) else [day])
        ]
        dated = ",".join(f"{d.year}/{d.month}/{d.day}" for d in days)
        dated = dated if len(days) == 1 else f"{{{dated}}}"
    return f"{root.rstrip('/')}/AWSLogs/{account}/Config/{region}/{dated}/ConfigSnapshot"


def _options(reader, skip_broken: bool = False):
    # A file that cannot be decompressed fails the read. Only the store skips it, as it logs
    # the files it has read and ``unread_files`` finds the others.
    return (
        reader.schema(SNAPSHOT)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("ignoreCorruptFiles", skip_broken)
        .option("pathGlobFilter", SUFFIX)
    )


def _with_source(df: DataFrame) -> DataFrame:
    return df.withColumn("source_key", source_key(F.col("_metadata.file_path")))


def read_snapshots(
    spark: SparkSession,
    root: str,
    region: str = "*",
    day: Day = None,
    account: str = "*",
    skip_broken: bool = False,
) -> DataFrame:
    """One row per snapshot file, with ``source_key``; other file names are skipped.

    A broken archive is an error that names it. With ``skip_broken`` it yields no row, and
    the caller compares the folder with what was read; see :func:`unread_files`.
    """
    reader = _options(spark.read, skip_broken)
    return _with_source(reader.json(snapshot_glob(root, region, day, account)))


def stream_names(
    spark: SparkSession, root: str, region: str = "*", files_per_trigger: int = 25, day: Day = None
) -> DataFrame:
    """``path`` of snapshot files as a stream, a bounded number per trigger; no file is opened.

    Each trigger lists the folders again. A job started for some days, such as today and
    yesterday, lists only theirs, however long the history is.
    """
    reader = spark.readStream.format("binaryFile").schema(_LISTED).option("pathGlobFilter", SUFFIX)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(snapshot_glob(root, region, day)).select("path")


def quarantine(snapshots: DataFrame) -> DataFrame:
    """Files whose text is not a snapshot document, with the text as found."""
    # The item list is named so that the reader parses; alone, the text column may not
    # be asked for.
    bad = F.col(CORRUPT).isNotNull() & F.col("configurationItems").isNull()
    return snapshots.where(bad).select("source_key", F.col(CORRUPT).alias("raw"))


def list_files(spark: SparkSession, pattern: str, suffix: str = "*") -> DataFrame:
    """``path, modified_at, bytes`` of files below a folder pattern, contents unread."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", suffix)
        .option("recursiveFileLookup", True)
        .load(pattern)
        .select(
            "path",
            F.col("modificationTime").alias("modified_at"),
            F.col("length").alias("bytes"),
        )
    )


def unread_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Listed files that never produced a row, such as broken or empty archives."""
    known = seen.select(F.col("source_key").alias("path")).distinct()
    return files.join(known, "path", "left_anti").select(F.col("path").alias("source_key"))


def unpack(
    spark: SparkSession,
    root: str,
    out: str,
    region: str = DEFAULT_REGION,
    day: date | str | None = None,
) -> None:
    """Rewrite one day's snapshots as flat JSON lines, one item per line.

    Each item keeps its own JSON text. The folder hierarchy is dropped.
    """
    read_raw_items(spark, root, region, day or today()).select("value").write.mode(
        "overwrite"
    ).text(out)


def read_raw_items(
    spark: SparkSession, root: str, region: str = "*", day: date | str | None = None
) -> DataFrame:
    """``value, source_key``: the raw JSON text of every item; a broken archive is an error."""
    texts = (
        spark.read.option("pathGlobFilter", SUFFIX)
        .option("ignoreCorruptFiles", False)
        .text(snapshot_glob(root, region, day), wholetext=True)
    )
    document = F.from_json("value", "configurationItems array<string>")
    return _with_source(texts).select(
        F.explode(document["configurationItems"]).alias("value"), "source_key"
    )


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Snapshots of named files; characters that form patterns are taken literally.

    Files that are not there, or whose archive is broken, give no row.
    """
    literal = {re.sub(r"([\[\]{}*?\\])", r"\\\1", path) for path in paths}
    while literal:
        try:
            return _with_source(_options(spark.read, skip_broken=True).json(sorted(literal)))
        except AnalysisException as error:
            # Spark names one missing path at a time, which is rarely there to be found.
            missing = plain((error.getMessageParameters() or {}).get("path"))
            left = {path for path in literal if plain(path) != missing}
            if error.getCondition() != "PATH_NOT_FOUND" or left == literal:
                raise
            literal = left
    return spark.createDataFrame([], SNAPSHOT).withColumn("source_key", F.lit(None).cast("string"))


def plain(path: str | None) -> str | None:
    """A path without escapes and without the slashes of an empty authority."""
    return path and re.sub(r"^(\w+:)/+", r"\1/", path.replace("\\", ""))
