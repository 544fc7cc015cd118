"""Continuous ingest of snapshot files."""

from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloudinv.plans.store import InventoryStore
from cloudinv.session import setting
from cloudinv.sources.notices import LOCATION, stream_notices
from cloudinv.sources.snapshots import Day, read_files, stream_names
from cloudinv.streaming.attempts import DEAD, MAX_ATTEMPTS, OUTCOME, READ, attempts

#: Files that one job reads by name.
PAGE = 500

_PARTITIONS = "spark.sql.shuffle.partitions"
_LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _together(files_per_batch: int) -> int:
    """Files of as many whole batches as a page makes."""
    return max(1, PAGE // files_per_batch) * files_per_batch


def _state_partitions(spark: SparkSession) -> int:
    """One for each core, or fewer where the session asks for fewer."""
    return min(int(spark.conf.get(_PARTITIONS)), spark.sparkContext.defaultParallelism)


def _started(rows: DataFrame, land, checkpoint: str, interval: str | None) -> StreamingQuery:
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    writer = rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def stream_ingest(
    spark: SparkSession,
    source: str,
    store_root: str,
    checkpoint: str,
    region: str = "*",
    files_per_batch: int = 25,
    interval: str | None = "60 seconds",
    ingest_ts: datetime | None = None,
    day: Day = None,
) -> StreamingQuery:
    """Start landing new snapshot files in batches.

    A trigger takes the names of as many whole batches as ``PAGE`` files make, reads the files in
    one job, and logs each batch of ``files_per_batch`` files by itself. So the fixed cost of a
    trigger is paid once for all of them.

    ``interval=None`` takes what is there, in the same bounded batches, and stops. The
    checkpoint fixes which files a trigger holds, and a replayed one replaces its own
    folder, so a lost driver or executor neither loses nor doubles rows.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        names = sorted(r["path"] for r in batch.collect())
        shares = [names[i : i + files_per_batch] for i in range(0, len(names), files_per_batch)]
        stamp = ingest_ts or datetime.now(timezone.utc)
        InventoryStore(session, store_root).land(read_files(session, names), batch_id, stamp, shares)

    names = stream_names(spark, source, region, _together(files_per_batch), day)
    return _started(names, land, checkpoint, interval)


def _pages(tasks: DataFrame, size: int = PAGE) -> Iterator[list[str]]:
    """Paths to read, a bounded list at a time; a path that several versions name is read once."""
    # A partition that is iterated over is a job, and a stream's session does not merge them.
    paths = tasks.where(F.col("verdict") == READ).select("path").distinct().coalesce(1)
    paths = (r["path"] for r in paths.toLocalIterator())
    while page := list(islice(paths, size)):
        yield page


def stream_events(
    spark: SparkSession,
    messages: str,
    store_root: str,
    checkpoint: str,
    location: str = LOCATION,
    files_per_batch: int = 25,
    interval: str | None = "60 seconds",
    ingest_ts: datetime | None = None,
    horizon: str = "1 day",
    most: int = MAX_ATTEMPTS,
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Start landing the files that object-created messages name, without listing their folders.

    ``messages`` is a folder of message files, of which a batch takes as many times ``files_per_batch``
    as ``PAGE`` has room for: its fixed cost is the same for one message as for many. A file
    that gives no snapshot, or is not there, is read again up to ``most`` times in all and then
    becomes a dead letter; see :class:`cloudinv.streaming.attempts.Attempts`. Outcomes are written
    to the store and come back as a second input, one batch later. With ``interval=None`` the query
    takes what is there and stops, so each start makes one attempt at what failed before.

    A batch that is replayed replaces its own folders, and the state passes over outcomes it has
    seen. One query feeds a store, as batches are known by its numbers.

    State lies in ``state_partitions``, by default one for each core: each costs a task per trigger and
    step, however few rows come. A checkpoint keeps the number that it began with.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        store = InventoryStore(session, store_root)
        # One file, by a shuffle: brought together without one, all partitions of the state are one task.
        tasks = store.put("tasks", batch.repartition(1), batch_id)
        stamp = ingest_ts or datetime.now(timezone.utc)
        store.land_pages((read_files(session, page) for page in _pages(tasks)), batch_id, stamp)
        dead = tasks.where(F.col("verdict") == DEAD).select("path", "version", "attempt")
        store.put("dead_letters", dead, batch_id)
        read = tasks.where(F.col("verdict") == READ)
        outcomes = read.join(store.good_files(batch_id), read["path"] == F.col("source_key"), "left").select(
            "path", "version", "attempt", F.col("source_key").isNotNull().alias("ok")
        )
        # Outcomes come last: what they report is landed by then.
        store.put("outcomes", outcomes, batch_id)

    store = InventoryStore(spark, store_root)
    # The stream needs its second input from the start.
    together = _together(files_per_batch)
    outcomes = spark.readStream.schema(f"{OUTCOME}, batch_id long").option("maxFilesPerTrigger", together)
    outcomes = outcomes.parquet(store.made("outcomes", f"{OUTCOME}, batch_id long"))
    outcomes = outcomes.drop("batch_id").withColumn("arrived_at", F.current_timestamp())
    notices = stream_notices(spark, messages, location, horizon, together)
    # The files of a page are listed by a task for each core, not one for each file.
    listers = str(spark.sparkContext.defaultParallelism)
    with setting(spark, _PARTITIONS, str(state_partitions or _state_partitions(spark))), setting(spark, _LISTERS, listers):
        return _started(attempts(notices, outcomes, most), land, checkpoint, interval)
