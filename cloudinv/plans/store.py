"""Where the inventory lives: landed batches, the table, and their logs.

::

    landing/batch_id=N/kind=K/     rows of one ingest batch
    ingest_log/batch_id=N/         a row for each share of the files of a landed batch
    file_log/batch_id=N/           what became of each file of the batch
    tasks/, outcomes/, dead_letters/batch_id=N/   attempts at files, see streaming.ingest
    table/account_id=A/            the table as of the last maintenance run
    changes/run=R/account_id=A/    the accounts that a run rewrites
    run_log/                       two rows per maintenance run: prepared, published

A batch replaces only its own folder when it is replayed. A maintenance run writes the
accounts that change beside the table, logs that they are ready, and then puts them in the place of the
table's. A run that was cut off before is made again; one cut off while it replaced accounts is
carried on, and until then its accounts are read from ``changes``. Batch folders up to the one
that the last run holds and ``changes`` of published runs may be deleted; the logs stay.
"""

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudinv.functions.times import instant
from cloudinv.operators import maintenance
from cloudinv.operators.shaping import identified, item_columns, live
from cloudinv.schema import CORRUPT, OPERATIONAL
from cloudinv.sources.snapshots import list_files, plain, unread_files
from cloudinv.sources.tables import SORT, read_operational, replace_accounts, write_version

# What became of a file or an item.
ROW, DROPPED, EMPTY, BAD = "row", "dropped", "empty", "bad"

PREPARED, PUBLISHED = "prepared", "published"

_LANDED = T.StructType(
    [
        *OPERATIONAL.fields,
        T.StructField("batch_id", T.LongType()),
        T.StructField("kind", T.StringType()),
    ]
)
_RUN_LOG = "run long, through_batch long, as_of timestamp, state string"
_FILE_LOG = "source_key string, kind string, batch_id long"
_DEAD_LETTERS = "path string, version string, attempt int, batch_id long"
_ENTRY = "files long, rows long, dropped long, bad_files long, accounts long, types long"
_INGEST_LOG = f"{_ENTRY}, ingest_ts timestamp, batch_id long"


def classify(snapshots: DataFrame, ingest_ts) -> DataFrame:
    """Inventory rows plus one marker row per unusable file or item, told by ``kind``.

    Every decoded file gives at least one row, so one pass over the files is enough to
    land rows, set bad files aside and know which files were read.
    """
    exploded = snapshots.select(
        "source_key", CORRUPT, F.explode_outer("configurationItems").alias("item")
    )
    kind = (
        F.when(F.col(CORRUPT).isNotNull(), BAD)
        .when(F.col("item").isNull(), EMPTY)
        .when(~identified(F.col("item.awsAccountId"), F.col("item.ARN")), DROPPED)
        .otherwise(ROW)
    )
    return exploded.select(*item_columns(ingest_ts), kind.alias("kind"))


class BatchProfile:
    """What each file of a batch holds, observed while the batch is written.

    There is one entry for each document of a page of a batch, which is a bounded list of files.
    Metrics of the tasks that wrote the rows count once: no shuffle comes after.
    """

    def __init__(self):
        self.files: dict[str, list] = {}

    def observe(self, snapshots: DataFrame) -> tuple[DataFrame, Observation]:
        """To be observed before the items are exploded: a document is one row."""
        items, bad, seen = F.col("configurationItems"), F.col(CORRUPT).isNotNull(), Observation()
        good = F.filter(items, lambda i: identified(i["awsAccountId"], i["ARN"]))
        some = F.when(~bad, good)
        names = lambda c: F.array_distinct(F.transform(some, lambda i: i[c]))
        size = lambda a: F.coalesce(F.array_size(a), F.lit(0))
        document = F.struct(
            F.col("source_key"),
            bad.alias("bad"),
            # A list without items gives one marker row.
            F.greatest(size(items), F.lit(1)).alias("all"),
            size(F.filter(items, lambda i: i.isNull())).alias("none"),
            size(items).alias("items"),
            size(some).alias("rows"),
            names("awsAccountId").alias("accounts"),
            names("resourceType").alias("types"),
        )
        return snapshots.observe(seen, F.collect_list(document).alias("documents")), seen

    def add(self, seen: dict) -> None:
        for d in seen["documents"]:
            counts, accounts, types = self.files.setdefault(
                d["source_key"], [dict.fromkeys((ROW, DROPPED, EMPTY, BAD), 0), set(), set()]
            )
            if d["bad"]:
                counts[BAD] += d["all"]
                continue
            counts[ROW] += d["rows"]
            counts[DROPPED] += d["items"] - d["none"] - d["rows"]
            counts[EMPTY] += d["none"] if d["items"] else 1
            accounts.update(d["accounts"] or ())
            types.update(t for t in d["types"] or () if t is not None)

    def kinds(self) -> list[tuple[str, str]]:
        return sorted((f, kind) for f, (counts, _, _) in self.files.items() for kind, n in counts.items() if n)

    def entry(self, files: Iterable[str]) -> tuple:
        """Files, rows, dropped, bad files, accounts and types of some of the files."""
        found = [self.files[f] for f in files]
        total = lambda kind: sum(counts[kind] for counts, _, _ in found)
        union = lambda i: len(set().union(*[f[i] for f in found]))
        return len(found), total(ROW), total(DROPPED), total(BAD), union(1), union(2)


class InventoryStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- reading ---------------------------------------------------------------

    def _read(self, folder: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def ingest_log(self) -> DataFrame:
        return self._read("ingest_log", _INGEST_LOG)

    def file_log(self) -> DataFrame:
        return self._read("file_log", _FILE_LOG)

    def run_log(self) -> DataFrame:
        return self._read("run_log", _RUN_LOG)

    def dead_letters(self) -> DataFrame:
        """Files given up after the last attempt."""
        return self._read("dead_letters", _DEAD_LETTERS)

    def good_files(self, batch_id: int) -> DataFrame:
        """``source_key`` of the batch's files that were snapshots."""
        own = self._read(f"file_log/batch_id={int(batch_id)}", "source_key string, kind string")
        good = own.groupBy("source_key").agg(F.bool_and(F.col("kind") != BAD).alias("good"))
        return good.where("good").select("source_key")

    def failed_files(self, source: str) -> DataFrame:
        """``source_key`` of documents that are no snapshots, and of listed files that gave no row."""
        seen = self.file_log()
        bad = seen.where(F.col("kind") == BAD).select("source_key")
        listed = list_files(self.spark, source, "*.json.gz")
        return bad.unionByName(unread_files(listed, seen)).distinct()

    def landed(self, after: int = -1, upto: int | None = None) -> DataFrame:
        """Rows of logged batches, by default all; other batch folders are not listed.

        Batch numbers come to the driver: one per folder since the last maintenance run.
        """
        batch = F.col("batch_id")
        logged = self.ingest_log().where(batch > after)
        if upto is not None:
            logged = logged.where(batch <= upto)
        numbers = sorted(r["batch_id"] for r in logged.select("batch_id").distinct().collect())
        if not numbers:
            return self.spark.createDataFrame([], _LANDED)
        folder = f"{self.root}/landing"
        reader = self.spark.read.schema(_LANDED).option("basePath", folder)
        return reader.parquet(*[f"{folder}/batch_id={n}" for n in numbers])

    def _last_run(self) -> tuple[int, int, bool]:
        """The last prepared run, the last batch it holds, whether it is published; -1 for none."""
        # "published" sorts after "prepared".
        newest = F.max(F.struct("run", "state", "through_batch")).alias("r")
        found = self.run_log().agg(newest).first()["r"]
        return (found["run"], found["through_batch"], found["state"] == PUBLISHED) if found else (-1, -1, True)

    def _last_batch(self) -> int:
        last = self.ingest_log().agg(F.max("batch_id").alias("b")).first()["b"]
        return -1 if last is None else last

    def _changes(self, run: int) -> str:
        return f"{self.root}/changes/run={run}"

    def _accounts(self, folder: str) -> DataFrame:
        """Rows of an account-partitioned folder, without the marks of accounts that have no rows left."""
        return self._read(folder, OPERATIONAL).select(*OPERATIONAL.names).where("arn IS NOT NULL")

    def table(self) -> DataFrame:
        """The table as of the last maintenance run, also while that is being published."""
        run, _, published = self._last_run()
        if published:
            return self._accounts("table")
        changes = f"changes/run={run}"
        touched = self._read(changes, OPERATIONAL).select("account_id").distinct()
        kept = self._accounts("table").join(touched, "account_id", "left_anti").select(*OPERATIONAL.names)
        return kept.unionByName(self._accounts(changes))

    def operational(self, upto: int | None = None) -> DataFrame:
        """The whole table: the outcome of the last run and what has landed since."""
        _, through, _ = self._last_run()
        recent = self.landed(through, upto).where(F.col("kind") == ROW)
        return self.table().unionByName(recent.select(*OPERATIONAL.names))

    def live(self, as_of, ttl_hours: int = 24) -> DataFrame:
        return live(self.operational(), as_of, ttl_hours)

    # -- writing ---------------------------------------------------------------

    def land(
        self, snapshots: DataFrame, batch_id: int, ingest_ts, shares: list[list[str]] | None = None
    ) -> None:
        """Write one batch and its log entry; running it again replaces both.

        The rows are sorted where they were decoded and not shuffled, and each task
        writes one file per kind. Maintenance brings accounts together later. What the logs say is
        observed during the write, so nothing is read back.
        """
        self.land_pages([snapshots], batch_id, ingest_ts, shares)

    def land_pages(
        self, pages: Iterable[DataFrame], batch_id: int, ingest_ts, shares: list[list[str]] | None = None
    ) -> None:
        """The same for a batch that is read in several parts; none make a batch without rows.

        ``shares`` deals the names of the files out to log entries, each a batch of its own to the
        reader of the log; by default all files have one entry.
        """
        target = f"{self.root}/landing/batch_id={int(batch_id)}"
        profile, mode = BatchProfile(), "overwrite"
        for page in pages:
            documents, seen = profile.observe(page)
            self._write_kinds(classify(documents, ingest_ts), target, mode)
            profile.add(seen.get)
            mode = "append"
        if mode == "overwrite":
            none = self.spark.createDataFrame([], _LANDED).drop("batch_id")
            self._write_kinds(none, target, mode)
        place = {plain(name): i for i, names in enumerate(shares or []) for name in names}
        dealt: list[list[str]] = [[] for _ in shares or [[]]]
        for file in profile.files:
            dealt[place.get(plain(file), 0)].append(file)
        files = self.spark.createDataFrame(profile.kinds(), "source_key string, kind string")
        entries = self.spark.createDataFrame([profile.entry(share) for share in dealt], _ENTRY)
        # The batch counts once its entries in the ingest log exist, so those come last.
        self.put("file_log", files, batch_id)
        self.put("ingest_log", entries.withColumn("ingest_ts", instant(ingest_ts)), batch_id)

    def put(self, name: str, rows: DataFrame, batch_id: int) -> DataFrame:
        """Write what belongs to a batch into a folder of its own, and read it back."""
        target = f"{self.root}/{name}/batch_id={int(batch_id)}"
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(target)
        return self.spark.read.schema(rows.schema).parquet(target)

    def made(self, name: str, schema: str) -> str:
        """The path of a folder, which exists from now on."""
        path = f"{self.root}/{name}"
        self.spark.createDataFrame([], schema).write.partitionBy("batch_id").mode("append").parquet(path)
        return path

    def _write_kinds(self, rows: DataFrame, target: str, mode: str) -> None:
        (
            rows.sortWithinPartitions("kind", *SORT)
            .write.mode(mode)
            .option("partitionOverwriteMode", "static")
            .option("compression", "zstd")
            .partitionBy("kind")
            .parquet(target)
        )

    def nightly(self, as_of, days: int = 7, rows_per_file: int | None = None) -> int:
        """Merge, expire and compact; the number of the run.

        Only accounts with landed or expired rows are written; see ``nightly_changes``. The
        others are not read beyond the time column that tells whether rows have expired.
        """
        run, since, published = self._last_run()
        if not published:
            self._publish(run)
        through = self._last_batch()
        landed = self.landed(since, through).where(F.col("kind") == ROW).select(*OPERATIONAL.names)
        touched, rows = maintenance.nightly_changes(self._accounts("table"), landed, as_of, days)
        # An account without rows keeps its mark, as replacing touches only accounts that are written.
        marks = touched.select(
            *[F.col(f.name) if f.name == "account_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in OPERATIONAL]
        )
        write_version(rows.unionByName(marks), self._changes(run + 1), rows_per_file)
        entry = self.spark.range(1).select(
            F.lit(run + 1).cast("long").alias("run"),
            F.lit(through).cast("long").alias("through_batch"),
            instant(as_of).alias("as_of"),
        )
        self._log(entry, PREPARED)
        self._publish(run + 1)
        return run + 1

    def _publish(self, run: int) -> None:
        """Put a run's accounts in the place of the table's; done again, it changes nothing."""
        replace_accounts(read_operational(self.spark, self._changes(run)), f"{self.root}/table")
        entry = self.run_log().where((F.col("run") == run) & (F.col("state") == PREPARED)).drop("state").first()
        self._log(self.spark.createDataFrame([entry], "run long, through_batch long, as_of timestamp"), PUBLISHED)

    def _log(self, entry: DataFrame, state: str) -> None:
        entry.withColumn("state", F.lit(state)).coalesce(1).write.mode("append").parquet(f"{self.root}/run_log")
