import gzip
import json
import os
import shutil
from datetime import datetime
from urllib.parse import quote_plus

import pytest
from helpers import collected, deliver, folder, item
from pyspark.sql import functions as F

from cloudinv.demo.files import write_messages
from cloudinv.operators import maintenance
from cloudinv.operators.shaping import explode_items, flatten_items
from cloudinv.plans import store as store_module
from cloudinv.plans.store import InventoryStore
from cloudinv.schema import OPERATIONAL_COLUMNS
from cloudinv.session import setting
from cloudinv.sources import notices, schemas, snapshots, tables
from cloudinv.streaming.ingest import stream_events, stream_ingest

T0 = datetime(2026, 4, 9, 12)


@pytest.fixture
def root(tmp_path):
    deliver(
        tmp_path,
        "a b+c.json.gz",
        [
            item(ARN="arn:full", tags={"aws:cf:stack": "é", "Environment": "prod"},
                 configuration={"size": 8, "x": {"y": [1, 2]}}, configurationStateId=42,
                 relationships=[], supplementaryConfiguration={}),
            item(ARN="arn:null-payload", configuration=None, configurationItemCaptureTime="garbage"),
            item(ARN="arn:absent-payload", configuration="ABSENT", configurationItemCaptureTime=1775728800),
            item(ARN="arn:text-payload", configuration="plain", configurationItemCaptureTime=""),
            item(ARN=None, resourceId="no-arn"),
            item(ARN="", resourceId="empty-arn"),
            item(awsAccountId="ABSENT", resourceId="no-account"),
            item(awsAccountId="", resourceId="empty-account"),
        ],
    )
    deliver(tmp_path, "other.json.gz", [item(ARN="arn:full", awsAccountId="000000000099")],
            account="000000000099", region="us-east-1", day="2026/12/31")
    deliver(tmp_path, "none.json.gz", [])
    deliver(tmp_path, "absent.json.gz", None, document={"fileVersion": "1.0"})
    deliver(tmp_path, "skipped.json", [item(ARN="arn:wrong-name")])
    return str(tmp_path)


def rows(spark, root, **kwargs):
    return flatten_items(explode_items(snapshots.read_snapshots(spark, root, **kwargs)), T0)


def test_flatten(spark, root):
    df = rows(spark, root)
    assert df.columns == list(OPERATIONAL_COLUMNS)
    got = {(r["account_id"], r["arn"]): r for r in df.collect()}
    assert {a for _, a in got} == {"arn:full", "arn:null-payload", "arn:absent-payload", "arn:text-payload"}
    full = got["000000000012", "arn:full"]
    assert full["tags"] == '{"aws:cf:stack":"é","Environment":"prod"}'
    assert full["configuration"] == '{"size":8,"x":{"y":[1,2]}}'
    assert (full["relationships"], full["supplementary_configuration"]) == ("[]", "{}")
    assert full["state_id"] == "42" and full["captured_at"] == datetime(2026, 4, 9, 10)
    assert full["last_seen_at"] == T0 and full["source_key"].endswith("/a b+c.json.gz")
    assert got["000000000012", "arn:null-payload"]["configuration"] is None
    assert got["000000000012", "arn:null-payload"]["captured_at"] is None
    assert got["000000000012", "arn:absent-payload"]["captured_at"] == datetime(2026, 4, 9, 10)
    assert ("000000000099", "arn:full") in got


def test_lenient_keeps_missing_arn(spark, root):
    df = flatten_items(explode_items(snapshots.read_snapshots(spark, root)), T0, strict=False)
    assert "source_key" not in df.columns and len(df.columns) == 17
    ids = {r["resource_id"] for r in df.collect()}
    assert {"no-arn", "empty-arn", "empty-account"} <= ids and "no-account" not in ids


def test_region_and_day(spark, root):
    assert rows(spark, root, region="us-east-1").count() == 1
    assert rows(spark, root, day="2026-12-31").count() == 1
    assert rows(spark, root, region="eu-west-2", day="2026-04-09").count() == 4


def test_unpack(spark, root, tmp_path):
    out = str(tmp_path / "lines")
    snapshots.unpack(spark, root, out, day="2026-04-09")
    lines = [r["value"] for r in spark.read.text(out).collect()]
    assert len(lines) == 8 and all(line.startswith("{") for line in lines)


def test_append_and_read_keeps_account_text(spark, root, tmp_path):
    path = str(tmp_path / "table")
    tables.append(rows(spark, root), path)
    tables.append(rows(spark, root), path)
    got = tables.read_operational(spark, path)
    assert got.columns == list(OPERATIONAL_COLUMNS) and got.count() == 10
    assert {r[0] for r in got.select("account_id").distinct().collect()} == {
        "000000000012", "000000000099",
    }


def test_export_replaces_touched_accounts_only(spark, root, tmp_path):
    path = str(tmp_path / "export")
    tables.export_parquet(rows(spark, root), path)
    tables.export_parquet(rows(spark, root, region="us-east-1"), path)
    assert tables.count_export(spark, path) == 5
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert files and all(".zstd." in f for f in files)


def test_hot_account_is_split_over_files(spark, tmp_path):
    """One account with most rows does not end up in one task."""
    big = spark.range(200_000).select(
        F.when(F.col("id") % 3 > 0, "000000000001").otherwise(F.lpad(F.col("id") % 7, 12, "0")).alias("account_id"),
        F.concat(F.lit("arn:"), F.col("id")).alias("arn"),
        F.lit("T").alias("resource_type"),
        F.sha2(F.col("id").cast("string"), 512).alias("configuration"),
    )
    sizes = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
        "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.2",
    }
    for key, value in sizes.items():
        spark.conf.set(key, value)
    try:
        path = str(tmp_path / "hot")
        tables.append(big, path)
    finally:
        for key in sizes:
            spark.conf.unset(key)
    hot = [f for f in os.listdir(f"{path}/account_id=000000000001") if f.endswith(".parquet")]
    assert len(hot) > 3
    assert spark.read.parquet(path).count() == 200_000


def test_compaction_makes_fewer_files(spark, root, tmp_path):
    small, compact = str(tmp_path / "small"), str(tmp_path / "compact")
    for _ in range(5):
        rows(spark, root).write.mode("append").partitionBy("account_id").parquet(small)
    count = lambda p: sum(f.endswith(".parquet") for _, _, n in os.walk(p) for f in n)
    before = count(small)
    got = tables.compact_files(spark, small, compact)
    assert got.count() == 25 and count(compact) == 2 < before
    with pytest.raises(ValueError):
        tables.compact_files(spark, small, small + "/")


def broken(root, name, data):
    path = folder(root)
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "wb") as out:
        out.write(data)
    return os.path.join(path, name)


def run_stream(spark, root, store, **kwargs):
    query = stream_ingest(spark, root, store, store + "-progress", interval=None, **kwargs)
    query.awaitTermination()
    return InventoryStore(spark, store)


def test_stream_lands_batches_and_sets_bad_files_aside(spark, root, tmp_path):
    deliver(root, "array.json.gz", None, document="[1,2]")
    deliver(root, "cut.json.gz", None, document='{"configurationItems": [ {')
    deliver(root, "empty.json.gz", None, document="")
    broken(root, "noarchive.json.gz", b"this is no archive")
    half = gzip.compress(b'{"configurationItems": [' + os.urandom(5000).hex().encode())
    broken(root, "half.json.gz", half[: len(half) // 2])
    store = run_stream(spark, root, str(tmp_path / "store"), files_per_batch=3, ingest_ts=T0)
    assert store.operational().count() == 5
    log = store.ingest_log().collect()
    assert len(log) >= 3 and sum(r["rows"] for r in log) == 5
    assert sum(r["dropped"] for r in log) == 4
    failed = {os.path.basename(r[0]) for r in store.failed_files(root).collect()}
    assert failed == {"array.json.gz", "cut.json.gz", "empty.json.gz", "noarchive.json.gz", "half.json.gz"}
    with pytest.raises(Exception, match="noarchive|half|empty"):
        snapshots.read_snapshots(spark, root).collect()
    read = snapshots.read_snapshots(spark, root, skip_broken=True)
    bad = snapshots.quarantine(read).collect()
    assert {os.path.basename(r["source_key"]) for r in bad} >= {"array.json.gz", "cut.json.gz"}


def test_stream_restart_takes_only_new_files(spark, root, tmp_path):
    path = str(tmp_path / "store")
    assert run_stream(spark, root, path).operational().count() == 5
    assert run_stream(spark, root, path).operational().count() == 5
    deliver(root, "new.json.gz", [item(ARN="arn:new")])
    store = run_stream(spark, root, path)
    assert store.operational().count() == 6
    assert store.ingest_log().count() == 2


def test_replayed_batch_replaces_itself(spark, root, tmp_path):
    store = InventoryStore(spark, str(tmp_path / "store"))
    read = snapshots.read_snapshots(spark, root)
    store.land(read, 0, T0)
    store.land(read, 0, T0)
    assert store.operational().count() == 5 and store.ingest_log().count() == 1


def test_days_and_account_limit_what_is_listed(spark, tmp_path):
    root = str(tmp_path / "days")
    for n in (1, 2, 3):
        deliver(root, f"d{n}.json.gz", [item(ARN=f"arn:{n}")], day=f"2026/4/{n}")
    deliver(root, "other.json.gz", [item(ARN="arn:9")], day="2026/4/1", account="000000000099")
    read = lambda **only: sorted(r["arn"] for r in rows(spark, root, **only).collect())
    assert read(day=["2026-04-01", "2026-04-03"]) == ["arn:1", "arn:3", "arn:9"]
    assert read(day="2026-04-01", account="000000000012") == ["arn:1"]
    assert read(account="000000000099") == ["arn:9"]


def test_batch_without_log_entry_is_not_read(spark, root, tmp_path):
    """A batch whose writing was cut off before the log entry does not count."""
    store = InventoryStore(spark, str(tmp_path / "store"))
    read = snapshots.read_snapshots(spark, root)
    store.land(read, 0, T0)
    from cloudinv.plans.store import classify

    store._write_kinds(classify(read, T0), f"{store.root}/landing/batch_id=1", "overwrite")
    assert store.operational().count() == 5


def test_nightly_folds_batches_into_the_table(spark, root, tmp_path):
    store = InventoryStore(spark, str(tmp_path / "store"))
    assert store.operational().count() == 0
    store.land(snapshots.read_snapshots(spark, root), 0, datetime(2026, 4, 1))
    store.land(snapshots.read_snapshots(spark, root, region="eu-west-2"), 1, T0)
    assert store.operational().count() == 9
    assert store.live(T0).count() == 4
    assert store.nightly(T0) == 0
    # The resource of the other account was last seen more than seven days ago.
    assert store.operational().count() == 4
    store.land(snapshots.read_snapshots(spark, root, region="us-east-1"), 2, T0)
    assert store.operational().count() == 5
    assert store.nightly(T0) == 1 and store.operational().count() == 5
    assert store.run_log().count() == 4
    # Nothing landed and nothing expired: the next run has no accounts to write.
    assert store.nightly(T0) == 2 and store.operational().count() == 5
    assert spark.read.schema("arn string").parquet(store._changes(2)).count() == 0
    # An account of which every row has expired is replaced as well.
    assert store.nightly(datetime(2026, 5, 1)) == 3 and store.operational().count() == 0


@pytest.mark.parametrize("cut", ["write_version", "replace_accounts"])
def test_a_nightly_run_that_was_cut_off_is_carried_on(spark, root, tmp_path, monkeypatch, cut):
    store = InventoryStore(spark, str(tmp_path / "store"))
    store.land(snapshots.read_snapshots(spark, root), 0, T0)
    store.nightly(T0)
    deliver(root, "more.json.gz", [item(ARN="arn:more"), item(ARN="arn:full", resourceName="renamed")])
    new = os.path.join(folder(root), "more.json.gz")
    store.land(snapshots.read_files(spark, [new]), 1, datetime(2026, 4, 9, 13))
    want = collected(store.operational().where("arn <> 'arn:full'"), "account_id", "arn")
    whole = getattr(store_module, cut)

    def half(df, *args):
        """One of the accounts is gone from the table when the driver is lost."""
        if cut == "replace_accounts":
            shutil.rmtree(f"{store.root}/table/account_id=000000000012")
        raise RuntimeError("lost")

    monkeypatch.setattr(store_module, cut, half)
    with pytest.raises(RuntimeError, match="lost"):
        store.nightly(T0)
    monkeypatch.setattr(store_module, cut, whole)
    assert collected(store.operational().where("arn <> 'arn:full'"), "account_id", "arn") == want
    store.land(snapshots.read_files(spark, [new]), 2, datetime(2026, 4, 9, 14))
    store.nightly(T0)
    names = {r["resource_name"] for r in store.operational().where("arn = 'arn:full' AND account_id = '000000000012'").collect()}
    assert names == {"renamed"} and store.operational().count() == 6
    assert spark.read.parquet(f"{store.root}/table").where("arn IS NOT NULL").count() == 6


def test_accounts_prune_the_table(spark, root, tmp_path):
    """A run reads the folders of touched accounts only."""
    path = str(tmp_path / "table")
    tables.append(rows(spark, root), path)
    base = tables.read_operational(spark, path)
    _, changed = maintenance.nightly_changes(base, base.where("account_id = '000000000099'"), T0)
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert {r["account_id"] for r in changed.collect()} == {"000000000099"}


def test_landing_reads_nothing_back(spark, root, tmp_path, monkeypatch):
    """The log is observed while rows are written, so the batch's own folder is never scanned."""
    store = InventoryStore(spark, str(tmp_path / "store"))
    monkeypatch.setattr(store, "put", lambda name, rows, batch_id: logged.__setitem__(name, rows))
    logged = {}
    store.land(snapshots.read_snapshots(spark, root), 7, T0)
    for rows_ in logged.values():
        assert not rows_.inputFiles()
    (entry,) = logged["ingest_log"].drop("ingest_ts").collect()
    assert entry.asDict() == dict(files=4, rows=5, dropped=4, bad_files=0, accounts=2, types=1)


def test_a_trigger_lands_many_batches(spark, root, tmp_path):
    """Each has its own entry in the log, and all are written by one job."""
    path = str(tmp_path / "store")
    deliver(root, "bad.json.gz", None, document="[1,2]")
    store = run_stream(spark, root, path, files_per_batch=1, ingest_ts=T0)
    log = store.ingest_log().collect()
    assert [f for f in os.listdir(f"{path}/landing") if f.startswith("batch_id=")] == ["batch_id=0"]
    assert sorted((r.files, r.rows, r.dropped, r.bad_files, r.accounts, r.types) for r in log) == [
        (1, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0), (1, 0, 0, 1, 0, 0), (1, 1, 0, 0, 1, 1), (1, 4, 4, 0, 1, 1),
    ]
    kinds = {(os.path.basename(r.source_key), r.kind) for r in store.file_log().collect()}
    assert kinds == {
        ("a b+c.json.gz", "row"), ("a b+c.json.gz", "dropped"), ("other.json.gz", "row"),
        ("none.json.gz", "empty"), ("absent.json.gz", "empty"), ("bad.json.gz", "bad"),
    }


# -- messages ----------------------------------------------------------------------------


def message(*paths, bucket="", at="2026-04-09T12:00:00.000Z", version="1"):
    one = lambda p: {"eventTime": at, "s3": {"bucket": {"name": bucket}, "object": {"key": quote_plus(p, safe="/"), "sequencer": version}}}
    return json.dumps({"Records": [one(p) for p in paths]})


def post(folder_, name, *lines):
    os.makedirs(folder_, exist_ok=True)
    with open(os.path.join(folder_, name), "w") as out:
        out.write("\n".join(lines))


def run_events(spark, messages, store, **kwargs):
    query = stream_events(spark, messages, store, store + "-progress", "file:{bucket}{key}", interval=None, ingest_ts=T0, **kwargs)
    query.awaitTermination()
    return InventoryStore(spark, store)


def test_notices(spark):
    lines = [message("/x/a b+c é.json.gz", "/x/other.txt"), message("k.json.gz", bucket="b/"), '{"Event": "test"}', "no json", ""]
    got = notices.parse_notices(spark.createDataFrame([(line,) for line in lines], "value string"), "file:{bucket}{key}")
    assert collected(got, "path", "version") == [("file:/x/a b+c é.json.gz", "1"), ("file:b/k.json.gz", "1")]


def test_doubled_and_late_messages_land_once(spark, root, tmp_path):
    first = os.path.join(folder(root), "a b+c.json.gz")
    second = os.path.join(folder(root, account="000000000099", region="us-east-1", day="2026/12/31"), "other.json.gz")
    messages, path = str(tmp_path / "messages"), str(tmp_path / "store")
    post(messages, "1", message(first), message(first), '{"Event": "test"}')
    assert run_events(spark, messages, path, files_per_batch=1).operational().count() == 4
    # The file is told of again by a later start, and the other one's message is months late.
    post(messages, "2", message(first, second, at="2025-01-01T00:00:00.000Z"), message(os.path.join(folder(root), "skipped.json")))
    store = run_events(spark, messages, path, files_per_batch=1)
    assert store.operational().count() == 5 and store.dead_letters().count() == 0
    # A new version of the object is another file.
    post(messages, "3", message(second, version="2"))
    assert run_events(spark, messages, path).operational().count() == 6


def test_state_is_not_brought_into_one_task(spark, root, tmp_path):
    """What a batch asks for is written as one file, but its state is not computed by one task."""
    messages, path, plans = str(tmp_path / "messages"), str(tmp_path / "store"), []
    post(messages, "1", message(os.path.join(folder(root), "a b+c.json.gz")))
    put = InventoryStore.put

    def seen(self, name, rows_, batch_id):
        if name == "tasks":
            plans.append(rows_._jdf.queryExecution().optimizedPlan().toString())
        return put(self, name, rows_, batch_id)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(InventoryStore, "put", seen)
        assert run_events(spark, messages, path).operational().count() == 4
    assert plans and all("Repartition 1, true" in p for p in plans)


def test_state_has_a_partition_for_each_core(spark, root, tmp_path):
    """Not as many as a shuffle of the whole session; a checkpoint keeps its number."""
    messages, path = str(tmp_path / "messages"), str(tmp_path / "store")
    post(messages, "1", message(os.path.join(folder(root), "a b+c.json.gz")))

    def started(**kwargs):
        query = stream_events(spark, messages, path, path + "-progress", "file:{bucket}{key}", interval=None, **kwargs)
        query.awaitTermination()
        progress = json.loads(query.lastProgress.json)
        return {o["numShufflePartitions"] for o in progress["stateOperators"]}

    with setting(spark, "spark.sql.shuffle.partitions", "11"):
        assert started() == {8}
        assert spark.conf.get("spark.sql.shuffle.partitions") == "11"
        post(messages, "2", message(os.path.join(folder(root), "none.json.gz")))
        assert started(state_partitions=3) == {8}
    assert InventoryStore(spark, path).operational().count() == 4


def test_a_batch_takes_many_message_files(spark, root, tmp_path):
    messages, path = str(tmp_path / "messages"), str(tmp_path / "store")
    names = ["a b+c.json.gz", "none.json.gz", "absent.json.gz"]
    for n, name in enumerate(names):
        post(messages, str(n), message(os.path.join(folder(root), name)))
    store = run_events(spark, messages, path, files_per_batch=1)
    (entry,) = store.ingest_log().where("files > 0").collect()
    assert (entry["files"], entry["rows"]) == (3, 4)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_messages_name_the_files(spark, root, tmp_path, scheme):
    out = str(tmp_path / "messages")
    write_messages(spark, scheme + root, out)
    got = notices.parse_notices(spark.read.text(out), "{bucket}/{key}").select("path").distinct()
    listed = snapshots.list_files(spark, root, "*.json.gz").select("path")
    assert collected(got) == collected(listed)


def test_failing_files_get_three_attempts(spark, root, tmp_path):
    """Also when the driver is lost after a batch was landed and before its checkpoint was written."""
    deliver(root, "array.json.gz", None, document="[1,2]")
    deliver(root, "cut.json.gz", None, document='{"configurationItems": [ {')
    broken(root, "noarchive.json.gz", b"this is no archive")
    here = folder(root)
    names = ["a b+c.json.gz", "array.json.gz", "cut.json.gz", "noarchive.json.gz", "absent-file.json.gz"]
    messages, path = str(tmp_path / "messages"), str(tmp_path / "store")
    post(messages, "1", *[message(os.path.join(here, n)) for n in names])
    put, lost = InventoryStore.put, []

    def put_then_fail(self, name, rows_, batch_id):
        found = put(self, name, rows_, batch_id)
        if name == "outcomes" and not lost:
            lost.append(batch_id)
            raise RuntimeError("lost")
        return found

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(InventoryStore, "put", put_then_fail)
        with pytest.raises(Exception, match="lost"):
            run_events(spark, messages, path)
    run_events(spark, messages, path)
    # One of them is repaired before its second attempt.
    deliver(root, "cut.json.gz", [item(ARN="arn:repaired")])
    for _ in range(3):
        store = run_events(spark, messages, path)
    dead = {(os.path.basename(r.path), r.attempt) for r in store.dead_letters().collect()}
    assert dead == {("array.json.gz", 3), ("noarchive.json.gz", 3), ("absent-file.json.gz", 3)}
    assert store.operational().count() == 5
    tries = store.file_log().where("kind = 'bad'").groupBy("source_key").count().collect()
    assert {os.path.basename(r.source_key): r["count"] for r in tries} == {"array.json.gz": 3, "cut.json.gz": 1}
    before = spark.read.parquet(f"{path}/tasks").count()
    run_events(spark, messages, path)
    assert spark.read.parquet(f"{path}/tasks").count() == before


def test_schema_files(spark, tmp_path):
    (tmp_path / "AWS::EC2::Volume.properties.json").write_text('{"b.c": "string", "a": "integer"}')
    (tmp_path / "AWS::S3::Bucket.properties.json").write_text("{}")
    (tmp_path / "AWS::EC2::Volume.md").write_text("# AWS::EC2::Volume\n")
    fields = schemas.read_schema_fields(spark, str(tmp_path))
    assert collected(fields) == [
        ("AWS::EC2::Volume", "a", "integer"),
        ("AWS::EC2::Volume", "b.c", "string"),
    ]
    docs = schemas.read_documents(spark, str(tmp_path))
    assert collected(docs) == [("AWS::EC2::Volume", "# AWS::EC2::Volume\n")]


def test_documents_are_written_one_file_per_type(spark, tmp_path):
    root = str(tmp_path / "docs")
    docs = spark.createDataFrame([("AWS::EC2::Volume", "# é\n"), ("a b#%+", "x"), ("none", None)], "resource_type string, document string")
    schemas.write_documents(docs, root)
    assert collected(schemas.read_documents(spark, root)) == [("AWS::EC2::Volume", "# é\n"), ("a b#%+", "x")]
    assert os.path.getsize(f"{root}/none.md") == 0  # Spark gives no row for an empty file.
    # More files are added, or take the place of all others of the suffix.
    (tmp_path / "docs" / "kept.txt").write_text("other")
    schemas.write_documents(docs.where("document = 'x'").withColumn("document", F.lit("y")), root, "append")
    assert sorted(os.listdir(root)) == ["AWS::EC2::Volume.md", "a b#%+.md", "kept.txt", "none.md"]
    schemas.write_documents(docs.where("document = 'x'"), root)
    assert sorted(os.listdir(root)) == ["a b#%+.md", "kept.txt"]
    schemas.write_documents(docs.where("false"), root)
    assert os.listdir(root) == ["kept.txt"]


def test_a_failed_write_leaves_the_files_as_they_were(spark, tmp_path):
    root = str(tmp_path / "docs")
    write = lambda rows_: schemas.write_documents(
        spark.createDataFrame(rows_, "resource_type string, document string").repartition(4), root
    )
    write([("a", "1"), ("b", "2")])
    for bad in ([("a", "new"), ("c", "3"), ("x/y", "no name")], [("a", "new"), ("c", "3"), ("c", "4")], [("a", "new"), (None, "4")]):
        with pytest.raises(Exception):
            write(bad)
        assert collected(schemas.read_documents(spark, root)) == [("a", "1"), ("b", "2")]
        assert sorted(os.listdir(root)) == ["a.md", "b.md"]


def test_list_files_reads_no_contents(spark, root):
    listed = snapshots.list_files(spark, root, "*.json.gz")
    assert listed.count() == 4
    assert all(r["bytes"] > 0 for r in listed.collect())


def test_crash_after_landing_is_replayed_without_doubles(spark, root, tmp_path, monkeypatch):
    """The driver is lost after a batch is written and before its checkpoint is."""
    path = str(tmp_path / "store")
    original, calls = InventoryStore.land, []

    def land_then_fail(self, *args):
        original(self, *args)
        calls.append(args[1])
        if len(calls) == 1:
            raise RuntimeError("lost")

    monkeypatch.setattr(InventoryStore, "land", land_then_fail)
    with pytest.raises(Exception, match="lost"):
        run_stream(spark, root, path)
    store = run_stream(spark, root, path)
    assert calls == [0, 0]
    assert store.operational().count() == 5 and store.ingest_log().count() == 1


def test_workspace_follows_the_cluster(tmp_path):
    from types import SimpleNamespace

    from cloudinv.session import workspace

    def session(master, **conf):
        return SimpleNamespace(
            conf=SimpleNamespace(get=conf.get), sparkContext=SimpleNamespace(master=master)
        )

    shared = session("spark://host:7077", **{"spark.checkpoint.dir": str(tmp_path)})
    first, second = workspace(shared), workspace(shared)
    assert first.startswith(str(tmp_path)) and first != second
    with pytest.raises(ValueError):
        workspace(session("spark://host:7077"))


def test_default_day_is_today(spark, tmp_path):
    day = snapshots.today()
    deliver(tmp_path, "now.json.gz", [item()], day=f"{day.year}/{day.month}/{day.day}")
    deliver(tmp_path, "then.json.gz", [item(), item()], day="2020/1/2")
    out = str(tmp_path / "lines")
    snapshots.unpack(spark, str(tmp_path), out)
    assert spark.read.text(out).count() == 1


def test_stream_by_interval(spark, root, tmp_path):
    path = str(tmp_path / "store")
    query = stream_ingest(spark, root, path, path + "-progress", interval="1 seconds")
    try:
        query.processAllAvailable()
        deliver(root, "later.json.gz", [item(ARN="arn:later")])
        query.processAllAvailable()
    finally:
        query.stop()
    assert InventoryStore(spark, path).operational().count() == 6
