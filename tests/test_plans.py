"""The plans scale: filters reach the scan, few shuffles, no cross products, hot keys split."""

import json

import pytest
from helpers import collected, inventory
from pyspark.sql import functions as F

from cloudinv import schema as S
from cloudinv.demo import items
from cloudinv.demo.queries import QUERIES
from cloudinv.operators import audit, maintenance, relations, stats
from cloudinv.operators.shaping import live
from cloudinv.plans import catalog
from cloudinv.sources import tables

WRITES_FILES = ("s1_", "s2_", "s3_", "s4_", "s5_", "s6_", "s7_", "s8_", "s9_", "s12_",
                "p1_", "p2_", "p3_", "p3b_", "p5_", "p6_", "m4_", "m5_", "a7_")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("table") / "operational")
    tables.append(items.operational(spark, sf_dir), path)
    return tables.read_operational(spark, path)


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_filters_and_columns_reach_the_scan(table):
    text = catalog.largest_volumes(live(table, items.AS_OF))
    scan = text._jdf.queryExecution().explainString(
        text._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    pushed = next(line for line in scan.splitlines() if "PushedFilters" in line)
    assert f"EqualTo(resource_type,{S.VOLUME})" in pushed and "GreaterThan(last_seen_at" in pushed
    read = next(line for line in scan.splitlines() if "ReadSchema" in line)
    assert "configuration" in read and "relationships" not in read and "tags" not in read


def test_account_filter_prunes_partitions(table):
    text = plan(table.where("account_id = '000000000003'").groupBy("resource_type").count())
    assert "PartitionFilters: [isnotnull(account_id" in text


def test_type_filter_removes_other_sources(spark, sf_dir):
    keys = items.operational(spark, sf_dir).where(F.col("resource_type") == S.KEY)
    assert scans(keys) == 3  # parts, nations and regions


def test_top_lists_are_not_sorted_globally(table):
    for query in (catalog.top_subnets, catalog.top_vpcs, catalog.largest_volumes, stats.by_account):
        text = plan(query(table))
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_children_of_subnets_are_read_once(table):
    assert scans(catalog.subnet_occupancy(table)) == 2


def test_distinct_counts_expand_the_cube_only(table):
    """Reading from the scan upwards, rows are reduced before they are expanded."""
    lines = plan(stats.by_account(table)).splitlines()
    expand = next(i for i, line in enumerate(lines) if " Expand " in line)
    assert any("partial_count(1)" in line for line in lines[expand:])


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(WRITES_FILES)])
def test_no_cross_products(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    # File rules are looked up in a sorted index, by Arrow batches.
    assert "BatchEvalPython" not in text and ("ArrowEvalPython" not in text or name.startswith("m6_"))


def test_median_reads_job_documents_once(spark, sf_dir):
    report = QUERIES["g5_timing_report"](spark, sf_dir)
    report.collect()
    # They were read to count their times; all that follows is over the counts.
    final = plan(report).split("== Initial Plan ==")[0]
    assert "from_json" not in final and "get_json" not in final


HOT_SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
    # Eight partitions are few, so the hot one is only some five times the median.
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10k",
}


@pytest.fixture
def hot(spark):
    """An instance with a third of all volumes and a key used by a third of them."""
    for key, value in HOT_SETTINGS.items():
        spark.conf.set(key, value)
    n = 60_000
    ids = spark.range(0, n, 1, 12)
    instance = F.when(F.col("id") % 3 == 0, "i-hot").otherwise(F.concat(F.lit("i-"), F.col("id")))
    volumes = ids.select(
        F.lit("000000000001").alias("account_id"),
        F.lit(S.VOLUME).alias("resource_type"),
        F.concat(F.lit("v-"), F.col("id")).alias("resource_id"),
        F.to_json(
            F.struct(
                F.lit(1).alias("size"),
                F.lit(True).alias("encrypted"),
                F.concat(F.lit("k-"), instance).alias("kmsKeyId"),
                F.array(F.struct(instance.alias("instanceId"))).alias("attachments"),
                F.sha2(F.col("id").cast("string"), 512).alias("pad"),
            )
        ).alias("configuration"),
        F.to_json(
            F.array(
                F.struct(
                    instance.alias("resourceId"),
                    F.lit(S.INSTANCE).alias("resourceType"),
                    F.lit("Is attached to Instance").alias("name"),
                )
            )
        ).alias("relationships"),
    )
    others = ids.where("id % 3 != 0 or id = 0").select(
        F.lit("000000000001").alias("account_id"),
        F.lit(S.INSTANCE).alias("resource_type"),
        instance.alias("resource_id"),
        F.lit("{}").alias("configuration"),
        F.lit(None).cast("string").alias("relationships"),
    )
    keys = others.select(
        "account_id",
        F.lit(S.KEY).alias("resource_type"),
        F.concat(F.lit("k-"), F.col("resource_id")).alias("resource_id"),
        F.lit("{}").alias("configuration"),
        F.lit(None).cast("string").alias("relationships"),
    )
    rows = volumes.unionByName(others).unionByName(keys)
    empty = inventory(spark).drop(*rows.columns)
    full = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in empty.dtypes])
    yield full, n
    for key in HOT_SETTINGS:
        spark.conf.unset(key)


def test_hot_instance_is_split(hot):
    rows, n = hot
    joined = catalog.instance_volumes(rows, limit=None)
    joined.collect()
    assert "skew=true" in plan(joined)
    assert joined.count() == n
    assert joined.where("instance_id = 'i-hot'").count() == n // 3


def test_hot_key_is_split_or_reduced(hot):
    rows, n = hot
    assert catalog.volume_keys(rows, limit=None).count() == n
    assert catalog.orphan_keys(rows).count() == 0
    text = plan(catalog.orphan_keys(rows))
    assert "partial" in text or text.count("HashAggregate") >= 2


def test_hot_target_of_edges(hot):
    rows, n = hot
    got = relations.edge_counts(rows).collect()
    assert [(r["edge_count"], r["resolved_count"]) for r in got] == [(n, n)]
    resolved = relations.resolve_edges(rows)
    resolved.collect()
    assert "skew=true" in plan(resolved)
    assert resolved.where("target_id = 'i-hot'").count() == n // 3


def test_hot_key_of_an_update_is_split(hot):
    """A third of the target shares one key; newer rows of all keys arrive."""
    from cloudinv.operators import maintenance

    spark, n = hot[0].sparkSession, 60_000
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("arn")
    rows = lambda first, state: spark.range(first, first + n).select(
        F.lit("1").alias("account_id"), key, F.timestamp_seconds("id").alias("last_seen_at"), F.lit(state).alias("state_hash"),
    )
    updated = maintenance.merge_latest(rows(0, "old"), rows(n, "new"), mode="update")
    updated.collect()
    assert "skew=true" in plan(updated)
    assert updated.where("arn = 'hot' and state_hash = 'new'").count() == n // 3


def test_hot_key_state_changes(spark):
    """One resource with a third of all observations is compared slice by slice."""
    n = 90_000
    seen = spark.range(n).select(
        F.lit("a").alias("account_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("arn"),
        F.timestamp_seconds(F.col("id") * 5).alias("last_seen_at"),
        F.lit("f").alias("source_key"),
        F.floor(F.col("id") / 30).cast("string").alias("state_hash"),
    )
    got = relations.state_changes(seen)
    assert got.where("arn = 'hot'").count() == n // 30 - 1
    assert got.where("arn != 'hot'").count() == 0


def test_median_of_a_hot_group(spark):
    n = 90_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("stage"),
        (F.col("id") * 1.0).alias("ms"),
    )
    from cloudinv.functions.quantiles import exact_median

    got = {r["stage"]: r["median"] for r in exact_median(rows, "stage", "ms").collect()}
    hot_values = [i for i in range(n) if i % 3 < 2]
    cold_values = [i for i in range(n) if i % 3 == 2]
    mid = lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    assert got == {"hot": mid(hot_values), "cold": mid(cold_values)}


def test_median_of_very_many_values(spark, monkeypatch):
    """Of a bin with more values than one task orders only a part is ordered."""
    import random

    from cloudinv.functions import quantiles

    monkeypatch.setattr(quantiles, "STRETCH", 50)
    monkeypatch.setattr(quantiles, "PARTS", 8)
    rng = random.Random(3)
    groups = {
        "near": [1000.0 + rng.random() for _ in range(4001)],
        "even": [1000.0 + i / 1000 for i in range(3000)],
        "two": [5.0] * 2000 + [5.0001] * 2000,
        "one": [7.0] * 500,
        "wide": [rng.random() * 10 ** rng.randrange(9) for _ in range(999)],
    }
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    seen, reaching = [], quantiles._reaching

    def counted(parts, group, key):
        found = reaching(parts, group, key)
        seen.append(found.agg(F.max("different")).first()[0])
        return found

    monkeypatch.setattr(quantiles, "_reaching", counted)
    got = {r["g"]: (r["n"], r["min"], r["max"], r["median"]) for r in quantiles.exact_median(rows, "g", "v").collect()}
    mid = lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    assert got == {g: (len(v), min(v), max(v), mid(sorted(v))) for g, v in groups.items()}
    assert len(seen) > 2 and seen[0] > 50 >= seen[-1]


def test_merging_buckets_moves_no_base_row(spark, tmp_path):
    from datetime import timedelta

    from helpers import NOON

    row = lambda i, **more: dict(arn=f"arn:{i}", account_id=f"{i % 3:012d}", **more)
    base = inventory(spark, *[row(i, last_seen_at=NOON, state_hash="old") for i in range(300)])
    landed = inventory(
        spark,
        *[row(i, last_seen_at=NOON + timedelta(hours=1), state_hash="new") for i in range(290, 320)],
        *[row(i, last_seen_at=NOON - timedelta(hours=1), state_hash="late") for i in range(10)],
        row(0, last_seen_at=None, state_hash="unknown"),
    )
    path = str(tmp_path / "buckets")
    tables.write_buckets(base, path, 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = maintenance.merge_buckets(tables.read_buckets(spark, path, 8), landed)
        text = plan(merged)
        states = {r["arn"]: r["state_hash"] for r in merged.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = maintenance.merge_latest(base, landed)
    assert states == {r["arn"]: r["state_hash"] for r in want.collect()} and merged.count() == 320
    side = text[text.index("SortMergeJoin") :]
    bucketed = next(i for i, line in enumerate(side.splitlines()) if "Bucketed: true" in line)
    above = side.splitlines()[:bucketed]
    assert not any("Exchange" in line for line in above) and "FullOuter" in side


def test_timings_need_no_shuffle(spark, sf_dir):
    from cloudinv.demo import files

    jobs = audit.parse_jobs(files.job_documents(spark, sf_dir))
    text = plan(audit.stage_timings(jobs))
    assert "hashpartitioning" not in text and text.count("from_json") == 1
    assert plan(audit.stage_rows(jobs)).count("from_json") == 1


def test_only_types_that_edges_name_are_targets(spark):
    """Resources of other types are not brought to the join; results are as by a join with all."""
    points = lambda kind, name: json.dumps([{"resourceType": kind, "resourceId": name, "name": "in"}])
    rows = inventory(
        spark,
        dict(resource_type="A", resource_id="a", arn="arn:a"),
        dict(resource_type="A", resource_id="a", arn="arn:0"),
        dict(resource_type="B", resource_id="b", arn="arn:b", relationships=points("A", "a")),
        dict(resource_type="B", resource_id="b2", arn="arn:b2", relationships=points("C", "none")),
        dict(resource_type=None, resource_id="n", arn="arn:n"),
    )
    assert collected(relations._named_targets(rows), "target_type", "target_arn") == [("A", "arn:0"), ("A", "arn:a")]
    got = relations.resolve_edges(rows).select("source_id", "target_arn").collect()
    assert sorted(map(tuple, got)) == [("b", "arn:0"), ("b2", None)]
    counts = relations.edge_counts(rows).select("target_type", "edge_count", "resolved_count")
    assert collected(counts) == [("A", 1, 1), ("C", 1, 0)]


def test_parsed_payload_is_not_shuffled(spark, tmp_path, monkeypatch):
    plans, write = [], tables._writer

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, *args)

    monkeypatch.setattr(tables, "_writer", seen)
    path = str(tmp_path / "parsed")
    tables.append(inventory(spark, dict(arn="a", configuration={"size": 8}), dict(arn="b", configuration="no json")), path, payload=True)
    (found,) = plans
    assert found.index("payload") < found.index("Rebalance") and "payload" not in found[found.index("Rebalance"):]
    got = tables.read_parsed(spark, path).selectExpr("arn", "payload IS NULL", "payload_text")
    assert collected(got.toDF("arn", "none", "text")) == [("a", False, None), ("b", True, "no json")]


def test_columns_that_follow_from_others_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Such as the hash of the configuration; what the write has shuffled goes with its end."""
    cleanup, found, write = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], tables._writer

    def seen(df, *args):
        found.append((df._jdf.queryExecution().optimizedPlan().toString(), spark.conf.get(cleanup)))
        return write(df, *args)

    monkeypatch.setattr(tables, "_writer", seen)
    path, before = str(tmp_path / "parsed"), spark.conf.get(cleanup)
    whole = inventory(
        spark,
        dict(arn="arn:volume/vol-1/a", resource_id="vol-1/a", resource_type=S.VOLUME, configuration={"size": 8}),
        dict(arn="arn:key/", resource_id="", resource_type=S.KEY),
        dict(arn=None, resource_type=S.ROLE, aws_region="ASIA", configuration="no json"),
    )
    own = whole.select(*items.OWN)
    own = spark.createDataFrame(own.collect(), own.schema)
    tables.append(own, path, payload=True, complete=items.completed)
    ((text, during),) = found
    moved = text[text.index("Rebalance"):]
    assert "md5" in text and not any(c in moved for c in ("md5", "state_hash", "resource_id", "last_seen_at", "payload"))
    assert during == "true" and spark.conf.get(cleanup) == before
    got = tables.read_parsed(spark, path)
    assert collected(got, "resource_type", "arn", "resource_id", "availability_zone", "configuration", "payload_text") == collected(
        whole.selectExpr(
            "resource_type", "arn", "resource_id", "aws_region || '-a'", "configuration", "IF(configuration = 'no json', configuration, NULL)"
        )
    )
    assert got.where("state_hash = md5(configuration)").count() == 2
    # Rows that have more of their own keep it.
    more = whole.select(*items.OWN).withColumn("resource_id", F.lit("own"))
    assert {r["resource_id"] for r in items.completed(more).collect()} == {"own"}


@pytest.mark.parametrize("question", [catalog.largest_volumes, catalog.top_vpcs])
def test_parsed_questions_move_own_columns(spark, sf_dir, monkeypatch, question):
    """The registered queries over a parsed table write it that way."""
    plans, write = [], tables._writer

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, *args)

    monkeypatch.setattr(tables, "_writer", seen)
    name = "q4_parsed_volumes" if question is catalog.largest_volumes else "q12_parsed_vpcs"
    assert collected(QUERIES[name](spark, sf_dir)) == collected(question(live(items.operational(spark, sf_dir), items.AS_OF)))
    (found,) = plans
    assert "md5" in found and "md5" not in found[found.index("Rebalance"):]


def test_orders_find_their_homes_before_lines(spark, sf_dir):
    """So that lines, of which there are most, are shuffled for one join."""
    text = items.volumes(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in text.splitlines() if "Join" in line]
    at = {key: next(i for i, line in enumerate(joins) if key in line) for key in ("l_orderkey", "c_custkey")}
    assert at["l_orderkey"] < at["c_custkey"]
