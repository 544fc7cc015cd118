"""Time the headline queries; prints one JSON line.

The inventory table is built once from the given tables and stored as partitioned
parquet; the catalogue then runs over it the way a user would. Each query runs once to
warm up; the median of three more runs counts, written to a sink that discards rows.
"""

import contextlib
import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cloudinv import schema as S
from cloudinv.demo import files, items
from cloudinv.demo.queries import QUERIES
from cloudinv.operators import maintenance, relations, shaping, stats
from cloudinv.plans import catalog
from cloudinv.session import configure, workspace
from cloudinv.sources import snapshots, tables

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Over the stored table: every question of the catalogue and the dashboards.
CATALOGUE = {
    "type_histogram": catalog.type_histogram,
    "instances_per_account": catalog.instances_per_account,
    "top_accounts": catalog.top_accounts,
    "largest_volumes": catalog.largest_volumes,
    "tag_aggregation": lambda live: catalog.count_by_tag(live, types=(S.INSTANCE,)),
    "functions_by_runtime": catalog.functions_by_runtime,
    "engines_by_version": catalog.engines_by_version,
    "instance_volume_join": catalog.instance_volumes,
    "instance_volume_join_all": lambda live: catalog.instance_volumes(live, limit=None),
    "function_role_join": catalog.function_roles,
    "volume_key_join": catalog.volume_keys,
    "subnet_occupancy_join": catalog.top_subnets,
    "vpc_pivot_join": catalog.top_vpcs,
    "orphan_keys": catalog.orphan_keys,
    "empty_subnets": catalog.empty_subnets,
    "roles_trusting": lambda live: catalog.roles_trusting(live, "ec2.amazonaws.com"),
    "edge_counts": relations.edge_counts,
    "resolve_edges": relations.resolve_edges,
    "overview": stats.overview,
    "by_account": stats.by_account,
    "by_region": stats.by_region,
    "latest": maintenance.latest,
}

# Straight over the given tables.
DIRECT = (
    "m1_latest",
    "m2_merge_update",
    "q17_state_changes",
    "v1_cosine_topk",
    "v2_normalize",
    "v4_render_docs",
    "g2_validate_sql",
    "g4_stage_timings",
    "g5_timing_report",
    "p4_parse_ts",
    "p10_search_text",
)


def _session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("cloudinv-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # A cluster keeps the default of 64 MB; here it would leave one busy core.
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("FATAL")
    return configure(spark)


def _timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def _run(make) -> float:
    def once():
        make().write.format("noop").mode("overwrite").save()

    once()
    return statistics.median(_timed(once) for _ in range(3))


def main() -> None:
    with contextlib.redirect_stdout(sys.stderr):
        spark = _session()
        path = workspace(spark, "bench") + "/table"
        took: dict[str, float] = {}

        operational = items.operational(spark, SF_DIR)
        tables.append(operational, path + "-warm", payload=True)
        took["build_and_append"] = _timed(lambda: tables.append(operational, path, payload=True))
        stored = tables.read_parsed(spark, path)

        def nightly():
            tables.write_version(maintenance.nightly(tables.read_operational(spark, path), items.AS_OF), path + "-v1")

        nightly()
        took["nightly_version"] = _timed(nightly)

        base = tables.read_operational(spark, path + "-v1")
        landed = base.where("account_id = '000000000003'").withColumn(
            "last_seen_at", F.lit(items.AS_OF).cast("timestamp")
        )

        def one_account():
            _, rows = maintenance.nightly_changes(base, landed, items.AS_OF)
            tables.write_version(rows, path + "-v2")

        one_account()
        took["nightly_one_account"] = _timed(one_account)
        for name, question in CATALOGUE.items():
            took[name] = _run(lambda q=question: q(shaping.live(stored, items.AS_OF)))

        source = f"{path}-snapshots"
        files.write_snapshots(spark, SF_DIR, source)
        read = snapshots.read_snapshots(spark, source)
        took["ingest_snapshots"] = _run(
            lambda: shaping.flatten_items(shaping.explode_items(read), items.INGESTED)
        )
        for name in DIRECT:
            took[name] = _run(lambda n=name: QUERIES[n](spark, SF_DIR))
        rows = stored.count()

    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "inventory_rows": rows,
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
