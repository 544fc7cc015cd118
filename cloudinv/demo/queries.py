"""The registered queries: every operator over the given tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudinv import schema as S
from cloudinv.demo import files, items
from cloudinv.demo.items import AS_OF, INGESTED, table
from cloudinv.functions.jsonpath import json_scalar, json_value
from cloudinv.functions.text import source_key
from cloudinv.functions.times import parse_ts
from cloudinv.functions.vectors import norm, normalize
from cloudinv.operators import audit, maintenance, relations, retrieval, shaping, stats
from cloudinv.plans import catalog
from cloudinv.plans.store import InventoryStore
from cloudinv.plans.views import register_live
from cloudinv.session import configure, workspace
from cloudinv.sources import items as item_source
from cloudinv.sources import schemas, snapshots, tables
from cloudinv.streaming.attempts import MAX_ATTEMPTS
from cloudinv.streaming.ingest import stream_events, stream_ingest

Query = Callable[[SparkSession, str], DataFrame]

_NTZ = "timestamp_ntz"


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.live(items.operational(spark, sf_dir), AS_OF)


def _catalogued(question: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, sf_dir: question(_live(spark, sf_dir), *args, **kwargs)


def _plain_times(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(n).cast(_NTZ).alias(n) if t == "timestamp" else F.col(n) for n, t in df.dtypes]
    )


# -- sources and sinks -------------------------------------------------------------


def _delivered(spark: SparkSession, sf_dir: str) -> str:
    root = workspace(spark, "snapshots")
    files.write_snapshots(spark, sf_dir, root)
    return root


# Every column but the source, which differs by run; of it only the suffix is shown.
_ROW = tuple(c for c in S.OPERATIONAL_COLUMNS if c != "source_key")
_FROM_FILE = "source_key LIKE '%.json.gz' AS from_file"


def _flat(read: DataFrame, strict: bool = True) -> DataFrame:
    rows = shaping.flatten_items(shaping.explode_items(read), INGESTED, strict)
    # The lenient form has no source.
    return _plain_times(rows.select(*_ROW, *([F.expr(_FROM_FILE)] if strict else [])))


def read_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(snapshots.read_snapshots(spark, _delivered(spark, sf_dir)))


def read_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(snapshots.read_snapshots(spark, _delivered(spark, sf_dir)), strict=False)


def read_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaping.flatten_items(item_source.read_items(spark, _delivered(spark, sf_dir)), INGESTED)
    return _plain_times(rows.select(*_ROW, F.expr(_FROM_FILE)))


def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of whole documents and the number of files that are none, from one pass."""
    root = _delivered(spark, sf_dir)
    files.write_bad_snapshots(spark, sf_dir, root)
    texts = item_source.read_item_texts(spark, root)
    return texts.agg(F.count("value").alias("items"), F.count("error").alias("bad_files"))


def lines_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_fields(item_source.read_lines(spark, _delivered(spark, sf_dir), files.REGION, files.DAYS[0]))


def read_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = snapshots.read_snapshots(
        spark, _delivered(spark, sf_dir), region=files.REGION, day=files.DAYS[1]
    )
    return _flat(read)


def read_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _delivered(spark, sf_dir)
    files.write_other_files(spark, sf_dir, root)
    exploded = shaping.explode_items(snapshots.read_snapshots(spark, root))
    return exploded.groupBy(
        F.col("source_key").endswith(".json.gz").alias("snapshot_file")
    ).agg(F.count(F.lit(1)).alias("items"))


def read_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _delivered(spark, sf_dir)
    files.write_bad_snapshots(spark, sf_dir, root)
    bad = snapshots.quarantine(snapshots.read_snapshots(spark, root))
    return bad.select(
        json_scalar(F.col("raw"), "$.configSnapshotId").alias("lang"),
        json_scalar(F.col("raw"), "$.configurationItems").try_cast("bigint").alias("documents"),
    )


def _streamed(
    spark: SparkSession, sf_dir: str, files_per_batch: int = 25, bad: bool = True
) -> InventoryStore:
    source = _delivered(spark, sf_dir)
    if bad:
        files.write_bad_snapshots(spark, sf_dir, source)
    root = workspace(spark, "store")
    query = stream_ingest(
        spark, source, root, f"{root}-progress", interval=None, ingest_ts=_instant(INGESTED),
        files_per_batch=files_per_batch,
    )
    query.awaitTermination()
    return InventoryStore(spark, root)


def _instant(text: str):
    from datetime import datetime, timezone

    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def streamed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_times(_streamed(spark, sf_dir).live(AS_OF).select(*_ROW, F.expr(_FROM_FILE)))


def _by_events(spark: SparkSession, sf_dir: str, bad: bool, starts: int) -> InventoryStore:
    """A store fed by messages; each start of the stream makes one attempt at what failed before."""
    source, messages = _delivered(spark, sf_dir), workspace(spark, "messages")
    if bad:
        files.write_bad_snapshots(spark, sf_dir, source)
    files.write_messages(spark, source, messages)
    root = workspace(spark, "store")
    for _ in range(starts):
        stream_events(
            spark, messages, root, f"{root}-progress", "{bucket}/{key}", interval=None, ingest_ts=_instant(INGESTED)
        ).awaitTermination()
    return InventoryStore(spark, root)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of files named by messages, of which every second comes twice and every third late."""
    store = _by_events(spark, sf_dir, bad=False, starts=1)
    return _plain_times(store.live(AS_OF).select(*_ROW, F.expr(_FROM_FILE)))


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are no snapshots, given up after all attempts, and how often each was read."""
    store = _by_events(spark, sf_dir, bad=True, starts=MAX_ATTEMPTS + 1)
    dead = store.dead_letters().select("path", "attempt")
    tried = store.file_log().groupBy(F.col("source_key").alias("path")).agg(F.count_distinct("batch_id").alias("reads"))
    raw = snapshots.quarantine(snapshots.read_files(spark, [r["path"] for r in dead.collect()]))
    found = raw.withColumnRenamed("source_key", "path").join(dead, "path").join(tried, "path")
    return found.select(
        json_scalar(F.col("raw"), "$.configSnapshotId").alias("lang"),
        json_scalar(F.col("raw"), "$.configurationItems").try_cast("bigint").alias("documents"),
        F.col("attempt").alias("attempts"),
        "reads",
    )


def ingest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all batches together hold, and how many of four files each there were."""
    log = _streamed(spark, sf_dir, files_per_batch=4).ingest_log()
    return log.agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("files").alias("files"),
        F.sum("rows").alias("rows"),
        F.sum("dropped").alias("dropped"),
        F.sum("bad_files").alias("bad_files"),
        F.max("types").alias("types"),
    )


def ingest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of each batch of one file, from the log of a streamed store."""
    log = _streamed(spark, sf_dir, files_per_batch=1, bad=False).ingest_log()
    return log.select("rows", "accounts", "types")


def _parsed(question: Callable[..., DataFrame], **kwargs) -> Query:
    """A question over a stored table with its payload parsed when it was written."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = workspace(spark, "parsed")
        own = items.operational(spark, sf_dir).select(*items.OWN)
        tables.append(own, path, payload=True, complete=items.completed)
        return question(shaping.live(tables.read_parsed(spark, path), AS_OF), **kwargs)

    return run


def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "table")
    tables.append(items.subnets(spark, sf_dir), path)
    tables.append(items.interfaces(spark, sf_dir), path)
    return tables.read_operational(spark, path).select(
        "account_id", "arn", "resource_type", "state_hash", "configuration", "relationships"
    )


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interfaces of all regions, then keys of one region replace its accounts."""
    path = workspace(spark, "export")
    keys = items.keys(spark, sf_dir).where(F.col("aws_region") == "ASIA")
    tables.export_parquet(items.interfaces(spark, sf_dir).drop("source_key"), path)
    tables.export_parquet(keys.drop("source_key"), path)
    exported = tables.read_operational(spark, path)
    return stats.cube(exported, "account_id", "resource_type")


def export_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "export")
    tables.export_parquet(items.interfaces(spark, sf_dir), path)
    return spark.range(1).select(F.lit(tables.count_export(spark, path)).cast("bigint").alias("rows"))


def unpack_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, out = _delivered(spark, sf_dir), workspace(spark, "lines")
    snapshots.unpack(spark, source, out, files.REGION, files.DAYS[0])
    return _line_fields(spark.read.text(out))


def _line_fields(lines: DataFrame) -> DataFrame:
    return lines.select(
        json_scalar(F.col("value"), "$.resourceId").alias("resource_id"),
        json_scalar(F.col("value"), "$.awsAccountId").alias("account_id"),
        json_value(F.col("value"), "$.configuration").alias("configuration"),
    )


def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as one file per type and read back."""
    root = workspace(spark, "schemas")
    schemas.write_schema_fields(files.schema_fields(spark, sf_dir), root)
    return schemas.read_schema_fields(spark, root)


def upsert_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = files.schema_vectors(spark, sf_dir)
    new = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("key"),
        F.array("quality", "toxic").cast("array<float>").alias("embedding"),
        (F.col("quality") + 100).alias("service"),
    )
    merged = maintenance.upsert(old, new)
    return merged.select("key", "service", F.size("embedding").alias("dims"))


# -- row shaping ---------------------------------------------------------------------


def _exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.explode_items(snapshots.read_snapshots(spark, _delivered(spark, sf_dir)))


def exploded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(spark, sf_dir).select(
        F.col("item.awsAccountId").alias("account_id"),
        F.col("item.ARN").alias("arn"),
        F.col("item.resourceId").alias("resource_id"),
        F.col("item.configurationStateId").alias("state_id"),
    )


def identified_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaping.flatten_items(_exploded(spark, sf_dir), INGESTED)
    stacks = shaping.probe(rows, {"stack": "$['aws:cf:stack']"}, column="tags")
    return stacks.groupBy("stack").agg(F.count(F.lit(1)).alias("items"))


def json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(spark, sf_dir).select(
        F.col("item.resourceId").alias("resource_id"),
        F.col("item.tags").alias("tags"),
        F.col("item.relationships").alias("relationships"),
        F.col("item.configuration").alias("configuration"),
        F.col("item.supplementaryConfiguration").alias("supplementary_configuration"),
    )


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaping.flatten_items(_exploded(spark, sf_dir), INGESTED)
    return _plain_times(
        rows.select(
            "resource_id", "last_seen_at", F.col("source_key").endswith(".json.gz").alias("has_source")
        )
    )


def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = files.capture_text(F.col("ts"), F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", parse_ts(text).cast(_NTZ).alias("captured_at")
    )


def decoded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages as parts of an encoded path; a plus is a plus."""
    encoded = F.replace(F.url_encode(F.concat("url", F.lit(" é+%"))), F.lit("+"), F.lit("%20"))
    return table(spark, sf_dir, "pages").select(
        "page_id", source_key(F.concat(F.lit("s3://bucket/a+b/"), encoded, F.lit("/c.json.gz"))).alias("path")
    )


def merged_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the month in buckets by key, merged with what has come since."""
    path = workspace(spark, "buckets")
    before, since = _split(spark, sf_dir)
    tables.write_buckets(maintenance.merge_latest(before), path, 8)
    base = tables.read_buckets(spark, path, 8)
    return _plain_times(maintenance.merge_buckets(base, since).select(*_KEPT))


def live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = items.observations(spark, sf_dir)
    live = shaping.live(seen, items.latest_event(spark, sf_dir))
    return _plain_times(live.select("account_id", "arn", "source_key", "last_seen_at"))


def of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaping.of_type(_live(spark, sf_dir), S.SUBNET, S.VPC, S.ROLE)
    return rows.select("resource_type", "account_id", "resource_id", "resource_name")


def has_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaping.of_type(_live(spark, sf_dir), S.VOLUME, S.DB_INSTANCE)
    keyed = shaping.probe(rows, {"key_id": "$.kmsKeyId"}, keep=("resource_id",))
    return keyed.where(shaping.has_value(F.col("key_id")))


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shaping.search_text(table(spark, sf_dir, "documents"), "text", "THE", "tion", "%")
    return found.select("doc_id", "source")


# -- maintenance ---------------------------------------------------------------------

_KEPT = ("account_id", "arn", "source_key", "state_hash", "last_seen_at")


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_times(maintenance.latest(items.observations(spark, sf_dir)).select(*_KEPT))


def live_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = items.latest_event(spark, sf_dir)
    live = maintenance.live_latest(items.observations(spark, sf_dir), newest, ttl_hours=72)
    return _plain_times(live.select(*_KEPT))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Observations before and after the middle of the month."""
    seen = items.observations(spark, sf_dir)
    middle = F.lit("2024-01-16").cast("timestamp")
    return seen.where(F.col("last_seen_at") < middle), seen.where(F.col("last_seen_at") >= middle)


def merge_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _split(spark, sf_dir)
    return _plain_times(maintenance.merge_latest(target, source).select(*_KEPT))


def merge_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _split(spark, sf_dir)
    return _plain_times(maintenance.merge_latest(target, source, mode="update").select(*_KEPT))


def drop_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = items.observations(spark, sf_dir)
    kept = maintenance.drop_expired(seen, items.latest_event(spark, sf_dir))
    return _plain_times(kept.select(*_KEPT))


def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    many, few = workspace(spark, "small"), workspace(spark, "compact")
    for rows in _split(spark, sf_dir):
        tables.append(rows, many)
    return _plain_times(tables.compact_files(spark, many, few).select(*_KEPT))


def nightly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run over the first half of the month, then one over what has come since."""
    path, changes = workspace(spark, "table"), workspace(spark, "changes")
    before, since = _split(spark, sf_dir)
    tables.write_version(maintenance.nightly(before, "2024-01-16"), path)
    now = items.latest_event(spark, sf_dir)
    _, rows = maintenance.nightly_changes(tables.read_operational(spark, path), since, now)
    tables.write_version(rows, changes)
    tables.replace_accounts(tables.read_operational(spark, changes), path)
    return _plain_times(tables.read_operational(spark, path).select(*_KEPT))


def expired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored files, with rules of which one is the start of another."""
    stored = table(spark, sf_dir, "events").select(
        F.concat(F.lit("s3://"), "event_type", F.lit("/"), F.col("user_id"), F.lit("/click/"), "event_id").alias(
            "path"
        ),
        F.col("ts").cast("timestamp").alias("modified_at"),
    )
    rules = [("click/", 14), ("view/", 7), ("click/1", 3), ("purchase/", 1)]
    return _plain_times(maintenance.expired_files(stored, rules, "2024-01-20T00:00:00"))


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered files by a listing, against a rule for each part, two of which are for their folders."""
    root = _delivered(spark, sf_dir)
    files.write_bad_snapshots(spark, sf_dir, root)
    listed = snapshots.list_files(spark, root)
    place = root.split(":", 1)[-1].lstrip("/") + "/AWSLogs/"
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit(place), "p_name", F.lit("/"), "p_partkey")).limit(10_000)
    rules = [(r[0], 1) for r in parts.collect()] + [(place, 30), (f"{place}{0:012d}/Config/{files.REGION}/2024/1/15/", 3)]
    later = F.current_timestamp() + F.expr("interval 10 days")
    soon = maintenance.expired_files(listed, rules, later)
    latest_ = maintenance.expired_files(listed, rules, later + F.expr("interval 30 days")).join(soon, "path", "left_anti")
    return soon.select("days").unionByName(latest_.select("days")).groupBy("days").agg(F.count(F.lit(1)).alias("files"))


# -- statistics ------------------------------------------------------------------------


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_times(stats.overview(_live(spark, sf_dir)))


def overview_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = items.observations(spark, sf_dir)
    live = shaping.live(seen, items.latest_event(spark, sf_dir), ttl_hours=240)
    return _plain_times(stats.overview(live))


# -- relations ---------------------------------------------------------------------------


def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.resolve_edges(_live(spark, sf_dir))


def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_times(relations.state_changes(items.observations(spark, sf_dir)))


# -- retrieval ----------------------------------------------------------------------------


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cosine_topk(
        files.schema_vectors(spark, sf_dir), files.label_centres(spark, sf_dir)
    )


def cosine_topk_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cosine_topk(
        files.schema_vectors(spark, sf_dir),
        files.label_centres(spark, sf_dir),
        k=3,
        where=F.col("service").isin(2, 3, 5, 7),
    )


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x * (F.col("label") + 2))
    unit = table(spark, sf_dir, "embeddings").select("vec_id", normalize(scaled).alias("unit"))
    return unit.select(
        "vec_id",
        F.round(norm(F.col("unit")), 4).alias("length"),
        F.round(F.element_at("unit", 1).cast("double"), 4).alias("first"),
        F.round(F.element_at("unit", -1).cast("double"), 4).alias("last"),
    )


def render_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered from property files, written as one document per type and read back."""
    fields, docs = workspace(spark, "schemas"), workspace(spark, "documents")
    schemas.write_schema_fields(files.schema_fields(spark, sf_dir), fields)
    rendered = retrieval.render_docs(schemas.read_schema_fields(spark, fields), files.enrichments(spark, sf_dir))
    schemas.write_documents(rendered, docs)
    return schemas.read_documents(spark, docs)


def doc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.parse_doc_metadata(render_docs(spark, sf_dir))


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return retrieval.pending(raw, table(spark, sf_dir, "labels"), key="doc_id")


def invalid_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.invalid_paths(
        files.enrichments(spark, sf_dir), files.schema_fields(spark, sf_dir)
    )


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = cosine_topk(spark, sf_dir).withColumnRenamed("key", "resource_type")
    documents = files.documents(spark, sf_dir).withColumnRenamed("key", "resource_type")
    return retrieval.context_for(matches, documents)


# -- audit ------------------------------------------------------------------------------


def extract_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = files.model_answers(spark, sf_dir)
    return audit.extract_sql(answers).select("conv_id", "turn", "sql")


def validate_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = audit.extract_sql(files.model_answers(spark, sf_dir))
    return audit.validate_sql(answers).select("conv_id", "turn", "verdict")


def run_readonly(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_live(spark, _live(spark, sf_dir))
    return audit.run_readonly(
        spark,
        "SELECT aws_region, resource_type, count(*) AS n FROM operational_live "
        "WHERE lower(resource_type) LIKE '%ec2%' GROUP BY aws_region, resource_type "
        "ORDER BY n DESC, aws_region, resource_type",
    )


def null_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups without a subnet come last in their region, and the limit cuts within a region."""
    register_live(spark, _live(spark, sf_dir))
    return audit.run_readonly(
        spark,
        """
        SELECT aws_region, substr(json_extract_scalar(configuration, '$.subnetId'), 8, 1) AS "digit", COUNT(*) AS n
        FROM operational_live WHERE resource_type IN ('AWS::EC2::Instance', 'AWS::EC2::NetworkInterface')
        GROUP BY 1, 2 ORDER BY aws_region, "digit" LIMIT 47
        """,
    )


def run_json_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_live(spark, _live(spark, sf_dir))
    return audit.run_readonly(
        spark,
        """
        WITH machines AS (
          SELECT account_id, json_extract_scalar(configuration, '$.vpcId') AS vpc,
                 json_extract_scalar(configuration, '$.state.name') AS state,
                 json_extract_scalar(tags, '$.Environment') AS env
          FROM operational_live WHERE resource_type = 'AWS::EC2::Instance'
        ),
        networks AS (
          SELECT account_id, resource_id AS vpc,
                 json_extract_scalar(configuration, '$.cidrBlock') AS cidr
          FROM operational_live WHERE resource_type = 'AWS::EC2::VPC'
        )
        SELECT m.env AS "environment", n.cidr AS "cidr",
               COUNT(*) AS machines, COUNT(*) FILTER (WHERE m.state = 'F') AS stopped
        FROM machines m JOIN networks n ON m.vpc = n.vpc AND m.account_id = n.account_id
        GROUP BY m.env, n.cidr
        ORDER BY machines DESC, "environment", "cidr" LIMIT 50
        """,
    )


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.parse_jobs(files.job_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "s1_read_snapshots": read_all,
    "s1_read_by_item": read_by_item,
    "s1_broken_files": broken_files,
    "s2_read_one_day": read_day,
    "s3_skip_other_files": read_suffix,
    "s4_quarantine": read_quarantine,
    "s4_redelivery": redelivered,
    "s5_stream_ingest": streamed_rows,
    "s5_events": event_rows,
    "s6_append": append_rows,
    "s7_export_parquet": export_rows,
    "s8_count_export": export_count,
    "s9_unpack_lines": unpack_lines,
    "s9_lines_by_item": lines_by_item,
    "s10_schema_fields": schema_fields,
    "s11_upsert_vectors": upsert_vectors,
    "s12_ingest_log": ingest_log,
    "p1_explode_items": exploded_items,
    "p2_flatten_items": read_all,
    "p3_drop_unidentified": identified_items,
    "p3b_lenient_flatten": read_lenient,
    "p4_parse_ts": parse_times,
    "p5_json_text": json_text,
    "p6_stamps": stamps,
    "f10_decoded_paths": decoded_paths,
    "p7_live": live_rows,
    "p8_of_type": of_type,
    "p9_has_value": has_key,
    "p10_search_text": search,
    "p11_probe_fields": _catalogued(catalog.volume_encryption_fields),
    "m1_latest": latest,
    "m1_live_latest": live_latest,
    "m2_merge_collapse": merge_collapse,
    "m2_merge_update": merge_update,
    "m2_merge_buckets": merged_buckets,
    "m3_drop_expired": drop_expired,
    "m4_compact_files": compact,
    "m5_nightly": nightly,
    "m6_expired_files": expired_files,
    "m6_listed_files": listed_files,
    "a1_overview": overview,
    "a1_overview_observed": overview_observed,
    "a2_by_type": _catalogued(stats.by_type),
    "a2_by_type_three": _catalogued(stats.by_type, 3),
    "a3_by_account": _catalogued(stats.by_account),
    "a4_by_region": _catalogued(stats.by_region),
    "a5_totals": _catalogued(stats.totals),
    "a6_top_types": _catalogued(stats.by_type, 10),
    "a7_ingest_profile": ingest_profile,
    "q1_type_histogram": _catalogued(catalog.type_histogram),
    "q2_instances_per_account": _catalogued(catalog.instances_per_account),
    "q3_top_accounts": _catalogued(catalog.top_accounts),
    "q4_largest_volumes": _catalogued(catalog.largest_volumes),
    "q5_instances_by_tag": _catalogued(catalog.count_by_tag, types=(S.INSTANCE,)),
    "q5_all_by_tag": _catalogued(catalog.count_by_tag),
    "q6_functions_by_runtime": _catalogued(catalog.functions_by_runtime),
    "q7_engines_by_version": _catalogued(catalog.engines_by_version),
    "q8_instance_volumes": _catalogued(catalog.instance_volumes),
    "q8_instance_volumes_all": _catalogued(catalog.instance_volumes, limit=None),
    "q4_parsed_volumes": _parsed(catalog.largest_volumes),
    "q8_parsed_volumes_all": _parsed(catalog.instance_volumes, limit=None),
    "q12_parsed_vpcs": _parsed(catalog.top_vpcs),
    "q9_function_roles": _catalogued(catalog.function_roles, limit=None),
    "q10_volume_keys": _catalogued(catalog.volume_keys, limit=None),
    "q11_subnet_occupancy": _catalogued(catalog.subnet_occupancy),
    "q11_top_subnets": _catalogued(catalog.top_subnets),
    "q12_vpc_inventory": _catalogued(catalog.vpc_inventory),
    "q12_top_vpcs": _catalogued(catalog.top_vpcs),
    "q13_orphan_keys": _catalogued(catalog.orphan_keys),
    "q14_empty_subnets": _catalogued(catalog.empty_subnets),
    "q14_subnets_without_interfaces": _catalogued(
        catalog.empty_subnets, children=(S.NETWORK_INTERFACE,)
    ),
    "q15_roles_trusting": _catalogued(
        catalog.roles_trusting, "ec2.amazonaws.com", "sts:assumerole"
    ),
    "q16_resolved_edges": resolved_edges,
    "q16_edge_counts": _catalogued(relations.edge_counts),
    "q17_state_changes": state_changes,
    "v1_cosine_topk": cosine_topk,
    "v2_normalize": normalized,
    "v3_cosine_topk_where": cosine_topk_where,
    "v4_render_docs": render_docs,
    "v5_doc_metadata": doc_metadata,
    "v6_pending": pending,
    "v7_invalid_paths": invalid_paths,
    "v8_context": context,
    "g1_extract_sql": extract_sql,
    "g2_validate_sql": validate_sql,
    "g3_run_readonly": run_readonly,
    "g3_null_order": null_order,
    "g3_run_json_sql": run_json_sql,
    "g4_stage_timings": lambda spark, sf: audit.stage_timings(_jobs(spark, sf)),
    "g4_stage_rows": lambda spark, sf: audit.stage_rows(_jobs(spark, sf)).select(
        "job_id", "stage", "status", "ms"
    ),
    "g5_timing_report": lambda spark, sf: audit.timing_report(_jobs(spark, sf)),
    "g6_failures": lambda spark, sf: audit.failures(_jobs(spark, sf)),
}


def configured(query: Query) -> Query:
    return lambda spark, sf_dir: query(configure(spark), sf_dir)
