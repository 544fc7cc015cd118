"""Snapshot files, job documents and model answers written from the given tables."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudinv import schema as S
from cloudinv.demo.items import _homes, account, table
from cloudinv.sources.snapshots import list_files

REGION = "eu-west-2"
DAYS = ("2024-01-15", "2024-01-30")
_ITEMS_PER_FILE = 2000
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def capture_text(ts: Column, kind: Column) -> Column:
    """The same time in the spellings snapshots use; sign-ups have none."""
    utc = ts.cast("timestamp")
    micros = F.unix_micros(utc)
    return (
        F.when(kind == "click", F.concat(F.date_format(utc, _ISO), F.lit("Z")))
        .when(
            kind == "view",
            F.concat(F.date_format(utc + F.expr("interval 2 hours"), _ISO), F.lit("+02:00")),
        )
        .when(kind == "purchase", F.date_format(utc, _ISO))
        .when(kind == "error", (micros.cast("decimal(20,0)") / 1000000).cast("decimal(20,6)").cast("string"))
        .otherwise("null")
    )


def delivered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as delivered items: errors lack the account, sign-ups the ARN."""
    events = table(spark, sf_dir, "events")
    homes = _homes(spark, sf_dir)
    kind = F.col("event_type")
    subnet = F.concat(F.lit("subnet-"), F.col("user_id"))
    eni = F.concat(F.lit("eni-"), F.col("event_id"))
    item = F.struct(
        F.when(kind != "error", account(F.col("c_nationkey"))).alias("awsAccountId"),
        F.when(kind == "signup", "").otherwise(F.concat(F.lit("arn:networkinterface/"), eni)).alias("ARN"),
        F.lit(S.NETWORK_INTERFACE).alias("resourceType"),
        eni.alias("resourceId"),
        F.when(kind != "view", F.concat(F.lit("interface "), F.col("event_id"))).alias("resourceName"),
        F.col("r_name").alias("awsRegion"),
        F.concat(F.col("r_name"), F.lit("-b")).alias("availabilityZone"),
        F.lit("OK").alias("configurationItemStatus"),
        capture_text(F.col("ts"), kind).alias("configurationItemCaptureTime"),
        F.concat(
            F.date_format(F.col("ts").cast("timestamp") - F.expr("interval 1 day"), _ISO), F.lit("Z")
        ).alias("resourceCreationTime"),
        F.col("event_id").alias("configurationStateId"),
        F.md5("props").alias("configurationStateMd5Hash"),
        F.struct(kind.alias("aws:cf:stack")).alias("tags"),
        F.struct(subnet.alias("subnetId"), F.col("vpc_id").alias("vpcId")).alias("configuration"),
        F.array(
            F.struct(
                subnet.alias("resourceId"),
                F.lit(S.SUBNET).alias("resourceType"),
                F.lit("Is contained in Subnet").alias("name"),
            )
        ).alias("relationships"),
        F.struct().alias("supplementaryConfiguration"),
    )
    return events.join(homes, events.user_id == homes.c_custkey).select(
        "event_id", (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("early"), item.alias("item")
    )


def write_snapshots(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Deliver all events in snapshot files of some two thousand items each.

    The event id spreads items over files, so no file depends on a hot value.
    """
    items = delivered_items(spark, sf_dir)
    files = max(1, math.ceil(table(spark, sf_dir, "events").count() / _ITEMS_PER_FILE))
    number = F.pmod("event_id", F.lit(files))
    for day, early in zip(DAYS, (True, False)):
        year, month, dom = (int(p) for p in day.split("-"))
        documents = (
            items.where(F.col("early") == early)
            .groupBy(number.alias("number"))
            .agg(F.collect_list("item").alias("configurationItems"))
            .select(
                F.lit("1.0").alias("fileVersion"),
                F.col("number").cast("string").alias("configSnapshotId"),
                "configurationItems",
            )
        )
        target = f"{root}/AWSLogs/{0:012d}/Config/{REGION}/{year}/{month}/{dom}/ConfigSnapshot"
        (
            documents.write.mode("append")
            .option("compression", "gzip")
            .option("maxRecordsPerFile", 1)
            .option("ignoreNullFields", False)
            .json(target)
        )


def write_bad_snapshots(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Files that are no snapshots: per language, text in place of the item list."""
    bad = (
        table(spark, sf_dir, "documents")
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("lang").alias("configSnapshotId"),
            F.col("n").cast("string").alias("configurationItems"),
        )
    )
    target = f"{root}/AWSLogs/{1:012d}/Config/{REGION}/2024/1/30/ConfigSnapshot"
    (
        bad.write.mode("append")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", 1)
        .json(target)
    )


def write_other_files(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Plain JSON files next to the snapshots, which a reader has to skip."""
    target = f"{root}/AWSLogs/{0:012d}/Config/{REGION}/2024/1/30/ConfigSnapshot"
    table(spark, sf_dir, "nation").write.mode("append").json(target)


def write_messages(spark: SparkSession, root: str, out: str) -> None:
    """A message for each file below a folder, some twice and some late, and one that names none."""
    names = list_files(spark, root).select("path", F.pmod(F.xxhash64("path"), F.lit(6)).alias("n"))
    # The listing spells the root its own way, such as with fewer slashes.
    cut = F.locate("/AWSLogs/", F.col("path"))
    key = F.replace(F.replace(F.url_encode(F.expr("substring(path, 1 + char_length(bucket))")), F.lit("%2F"), F.lit("/")), F.lit("%3D"), F.lit("="))
    day = F.when(F.col("n") % 3 == 0, "2024-01-01").otherwise("2024-02-01")
    record = F.struct(
        F.concat(day, F.lit("T00:00:00.000Z")).alias("eventTime"),
        F.struct(
            F.struct(F.expr("substring(bucket, 1, char_length(bucket) - 1)").alias("name")).alias("bucket"),
            F.struct(key.alias("key"), F.md5("path").alias("eTag"), F.lit("1").alias("sequencer")).alias("object"),
        ).alias("s3"),
    )
    placed = names.withColumn("bucket", F.substring("path", F.lit(1), cut))
    once = placed.select(F.to_json(F.struct(F.array(record).alias("Records"))).alias("value"), "n")
    once.select("value").write.text(out)
    once.where("n % 2 = 0").select("value").write.mode("append").text(out)
    spark.range(1).select(F.lit('{"Event": "test"}').alias("value")).write.mode("append").text(out)


def job_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job documents: errors failed in one of the four stages."""
    tenths = F.floor(F.col("value") * 10).cast("bigint")
    times = {
        "embed": tenths / 10.0,
        "retrieve": (tenths * 2 % 9973) / 10.0,
        "generate": (tenths * 7 % 60013) / 10.0,
        "athena": (tenths * 13 % 70001) / 10.0,
    }
    failed = F.col("event_type") == "error"
    stop = F.when(failed, (F.col("event_id") % 4).cast("int")).otherwise(4)
    state = lambda i: (
        F.when(stop > i, "done").when(stop == i, "failed").otherwise("pending")
    )
    stages = F.struct(
        *[
            F.struct(state(i).alias("status"), F.when(stop > i, ms).alias("ms")).alias(name)
            for i, (name, ms) in enumerate(times.items())
        ]
    )
    stage_name = F.element_at(F.array(*[F.lit(s) for s in S.STAGES]), stop + 1)
    error = F.when(
        failed,
        F.struct(
            F.when(F.col("value") > 20, "TimeoutError").otherwise("RuntimeError").alias("error"),
            F.col("props").alias("detail"),
            stage_name.alias("stage"),
        ),
    )
    safe_error = F.when(failed, error)
    document = F.to_json(
        F.struct(
            F.concat(F.lit("job-"), F.col("event_id")).alias("job_id"),
            F.when(failed, "failed").otherwise("succeeded").alias("status"),
            stages.alias("stages"),
            safe_error.alias("error"),
        )
    )
    return table(spark, sf_dir, "events").select(document.alias("document"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as model answers around the whole text of the turn."""
    text = F.col("text")
    wrap = lambda before, after: F.concat(F.lit(before), text, F.lit(after))
    user, first = F.col("role") == "user", F.col("turn") == 0
    answer = (
        F.when(F.col("role") == "system", text)
        .when(user & first, wrap("```sql\n-- cannot answer: ", "\n```"))
        .when(
            user,
            wrap("Here:\n```SQL\n  WITH t AS (SELECT 1) SELECT '", "' AS note FROM t;;\n```\n```sql\nDROP x```"),
        )
        .when(F.col("turn") == 1, wrap("```\nDELETE FROM t WHERE note = '", "'\n```"))
        .when(F.col("turn") == 3, wrap("```sql\nSELECT * FROM t WHERE note = '", "'; update t```"))
        .otherwise(wrap("```sql\nselect * FROM t WHERE note = '", "'\n```"))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("text"))


def _part_type() -> Column:
    """A brand and a stretch of part keys, so that a type has some hundred fields at any scale."""
    return F.concat("p_brand", F.lit("-"), F.floor(F.col("p_partkey") / 2500))


def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource types with property paths from their parts."""
    return (
        table(spark, sf_dir, "part")
        .groupBy(
            _part_type().alias("resource_type"),
            F.concat(
                F.lit("configuration."), F.col("p_type"), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_"))
            ).alias("path"),
        )
        .agg(F.when(F.max("p_size") > 25, "integer").otherwise("string").alias("type"))
    )


def enrichments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One enrichment per type; notable fields of very large parts do not exist."""
    path = F.concat(
        F.lit("configuration."),
        F.col("p_type"),
        F.lit("."),
        F.replace("p_name", F.lit(" "), F.lit("_")),
        F.when(F.col("p_size") > 48, ".missing").otherwise(""),
    )
    return (
        table(spark, sf_dir, "part")
        .select(_part_type().alias("resource_type"), "p_type", path.alias("path"))
        .distinct()
        .groupBy("resource_type")
        .agg(
            F.array_sort(F.collect_set("p_type")).alias("types"),
            F.array_sort(F.collect_set("path")).alias("paths"),
        )
        .select(
            "resource_type",
            F.concat(F.lit("svc-"), F.col("resource_type")).alias("service"),
            F.element_at("types", 1).alias("category"),
            F.array_join("types", " and ").alias("description"),
            F.transform("types", lambda t: F.concat(F.lit("how many "), t)).alias("common_queries"),
            F.transform(
                "paths", lambda p: F.struct(p.alias("path"), F.lit("noted").alias("description"))
            ).alias("notable_fields"),
            F.array().cast("array<string>").alias("relationships_to"),
        )
    )


def schema_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("key"), "embedding", F.col("label").alias("service")
    )


def label_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of every label, as query vectors."""
    values = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding"))
    means = values.groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(ordered, lambda p: p["x"]).alias("embedding")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; only even keys have one, so that odd ones show the placeholder."""
    return table(spark, sf_dir, "documents").select(
        (2 * F.col("doc_id")).alias("key"), F.col("text").alias("document")
    )
