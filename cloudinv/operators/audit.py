"""Checks of generated SQL and reports over job documents."""

import re

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudinv.functions.quantiles import exact_median
from cloudinv.functions.text import strip
from cloudinv.functions.times import parse_ts
from cloudinv.schema import JOB, STAGES

ROW_LIMIT = 100

_QUOTED = "spark.sql.ansi.doubleQuotedIdentifiers"

# The answer format and the statements that are not allowed.
FENCE = r"(?isU)```(?:sql)?\s*(.+?)```"
SELECT_ONLY = r"(?iU)^\s*(WITH\s|SELECT\s)"
FORBIDDEN = (
    r"(?iU)\b(DROP|DELETE|INSERT|UPDATE|MERGE|ALTER|CREATE|GRANT|REVOKE|TRUNCATE"
    r"|VACUUM|OPTIMIZE|CALL|REPLACE)\b"
)


def fenced_sql(text: Column) -> Column:
    """The first fenced block without outer white space and closing semicolons."""
    block = strip(F.regexp_extract(text, FENCE, 1))
    return F.when(text.rlike(FENCE), F.regexp_replace(block, r";+\z", ""))


def sql_verdict(sql: Column) -> Column:
    """``no_block``, ``comment``, ``not_select``, ``forbidden`` or ``ok``; first one wins."""
    stripped = strip(sql)
    return (
        F.when(sql.isNull(), "no_block")
        .when(stripped.startswith("--"), "comment")
        .when(~stripped.rlike(SELECT_ONLY), "not_select")
        .when(stripped.rlike(FORBIDDEN), "forbidden")
        .otherwise("ok")
    )


def extract_sql(responses: DataFrame, text: str = "text") -> DataFrame:
    return responses.withColumn("sql", fenced_sql(F.col(text)))


def validate_sql(statements: DataFrame, sql: str = "sql") -> DataFrame:
    return statements.withColumn("verdict", sql_verdict(F.col(sql)))


_CATALYST = "org.apache.spark.sql.catalyst"


def _parts(gateway, node) -> list:
    """What a node of a parsed statement holds: its children, its expressions, and plans within them."""
    held = [node.children(), node.innerChildren()]
    if is_instance_of(gateway, node, f"{_CATALYST}.plans.QueryPlan"):
        held.append(node.expressions())
    found = [some.apply(i) for some in held for i in range(some.size())]
    if is_instance_of(gateway, node, f"{_CATALYST}.expressions.PlanExpression"):
        found.append(node.plan())
    return found


def _sort_keys(gateway, node) -> set[tuple[int, int]]:
    """First and last character of every sort key in a parsed statement, windows and subqueries included."""
    found, open_ = set(), [node]
    while open_:
        node = open_.pop()
        if node.getClass().getSimpleName() == "SortOrder":
            origin = node.origin()
            if origin.startIndex().isDefined():
                found.add((origin.startIndex().get(), origin.stopIndex().get()))
        open_ += _parts(gateway, node)
    return found


def nulls_last(spark: SparkSession, sql: str) -> str:
    """``sql`` with NULLS LAST behind every sort key that does not say where NULLs go.

    Other engines put them last in both directions, Spark first in ascending order, which decides
    what a limit keeps. Spark's own parser tells where the keys stand, so text that only looks
    like an order is left alone.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    for first, last in sorted(_sort_keys(spark.sparkContext._gateway, plan), key=lambda k: -k[1]):
        if not re.search(r"(?i)\bnulls\s+(first|last)$", sql[first : last + 1]):
            sql = f"{sql[: last + 1]} NULLS LAST{sql[last + 1 :]}"
    return sql


def run_readonly(spark: SparkSession, sql: str, limit: int = ROW_LIMIT) -> DataFrame:
    """Run an accepted SELECT, with at most ``limit`` rows of result.

    Double quotes name columns, as in standard SQL, and NULLs come last unless the text says
    otherwise; see :func:`nulls_last`.
    """
    verdict = spark.range(1).select(sql_verdict(F.lit(sql)).alias("v")).first()["v"]
    if verdict != "ok":
        raise ValueError(f"statement refused: {verdict}")
    before = spark.conf.get(_QUOTED, "false")
    spark.conf.set(_QUOTED, "true")
    try:
        return spark.sql(nulls_last(spark, sql)).limit(limit)
    finally:
        spark.conf.set(_QUOTED, before)


def parse_jobs(documents: DataFrame, text: str = "document") -> DataFrame:
    """Job documents as columns, one parse per document."""
    return documents.select(F.from_json(text, JOB).alias("job")).select("job.*")


def _ms(stage: str) -> Column:
    return F.try_element_at("stages", F.lit(stage))["ms"]


def stage_timings(jobs: DataFrame) -> DataFrame:
    """Time per stage and in total over the stages present, one decimal."""
    total = sum((F.coalesce(_ms(s), F.lit(0.0)) for s in STAGES), F.lit(0.0))
    return jobs.select(
        "job_id",
        "status",
        *[_ms(s).alias(f"{s}_ms") for s in STAGES],
        F.round(total, 1).alias("total_ms"),
    )


def stage_rows(jobs: DataFrame) -> DataFrame:
    """One row per job and stage it lists.

    A plain explode would add a filter on the map's size, which parses documents twice.
    """
    listed = jobs.select("job_id", F.explode_outer("stages").alias("stage", "entry"))
    return listed.where(F.col("stage").isNotNull()).select(
        "job_id",
        "stage",
        F.col("entry.status").alias("status"),
        parse_ts(F.col("entry.started_at")).alias("started_at"),
        parse_ts(F.col("entry.ended_at")).alias("ended_at"),
        F.col("entry.ms").alias("ms"),
    )


def timing_report(jobs: DataFrame) -> DataFrame:
    """Jobs, median, minimum and maximum per known stage."""
    known = F.explode(
        F.array(*[F.struct(F.lit(s).alias("stage"), _ms(s).alias("ms")) for s in STAGES])
    )
    times = jobs.select(known.alias("s")).select("s.stage", "s.ms")
    return exact_median(times, "stage", "ms").select(
        "stage",
        F.col("n").alias("jobs"),
        F.round("median", 2).alias("median_ms"),
        F.col("min").alias("min_ms"),
        F.col("max").alias("max_ms"),
    )


def failures(jobs: DataFrame) -> DataFrame:
    """Failed jobs by stage and kind of error."""
    return (
        jobs.where(F.col("status") == "failed")
        .groupBy(F.col("error.stage").alias("stage"), F.col("error.error").alias("error"))
        .agg(F.count(F.lit(1)).alias("failed_jobs"))
        .orderBy(F.desc("failed_jobs"), F.asc_nulls_last("stage"), F.asc_nulls_last("error"))
    )
