import json

import pytest
from helpers import collected

from cloudinv.operators import audit

ANSWERS = [
    ("plain", None, "no_block"),
    ("```sql\nSELECT 1;;\n```", "SELECT 1", "ok"),
    ("```\n\n with x as (select 1) select * from x \n```", "with x as (select 1) select * from x", "ok"),
    ("x ```SQL select a ``` y ```sql drop b```", "select a", "ok"),
    ("```sql\n-- cannot answer: drop\n```", "-- cannot answer: drop", "comment"),
    ("```sql\nDROP TABLE t\n```", "DROP TABLE t", "not_select"),
    ("```sql\nSELECT replace(a,'x','y') FROM t\n```", "SELECT replace(a,'x','y') FROM t", "forbidden"),
    ("```sql\nSELECT 'update' FROM t\n```", "SELECT 'update' FROM t", "forbidden"),
    ("```sql\nSELECT updated, dropped FROM t\n```", "SELECT updated, dropped FROM t", "ok"),
    ("```sql\nSELECT 1; SELECT 2\n```", "SELECT 1; SELECT 2", "ok"),
    ("```sql\nSELECTED\n```", "SELECTED", "not_select"),
    ("```sql\n SELECT 1 ; \n```", "SELECT 1 ", "ok"),
    ("```sql   ```", "", "not_select"),
    ("``````", None, "no_block"),
]


def test_extract_and_validate(spark):
    df = spark.createDataFrame([(a,) for a, _, _ in ANSWERS], "text string")
    got = {r["text"]: (r["sql"], r["verdict"]) for r in audit.validate_sql(audit.extract_sql(df)).collect()}
    assert got == {a: (s, v) for a, s, v in ANSWERS}


def test_run_readonly(spark):
    spark.range(500).createOrReplaceTempView("numbers")
    assert audit.run_readonly(spark, "SELECT id FROM numbers").count() == 100
    assert audit.run_readonly(spark, "WITH n AS (SELECT * FROM numbers) SELECT * FROM n", 7).count() == 7
    for sql in ("DROP VIEW numbers", "-- no", "SELECT 1 FROM numbers; DELETE FROM numbers"):
        with pytest.raises(ValueError):
            audit.run_readonly(spark, sql)


def jobs(spark):
    def doc(job, status, ms, error=None):
        stages = {s: {"status": "done", "ms": m} for s, m in ms.items()}
        stages["athena"] = stages.get("athena", {"status": "pending"})
        return (json.dumps({"job_id": job, "status": status, "stages": stages, "error": error}),)

    rows = [
        doc("1", "succeeded", {"embed": 1.1, "retrieve": 2.2, "generate": 3.3, "athena": 4.4}),
        doc("2", "failed", {"embed": 10.0}, {"error": "ValueError", "detail": "d", "stage": "retrieve"}),
        doc("3", "failed", {}, {"error": "ValueError", "detail": "d", "stage": "retrieve"}),
        doc("4", "failed", {"embed": 2.0, "other": 99.0}, {"error": "Timeout", "detail": "d", "stage": None}),
    ]
    return audit.parse_jobs(spark.createDataFrame(rows, "document string"))


def test_timings(spark):
    got = {r["job_id"]: r.asDict() for r in audit.stage_timings(jobs(spark)).collect()}
    assert got["1"]["total_ms"] == 11.0 and got["2"]["total_ms"] == 10.0
    assert got["2"]["retrieve_ms"] is None and got["3"]["total_ms"] == 0.0
    assert got["4"]["total_ms"] == 2.0


def test_timing_report(spark):
    got = collected(audit.timing_report(jobs(spark)))
    assert got == [
        ("athena", 1, 4.4, 4.4, 4.4),
        ("embed", 3, 2.0, 1.1, 10.0),
        ("generate", 1, 3.3, 3.3, 3.3),
        ("retrieve", 1, 2.2, 2.2, 2.2),
    ]


def test_failures(spark):
    got = [tuple(r) for r in audit.failures(jobs(spark)).collect()]
    assert got == [("retrieve", "ValueError", 2), (None, "Timeout", 1)]


def test_sql_written_for_the_view(spark):
    from helpers import inventory

    from cloudinv.plans.views import register_live

    live = inventory(
        spark,
        dict(arn="a", resource_type="I", tags='{"Environment":"prod"}',
             configuration={"state": {"name": "on"}, "list": [{"id": "x"}], "note": "[old] box"}),
        dict(arn="b", resource_type="I", tags="{}", configuration={"state": {"name": "off"}}),
        dict(arn="c", resource_type="V", configuration={"size": 8, "encrypted": True}),
    )
    register_live(spark, live)
    got = audit.run_readonly(
        spark,
        """SELECT json_extract_scalar(tags, '$.Environment') AS env, COUNT(*) AS n,
                  COUNT(*) FILTER (WHERE json_extract_scalar(configuration, '$.state.name') = 'on') AS "on"
           FROM operational_live WHERE resource_type IN ('I')
           GROUP BY json_extract_scalar(tags, '$.Environment') ORDER BY n DESC, env""",
    )
    assert got.columns == ["env", "n", "on"]
    assert sorted(map(tuple, got.collect()), key=str) == [("prod", 1, 1), (None, 1, 0)]
    got = audit.run_readonly(
        spark,
        """SELECT arn, CAST(json_extract_scalar(configuration, '$.size') AS INTEGER) AS size,
                  CAST(json_extract_scalar(configuration, '$.encrypted') AS BOOLEAN) AS encrypted,
                  json_extract_scalar(configuration, '$.state') AS state,
                  json_extract(configuration, '$.state') AS state_json,
                  json_extract_scalar(configuration, '$.list[0].id') AS first,
                  json_extract_scalar(configuration, '$.note') AS note
           FROM operational_live
           WHERE last_seen_at < current_timestamp - interval '1' hour OR TRUE""",
    )
    assert collected(got) == [
        ("a", None, None, None, '{"name":"on"}', "x", "[old] box"),
        ("b", None, None, None, '{"name":"off"}', None, None),
        ("c", 8, True, None, None, None, None),
    ]


def test_stage_rows(spark):
    doc = {
        "job_id": "1",
        "status": "running",
        "stages": {
            "embed": {"status": "done", "started_at": "2026-04-09T10:00:00.25+00:00",
                      "ended_at": "2026-04-09T10:00:01+00:00", "ms": 750.0},
            "athena": {"status": "pending"},
        },
        "result": {"sql": "SELECT 1", "row_count": 3},
    }
    parsed = audit.parse_jobs(spark.createDataFrame([(json.dumps(doc),)], "document string"))
    rows = {r["stage"]: r for r in audit.stage_rows(parsed).collect()}
    assert set(rows) == {"embed", "athena"} and rows["embed"]["ms"] == 750.0
    assert rows["embed"]["started_at"].microsecond == 250000 and rows["athena"]["ended_at"] is None
    assert tuple(parsed.select("result.sql", "result.row_count").first()) == ("SELECT 1", 3)


def test_nulls_come_last_where_the_text_does_not_say(spark):
    last = lambda sql: audit.nulls_last(spark, sql)
    assert last("SELECT a FROM t ORDER BY a, b DESC LIMIT 3") == (
        "SELECT a FROM t ORDER BY a NULLS LAST, b DESC NULLS LAST LIMIT 3"
    )
    assert last("SELECT a FROM t ORDER BY a NULLS FIRST, lower(b) ASC nulls  last") == (
        "SELECT a FROM t ORDER BY a NULLS FIRST, lower(b) ASC nulls  last"
    )
    assert last("SELECT 'ORDER BY x' AS s FROM t -- ORDER BY y") == "SELECT 'ORDER BY x' AS s FROM t -- ORDER BY y"
    nested = (
        "WITH w AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) AS r FROM (SELECT * FROM t ORDER BY c LIMIT 9)) "
        "SELECT a FROM w WHERE a IN (SELECT max(x) FROM u GROUP BY y ORDER BY y LIMIT 2) ORDER BY 1"
    )
    got = last(nested)
    assert got.count("NULLS LAST") == 4
    for key in ("ORDER BY b NULLS LAST)", "ORDER BY c NULLS LAST LIMIT", "ORDER BY y NULLS LAST LIMIT", "ORDER BY 1 NULLS LAST"):
        assert key in got


def test_a_limit_keeps_known_values_first(spark):
    spark.createDataFrame([(None,), (2,), (None,), (1,)], "a int").createOrReplaceTempView("some_nulls")
    run = lambda order: [r[0] for r in audit.run_readonly(spark, f"SELECT a FROM some_nulls ORDER BY {order} LIMIT 3").collect()]
    assert run("a") == [1, 2, None] and run("a DESC") == [2, 1, None] and run("a NULLS FIRST") == [None, None, 1]
