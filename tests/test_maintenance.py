from datetime import datetime, timedelta

import pytest
from helpers import NOON, collected, inventory
from pyspark.sql import functions as F

from cloudinv.operators import maintenance as M
from cloudinv.operators.shaping import live

HOUR = timedelta(hours=1)
KEPT = ("account_id", "arn", "state_hash")


def test_live_is_strict(spark):
    df = inventory(
        spark,
        dict(arn="edge", last_seen_at=NOON - 24 * HOUR),
        dict(arn="in", last_seen_at=NOON - 24 * HOUR + timedelta(microseconds=1)),
        dict(arn="future", last_seen_at=NOON + HOUR),
        dict(arn="unknown", last_seen_at=None),
    )
    assert collected(live(df, NOON), "arn") == [("future",), ("in",)]
    assert live(df, NOON, ttl_hours=25).count() == 3


def test_latest_settles_ties(spark):
    df = inventory(
        spark,
        dict(arn="a", state_hash="old", last_seen_at=NOON - HOUR),
        dict(arn="a", state_hash="none", last_seen_at=None),
        dict(arn="a", state_hash="captured", captured_at=NOON, source_key="f1"),
        dict(arn="a", state_hash="later file", captured_at=NOON, source_key="f2"),
        dict(arn="a", state_hash="not captured", captured_at=None, source_key="f9"),
        dict(arn="a", account_id="000000000099", state_hash="other account"),
    )
    want = [("000000000012", "a", "later file"), ("000000000099", "a", "other account")]
    for order in (df, df.orderBy("state_hash"), df.orderBy(F.desc("state_hash"))):
        assert collected(M.latest(order.repartition(3)), *KEPT) == want


def test_full_tie_is_stable(spark):
    rows = [dict(arn="a", configuration=f"c{i}") for i in range(20)]
    first = M.latest(inventory(spark, *rows).repartition(5)).first()["configuration"]
    again = M.latest(inventory(spark, *reversed(rows)).repartition(2)).first()["configuration"]
    assert first == again


def test_merge_modes(spark):
    target = inventory(
        spark,
        dict(arn="a", state_hash="1", last_seen_at=NOON - 3 * HOUR),
        dict(arn="a", state_hash="2", last_seen_at=NOON - 2 * HOUR),
        dict(arn="b", state_hash="newer here", last_seen_at=NOON),
        dict(arn="n", state_hash="unknown time", last_seen_at=None),
    )
    source = inventory(
        spark,
        dict(arn="a", state_hash="3", last_seen_at=NOON - HOUR),
        dict(arn="a", state_hash="2.5", last_seen_at=NOON - 1.5 * HOUR),
        dict(arn="b", state_hash="older", last_seen_at=NOON - HOUR),
        dict(arn="c", state_hash="new", last_seen_at=NOON),
        dict(arn="n", state_hash="known", last_seen_at=NOON),
    )
    account = "000000000012"
    collapsed = M.merge_latest(target, source)
    assert collected(collapsed, *KEPT) == [
        (account, "a", "3"), (account, "b", "newer here"), (account, "c", "new"), (account, "n", "known"),
    ]
    updated = M.merge_latest(target, source, mode="update")
    assert updated.columns == target.columns
    assert collected(updated, *KEPT) == [
        (account, "a", "3"), (account, "a", "3"), (account, "b", "newer here"),
        (account, "c", "new"), (account, "n", "unknown time"),
    ]
    own = M.merge_latest(target, mode="update")
    assert [r[2] for r in collected(own, *KEPT)] == ["2", "2", "newer here", "unknown time"]
    with pytest.raises(ValueError):
        M.merge_latest(target, source, mode="replace")


def test_update_inserts_null_keys(spark):
    df = inventory(spark, dict(arn=None, state_hash="x"), dict(arn="a", state_hash="y"))
    assert M.merge_latest(df, mode="update").count() == 3


def test_drop_expired(spark):
    df = inventory(
        spark,
        dict(arn="edge", last_seen_at=NOON - timedelta(days=7)),
        dict(arn="old", last_seen_at=NOON - timedelta(days=7, microseconds=1)),
        dict(arn="unknown", last_seen_at=None),
    )
    assert collected(M.drop_expired(df, NOON), "arn") == [("edge",), ("unknown",)]


def test_ttl_over_days(spark):
    """A resource seen once is live for a day and gone from the table after a week."""
    table = inventory(spark, dict(arn="gone", last_seen_at=NOON), dict(arn="kept", last_seen_at=NOON))
    for day in range(1, 9):
        now = NOON + timedelta(days=day)
        table = table.unionByName(inventory(spark, dict(arn="kept", last_seen_at=now)))
        table = spark.createDataFrame(M.nightly(table, now).collect(), table.schema)
        assert collected(M.live_latest(table, now), "arn") == [("kept",)]
        assert ("gone",) in collected(table, "arn") or day > 7
    assert collected(table, "arn") == [("kept",)]


def test_changes_equal_a_whole_run(spark):
    """On random rows, with NULL keys and ties; untouched accounts are left alone."""
    import random

    rng = random.Random(6)

    def observed(n, first, last, accounts):
        return inventory(spark, *[
            dict(account_id=f"a{rng.choice(accounts)}", arn=rng.choice(["x", "y", "z", None, f"n{rng.randrange(30)}"]),
                 last_seen_at=NOON + timedelta(hours=rng.randint(first, last)), source_key=rng.choice("pq"),
                 state_hash=str(rng.randrange(9)))
            for _ in range(n)
        ])

    earlier, landed = observed(200, -300, -100, range(9)), observed(60, -150, 0, range(3))
    base = M.nightly(earlier, NOON - timedelta(hours=100), days=9)
    touched, rows = M.nightly_changes(base, landed, NOON, days=9)
    kept = base.join(touched, "account_id", "left_anti")
    want = M.nightly(base.unionByName(landed), NOON, days=9)
    columns = ("account_id", "arn", "last_seen_at", "source_key", "state_hash")
    got = kept.unionByName(rows)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    untouched, rows = M.nightly_changes(base, landed.where("false"), NOON - timedelta(hours=100), days=9)
    assert untouched.count() == rows.count() == 0


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 9)], "key string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4), ("c", 5)], "key string, v int")
    got = M.upsert(old, new, order=("v",))
    assert sorted(got.collect(), key=str) == sorted(
        [("a", 1), ("b", 3), ("c", 5), (None, 9)], key=str
    )


def test_expired_files(spark):
    files = spark.createDataFrame(
        [("raw/a", NOON - timedelta(days=15)), ("raw/b", NOON - timedelta(days=14)),
         ("results/a", NOON - timedelta(days=8)), ("other/a", datetime(2000, 1, 1))],
        "path string, modified_at timestamp",
    )
    got = M.expired_files(files, [("raw/", 14), ("results/", 7), ("jobs/", 1)], NOON)
    assert collected(got, "path", "days") == [("raw/a", 14), ("results/a", 7)]


def test_file_rules_go_by_the_longest_start(spark):
    old = NOON - timedelta(days=10)
    paths = ["s3://raw/AWSLogs/results/x.json.gz", "s3a://raw/tmp/x", "results/x", "file:///raw/x", "my-raw/x"]
    files = spark.createDataFrame([(p, old) for p in paths], "path string, modified_at timestamp")
    got = M.expired_files(files, [("raw/tmp/", 3), ("results/", 7), ("raw/", 14)], NOON)
    assert collected(got, "path", "days") == [("results/x", 7), ("s3a://raw/tmp/x", 3)]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    """A third of all rows share one key; each input partition ships one of them."""
    df = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("arn"),
        F.lit("000000000001").alias("account_id"),
        F.timestamp_seconds("id").alias("last_seen_at"),
    )
    newest = M.latest(df)
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    hot = newest.where("arn = 'hot'").collect()
    assert len(hot) == 1 and hot[0]["last_seen_at"] == datetime(1970, 1, 4, 11, 19, 57)
    assert newest.count() == 200_001


def test_update_and_upsert_with_a_hot_key(spark):
    """A third of the target shares one key: every row of it is updated, none is lost."""
    n = 60_000
    key = lambda c: F.when(c % 3 == 0, "hot").otherwise(c.cast("string"))
    target = spark.range(n).select(
        F.lit("1").alias("account_id"), key(F.col("id")).alias("arn"),
        F.timestamp_seconds("id").alias("last_seen_at"), F.lit("old").alias("state_hash"),
    )
    source = spark.range(n, 2 * n, 3).select(
        F.lit("1").alias("account_id"), F.lit("hot").alias("arn"),
        F.timestamp_seconds("id").alias("last_seen_at"), F.lit("new").alias("state_hash"),
    )
    got = M.merge_latest(target, source, mode="update")
    counts = {r["state_hash"]: r["count"] for r in got.groupBy("state_hash").count().collect()}
    assert counts == {"new": n // 3, "old": n - n // 3}
    merged = M.upsert(target, source, key="arn", order=("last_seen_at",))
    assert merged.count() == n - n // 3 + 1


def test_prefix_rules_against_plain_python():
    import random

    import pandas as pd

    rng = random.Random(4)
    letters = "ab/é\U0010ffff"
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    for _ in range(200):
        rules = {word(6): rng.randrange(100) for _ in range(rng.randrange(12))}
        paths = [word(9) for _ in range(50)] + list(rules) + [None]
        want = [
            None if p is None else max(((len(r), d) for r, d in rules.items() if p.startswith(r)), default=(0, None))[1] for p in paths
        ]
        got = M.PrefixRules(rules.items()).of(pd.Series(paths, dtype=object))
        assert [None if pd.isna(x) else int(x) for x in got] == want


def test_ten_thousand_rules(spark):
    rules = [(f"bucket/{i:05d}/", i % 9 + 1) for i in range(10_000)] + [("bucket/", 40), ("bucket/00007/keep/", 400)]
    files = spark.createDataFrame(
        [(f"s3://bucket/{i:05d}/x", NOON - timedelta(days=5)) for i in range(0, 10_000, 100)]
        + [("s3://bucket/00007/keep/x", NOON - timedelta(days=50)), ("s3://bucket/other", NOON - timedelta(days=50)), (None, NOON)],
        "path string, modified_at timestamp",
    )
    got = M.expired_files(files, rules, NOON)
    want = [(f"s3://bucket/{i:05d}/x", i % 9 + 1) for i in range(0, 10_000, 100) if i % 9 + 1 < 5] + [("s3://bucket/other", 40)]
    assert collected(got, "path", "days") == sorted(want)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
