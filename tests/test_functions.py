from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cloudinv.functions.jsonpath import json_scalar, with_members, with_payload
from cloudinv.functions.quantiles import exact_median
from cloudinv.functions.text import contains_all, source_key, strip
from cloudinv.functions.times import instant, parse_ts
from cloudinv.functions.vectors import norm, normalize

TEN = datetime(2026, 4, 9, 10)

TIMES = [
    ("2026-04-09T10:00:00Z", TEN),
    ("2026-04-09T10:00:00.000Z", TEN),
    ("2026-04-09T12:00:00+02:00", TEN),
    ("2026-04-09T12:00:00+0200", TEN),
    ("2026-04-09T10:00:00", TEN),
    ("2026-04-09 10:00", TEN),
    ("2026-04-09", datetime(2026, 4, 9)),
    ("20260409T100000Z", TEN),
    ("1775728800", TEN),
    ("1775728800.5", datetime(2026, 4, 9, 10, 0, 0, 500000)),
    ("1.7757288E9", TEN),
    ("1e30", None),
    ("", None),
    ("null", None),
    (None, None),
    ("2026", datetime(1970, 1, 1, 0, 33, 46)),
    ("12:30", None),
    ("2026-4-9", None),
    ("2026-04", None),
    ("2026-13-40", None),
    ("yesterday", None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_parse_ts(spark, zone):
    """The instant does not depend on the session time zone."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(TIMES, "text string, want timestamp_ntz")
        micros = F.unix_micros(parse_ts(F.col("text")))
        got = {r["text"]: r["m"] for r in df.select("text", micros.alias("m")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    epoch = datetime(1970, 1, 1)
    for text, want in TIMES:
        delta = None if want is None else want - epoch
        expected = delta and (delta.days * 86400 + delta.seconds) * 10**6 + delta.microseconds
        assert got[text] == expected, text


def test_instant_is_utc(spark):
    got = spark.range(1).select(
        F.unix_micros(instant("2026-04-09T10:00:00")).alias("a"),
        F.unix_micros(instant(TEN)).alias("b"),
    )
    assert tuple(got.first()) == (1775728800000000, 1775728800000000)


JSON = (
    '{"s":"x","n":8,"b":true,"z":null,"o":{"k":"v"},"l":[{"k":"first"},{"k":"second"}],'
    '"odd":"[legacy] web","policy":"{\\"Version\\":1}","a:b":"colon","e":"","nulls":[null,"null"]}'
)
PATHS = {
    "$.s": "x",
    "$.n": "8",
    "$.b": "true",
    "$.z": None,
    "$.missing": None,
    "$.o": None,
    "$.o.k": "v",
    "$.l": None,
    "$.l[0].k": "first",
    "$.l[1].k": "second",
    "$.l[5].k": None,
    "$.odd": "[legacy] web",
    "$.policy": '{"Version":1}',
    "$['a:b']": "colon",
    "$.e": "",
    "$.nulls[0]": None,
    "$.nulls[1]": "null",
}


def test_json_scalar(spark):
    df = spark.createDataFrame([(JSON,)], "j string")
    got = df.select(*[json_scalar(F.col("j"), p).alias(f"c{i}") for i, p in enumerate(PATHS)])
    assert list(got.first()) == list(PATHS.values())


def test_with_members_equals_single_probes(spark):
    df = spark.createDataFrame([(JSON,), (None,), ("not json",)], "j string")
    names = {f"c{i}": p for i, p in enumerate(PATHS)}
    got = with_members(df, names, "j").select(*names).collect()
    assert list(got[0]) == list(PATHS.values())
    assert set(got[1]) == {None} and set(got[2]) == {None}


def test_members_of_a_parsed_payload_equal_those_of_text(spark):
    """Also where the text is no JSON or names a member twice, so that no Variant holds it."""
    texts = [JSON, None, "not json", '{"s": 1, "s": 2}', '{"s": "[old]", "n": null, "o": {"k": 1}, "l": [1, "{}"]}', "[1]", '"text"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, configuration string")
    names = {f"c{i}": p for i, p in enumerate(PATHS)} | {"first": "$.l[0]", "second": "$.l[1]"}
    plain = {r.id: tuple(r)[2:] for r in df.select("*", *[json_scalar(F.col("configuration"), p).alias(n) for n, p in names.items()]).collect()}
    parsed = with_payload(df)
    got = with_members(parsed, names)
    assert {r.id: tuple(r[n] for n in names) for r in got.collect()} == plain
    assert parsed.where("payload_text IS NOT NULL").count() == 2
    with pytest.raises(ValueError):
        with_members(parsed, {"a": "$..x"})


def test_with_members_rejects_unknown_path_forms(spark):
    with pytest.raises(ValueError):
        with_members(spark.range(1), {"a": "$..x"}, "id")


def test_members_are_parsed_once(spark):
    df = spark.createDataFrame([(JSON,)], "j string")
    plan = with_members(df, {"a": "$.s", "b": "$.n", "c": "$.o.k"}, "j").select("a", "b", "c")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("from_json") == 1


def test_text(spark):
    df = spark.createDataFrame(
        [("file:/a%20b/c+d%2B.json.gz", " \n\tx y\n")], "path string, t string"
    )
    got = df.select(source_key(F.col("path")), strip(F.col("t")), contains_all(F.col("t"), "X", "y"))
    assert tuple(got.first()) == ("file:/a b/c+d+.json.gz", "x y", True)


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r["u"] for r in df.select(normalize(F.col("v")).alias("u")).collect()]
    assert [round(x, 6) for x in got[0]] == [0.6, 0.8] and got[1] is None
    assert df.select(norm(F.col("v"))).first()[0] == 5.0


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0, 1.0, 9.0], [0.0, 0.0, 7.5, 1e6], [3.0] * 7])
def test_exact_median(spark, values):
    import statistics

    df = spark.createDataFrame([("g", v) for v in values] + [("h", 4.0), ("g", None), (None, 2.0)], "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in exact_median(df, "g", "v").collect()}
    assert got["g"] == (len(values), min(values), max(values), statistics.median(values))
    assert got["h"] == (1, 4.0, 4.0, 4.0) and got[None] == (1, 2.0, 2.0, 2.0)
