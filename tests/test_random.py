"""Random inputs against plain Python."""

import random
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from cloudinv.functions.jsonpath import with_members
from cloudinv.functions.times import parse_ts
from cloudinv.operators import audit

UTC = timezone.utc


def test_timestamps(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(400):
        moment = datetime(1990, 1, 1) + timedelta(microseconds=rng.randrange(2 * 10**15))
        text = moment.isoformat(
            sep=rng.choice("T "),
            timespec=rng.choice(["minutes", "seconds", "milliseconds", "microseconds", "hours"]),
        )
        text += rng.choice(["", "Z", "+00:00", "-07:30", "+14:00", "+0530"])
        if rng.random() < 0.2:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("0x-:") + text[at + 1 :]
        texts.append(text)

    def plain(text):
        try:
            got = datetime.fromisoformat(text.replace("Z", "+00:00"))
        except ValueError:
            return None
        return (got if got.tzinfo else got.replace(tzinfo=UTC)) - datetime(1970, 1, 1, tzinfo=UTC)

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["m"] for r in df.select("t", F.unix_micros(parse_ts(F.col("t"))).alias("m")).collect()}
    differ = []
    for text in texts:
        want = plain(text)
        want = want and (want.days * 86400 + want.seconds) * 10**6 + want.microseconds
        # Python also takes any separator, a colon before fractions, and offsets of a day.
        if got[text] != want and re.match(r"^\d{4}-\d{2}-\d{2}[T ](?!.*:\d\d:\d\d:\d{3})", text):
            differ.append((text, got[text], want))
    assert not differ


def test_fenced_sql(spark):
    rng = random.Random(11)
    pieces = ["```", "```sql", "```SQL\n", "\n", " ", ";", "--", "select ", "WITH a ", "drop", "x", "é", "update_", "\t"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 14))) for _ in range(600)]
    block = re.compile(audit.FENCE.replace("(?isU)", ""), re.I | re.S)
    first = re.compile(audit.SELECT_ONLY.replace("(?iU)", ""), re.I)
    forbidden = re.compile(audit.FORBIDDEN.replace("(?iU)", ""), re.I)

    def plain(text):
        found = block.search(text)
        if not found:
            return None, "no_block"
        sql = found[1].strip().rstrip(";")
        bare = sql.strip()
        if bare.startswith("--"):
            return sql, "comment"
        if not first.match(bare):
            return sql, "not_select"
        return sql, "forbidden" if forbidden.search(bare) else "ok"

    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: (r["sql"], r["verdict"]) for r in audit.validate_sql(audit.extract_sql(df)).collect()}
    assert {t: got[t] for t in texts} == {t: plain(t) for t in texts}


def test_members(spark):
    import json

    rng = random.Random(3)

    def value(depth):
        kinds = ["text", "number", "flag", "none", "bracket"]
        kind = rng.choice(kinds + (["object", "list"] * 2 if depth < 3 else []))
        if kind == "object":
            return {k: value(depth + 1) for k in rng.sample(["a", "b", "c:d"], rng.randrange(4))}
        if kind == "list":
            return [value(depth + 1) for _ in range(rng.randrange(3))]
        return {"text": "t", "number": 7, "flag": True, "none": None, "bracket": '{"a": 1}'}[kind]

    documents = [{k: value(0) for k in ("a", "b", "c:d")} for _ in range(300)]
    paths = {"p": ["a"], "q": ["b", "a"], "r": ["c:d", 0, "b"], "s": ["b", "c:d", "a"], "t": ["c:d", 1]}

    def plain(node, steps):
        for step in steps:
            if isinstance(step, int):
                node = node[step] if isinstance(node, list) and step < len(node) else None
            else:
                node = node.get(step) if isinstance(node, dict) else None
        if node is None or isinstance(node, (dict, list)):
            return None
        return node if isinstance(node, str) else json.dumps(node)

    def text(steps):
        return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)

    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "i int, j string")
    got = with_members(df, {n: text(s) for n, s in paths.items()}, "j").orderBy("i").collect()
    for row, document in zip(got, documents):
        want = {n: plain(document, s) for n, s in paths.items()}
        assert {n: row[n] for n in paths} == want, (document, row)
