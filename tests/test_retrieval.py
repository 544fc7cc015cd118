import numpy as np
import pytest
from helpers import collected
from pyspark.sql import functions as F

from cloudinv.operators import retrieval as R
from cloudinv.schema import ENRICHMENT


def brute(vectors, queries, k):
    out = []
    for q, qv in queries:
        qv = np.array(qv) / np.linalg.norm(qv)
        scored = []
        for key, v, _ in vectors:
            length = np.linalg.norm(v)
            if length:
                scored.append((round(1 - float(np.dot(np.array(v) / length, qv)), 10), key))
        for rank, (d, key) in enumerate(sorted(scored)[:k], 1):
            out.append((q, key, round(d, 4), rank))
    return sorted(out)


@pytest.mark.parametrize("page_size", [2, 100])
def test_topk_equals_brute_force(spark, page_size):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 8)).tolist()
    # A third of all vectors are the same one, under different keys.
    rows = [(f"k{i:03d}", base[0] if i % 3 == 0 else base[i % 40], "s") for i in range(150)]
    rows.append(("zero", [0.0] * 8, "s"))
    queries = [(i, rng.normal(size=8).tolist()) for i in range(4)] + [(9, base[0])]
    vectors = spark.createDataFrame(rows, "key string, embedding array<double>, service string").repartition(5)
    asked = spark.createDataFrame(queries, "query_id int, embedding array<double>")
    got = R.cosine_topk(vectors, asked, k=7, page_size=page_size)
    assert collected(got, "query_id", "key", "distance", "rank") == brute(rows, queries, 7)


@pytest.mark.parametrize(("pivots", "block"), [(2, 10), (9, 8192), (60, 10)])
def test_pivots_lose_nothing(spark, monkeypatch, pivots, block):
    """Also with vectors of several widths, one of them unknown to the sample, ties, and hot directions."""
    monkeypatch.setattr(R, "VECTOR_BLOCK", block)
    monkeypatch.setattr(R, "SAMPLE", 100)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 8)).tolist()
    rows = [(f"k{i:03d}", base[0] if i % 3 == 0 else base[i % 40], "s") for i in range(300)]
    rows += [("zero", [0.0] * 8, "s"), ("empty", [], "s"), ("three", [1.0, 2.0, 3.0], "s"), (None, base[1], "s"), ("none", None, "s")]
    queries = [(i, rng.normal(size=8).tolist()) for i in range(20)] + [(30, base[0])]
    more = [(31, [1.0, 0.0, 0.0]), (32, None), (33, []), (34, [0.0] * 8), (35, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "key string, embedding array<double>, service string").repartition(5)
    asked = spark.createDataFrame(queries + more, "query_id int, embedding array<double>")
    got = collected(R.cosine_topk(vectors, asked, k=7, page_size=6, pivots=pivots), "query_id", "key", "distance", "rank")
    eight = [r for r in rows if r[0] and r[1] and len(r[1]) == 8]
    assert [r for r in got if r[0] < 31] == brute(eight, queries, 7)
    assert [r for r in got if r[0] >= 31] == [(31, "three", round(1 - 1 / np.sqrt(14), 4), 1)]


def test_far_pivots_are_not_met(spark, monkeypatch):
    """Of clustered vectors a query meets few; the share of pairs that are shipped says how few."""
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(30, 16))
    rows = [(i, (middles[i % 30] + 0.05 * rng.normal(size=16)).tolist()) for i in range(3000)]
    queries = [(i, (middles[i % 30] + 0.05 * rng.normal(size=16)).tolist()) for i in range(200)]
    sent, met = [], R._met

    def counted(vectors, held, asked, sizes, *more):
        sent.append(sum(sizes.values()))
        return met(vectors, held, asked, sizes, *more)

    monkeypatch.setattr(R, "_met", counted)
    vectors = spark.createDataFrame(rows, "key int, embedding array<double>")
    asked = spark.createDataFrame(queries, "query_id int, embedding array<double>")
    got = collected(R.cosine_topk(vectors, asked, k=5, pivots=30), "query_id", "key", "distance", "rank")
    assert got == brute([(k, v, None) for k, v in rows], queries, 5)
    assert len(sent) == 2 and sum(sent) < 0.1 * 30 * len(queries)


def test_topk_edges(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [0.0, 1.0], "y")], "key string, embedding array<float>, service string")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    got = R.cosine_topk(vectors, asked, k=25, where=F.col("service") == "y")
    assert collected(got, "query_id", "key", "service", "distance", "rank") == [("q", "b", "y", 1.0, 1)]
    assert R.cosine_topk(vectors, asked.where("false")).count() == 0
    for k in (0, 26):
        with pytest.raises(ValueError):
            R.cosine_topk(vectors, asked, k=k)


FIELDS = [("T::A", "configuration.b", "string"), ("T::A", "configuration.a", "integer"), ("T::B", "x", "date")]
DOC_A = """# T::A

- **Service**: EC2
- **Category**: compute
- **Field count**: 2

## Description

A thing.

## Common queries

- how many?
- where?

## Notable fields

- `configuration.a` — the a

## Related resource types

- T::B

## All field paths

- `configuration.a`: integer
- `configuration.b`: string
"""
DOC_C = """# T::C

- **Service**: 
- **Category**: 
- **Field count**: 0

## Description

_(no description)_

## All field paths

"""


def enrichment(spark):
    rows = [
        ("T::A", "EC2", "compute", " A thing.\n", ["how many?", "where?"],
         [("configuration.a", "the a")], ["T::B"]),
        ("T::C", None, None, None, None, [("nowhere", "x"), ("configuration.a", "of another type")], []),
    ]
    return spark.createDataFrame(rows, ENRICHMENT)


def test_render_docs(spark):
    fields = spark.createDataFrame(FIELDS, "resource_type string, path string, type string")
    docs = dict(collected(R.render_docs(fields, enrichment(spark).withColumn(
        "notable_fields", F.when(F.col("resource_type") == "T::A", F.col("notable_fields"))))))
    assert docs == {"T::A": DOC_A, "T::C": DOC_C}


def test_doc_metadata(spark):
    docs = [
        ("a", DOC_A),
        ("c", DOC_C),
        ("bad", "- **Service**: x: y \n  - **Category**:z\n- **Field count**: many\n"),
        ("twice", "- **Field count**: 3\n- **Field count**: 4\n- **Field count**: no"),
        ("none", "text"),
    ]
    df = spark.createDataFrame(docs, "resource_type string, document string")
    got = {r[0]: tuple(r)[1:] for r in R.parse_doc_metadata(df).collect()}
    assert got == {
        "a": ("EC2", "compute", 2),
        "c": ("", "", 0),
        "bad": ("x: y", "z", None),
        "twice": (None, None, 4),
        "none": (None, None, None),
    }


def test_invalid_paths(spark):
    fields = spark.createDataFrame(FIELDS, "resource_type string, path string, type string")
    assert collected(R.invalid_paths(enrichment(spark), fields)) == [
        ("T::C", "configuration.a"),
        ("T::C", "nowhere"),
    ]


def test_pending(spark):
    raw = spark.createDataFrame([("a",), ("b",), ("c",)], "resource_type string")
    done = spark.createDataFrame([("a",), ("b",)], "resource_type string")
    assert collected(R.pending(raw, done)) == [("c",)]
    assert R.pending(raw, done, force=True).count() == 3
    assert collected(R.pending(raw, done, only=("b", "c"))) == [("c",)]
    assert collected(R.pending(raw, done, limit=2)) == []
    assert collected(R.pending(raw, done, limit=2, force=True)) == [("a",), ("b",)]


def test_context(spark):
    matches = spark.createDataFrame(
        [("q", "T::B", 2), ("q", "T::A", 1), ("q", "T::Z", 3), ("p", "T::A", 1)],
        "query_id string, resource_type string, rank int",
    )
    docs = spark.createDataFrame([("T::A", "doc a"), ("T::B", "doc b")], "resource_type string, document string")
    got = dict(collected(R.context_for(matches, docs)))
    placeholder = "# T::Z\n\n_(no enriched doc bundled)_\n"
    assert got == {"q": f"doc a\n\n---\n\ndoc b\n\n---\n\n{placeholder}", "p": "doc a"}
