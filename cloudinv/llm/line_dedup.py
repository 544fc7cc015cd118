"""Drop lines that many documents share, with built-in functions only.

Lines are exploded once into (document, position, hash of the normalised line); the hashes
are counted by distinct document, and the positions to drop go back to their documents.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudinv.llm.common import BLANKS, ascii_lower, read, stored, text_key

MIN_CHARS = 20
MIN_DOCS = 3


def _lines():
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    r"""``docs`` with repeated lines taken out of ``text``, and ``n_lines``, ``n_dropped``.

    A line's key is the line stripped of ``[\x20\x09-\x0D]`` with A-Z lower-cased. Keys of at
    least ``min_chars`` code points found in at least ``min_docs`` distinct doc_ids lose all
    their lines, except in the largest doc_id that holds them (there all of them stay).

    A null or empty text is one empty line, and stays as it is. A null doc_id is an id like
    any other, smaller than all. Rows with one doc_id count as one document; each is returned.
    Columns ``n_lines`` and ``n_dropped`` of the input are replaced, others are kept.

    Plan: two small shuffles for the counts, one join of lines with dropped keys (both sides
    bare shuffles, so a line found in a third of all documents is split over tasks), and one
    shuffle of the texts by document.
    """
    key = ascii_lower(F.btrim(F.col("line"), F.lit(BLANKS)))
    lines = stored(
        docs.select("doc_id", text_key().alias("row"), F.posexplode(_lines()).alias("pos", "line"))
        .withColumn("key", key)
        .where(F.length("key") >= min_chars)
        .select("doc_id", "row", "pos", F.xxhash64("key").alias("h"), F.hash("key").alias("g")),
        "lines",
    )
    shared = (
        lines.groupBy("h", "g", "doc_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("h", "g")
        .agg(F.count("one").alias("docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select("h", "g", "keeper")
        # A shuffle of its own: the join then has bare shuffles on both sides.
        .hint("rebalance")
    )
    dropped = (
        lines.join(shared, ["h", "g"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "row")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    left = docs.drop("n_lines", "n_dropped").withColumn("__row", text_key())
    right = dropped.select(
        F.col("doc_id").alias("__id"), F.col("row").alias("__key"), F.col("dropped").alias("__gone")
    )
    on = left["doc_id"].eqNullSafe(right["__id"]) & (left["__row"] == right["__key"])
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    joined = left.join(right, on, "left").withColumn("__lines", _lines())
    text = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    return joined.select(
        *[
            F.when(F.col("__gone").isNull(), F.col("text")).otherwise(text).alias("text")
            if c == "text"
            else F.col(f"`{c}`")
            for c in left.columns
            if c != "__row"
        ],
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("n_dropped"),
    )


def op5_line_dedup(spark, sf_dir) -> DataFrame:
    found = line_dedup(read(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("text"), F.lit(""))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
flagged AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
  FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
