"""Benchmark items inside documents, with built-in functions only.

An item's set of word shingles has a MinHash signature: its smallest shingle hashes, as many as its
size asks for. An item of n shingles of which a share of at least t lies in a document misses at
most n - ceil(t n) of them there, so of any n - ceil(t n) + 1 at least one is in the document. The
sizes of the items so partition the search: each size has its own signature length, and no document
however long can hide an item. Shingles that fewer items hold come first in a signature, by hash
among equally rare ones, so an opening that many items share makes no candidates. Candidates are
verified by exact containment, as counts of shared shingles. Items with one set of shingles are one
until the end.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudinv.llm.common import ascii_lower, read, stored, text_key

SHINGLE = 5
CONTAINMENT = 0.8
#: Most signature rows (about 24 bytes each) that are broadcast; beyond, they are shuffled.
BROADCAST_ROWS = 200_000


def _words(text: str = "text") -> Column:
    blank = r"[\x20\x09-\x0D]+"
    all_words = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), blank)
    return F.filter(all_words, lambda w: w != "")


def _starts(words: Column, shingle: int) -> Column:
    """Where shingles start; fewer words than a shingle make one, none make none."""
    last = F.greatest(F.size(words) - shingle, F.lit(0))
    return F.when(F.size(words) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), last))


def _hash(words: Column, at: Column, shingle: int) -> Column:
    return F.xxhash64(*[F.get(words, at + F.lit(j)) for j in range(shingle)])


def _hashes(words: str, shingle: int) -> Column:
    return F.transform(_starts(F.col(words), shingle), lambda i: _hash(F.col(words), i, shingle))


def _shingles(words: str, shingle: int) -> Column:
    """The shingles themselves, each once."""
    joined = lambda i: F.array_join(F.slice(F.col(words), i + 1, shingle), " ")
    return F.array_distinct(F.transform(_starts(F.col(words), shingle), joined))


def signatures(items: DataFrame, shingle: int, containment: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item_id, item), the distinct shingle sets (item, n, shingles), and signatures (h, item).

    ``item`` names a set of shingles. A document that holds enough of the set holds a shingle of its
    signature.
    """
    named = stored(
        items.select("item_id", F.array_sort(_shingles("words", shingle)).alias("shingles"))
        .where(F.size("shingles") > 0)
        .select("item_id", F.md5(F.array_join("shingles", "\n").cast("binary")).alias("item"), "shingles"),
        "named",
    )
    sets = stored(named.groupBy("item").agg(F.first("shingles").alias("shingles")), "sets")
    hashed = stored(
        sets.select("item", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
        .select("item", "n", _hash(F.split("s", " "), F.lit(0), shingle).alias("h")), "hashed"
    )
    held = stored(hashed.groupBy("h").agg(F.count("*").alias("held")), "held")
    # The least number of shared shingles that is enough, kept from the rounding of t * n.
    enough = F.ceil(F.lit(containment) * F.col("n") - F.lit(1e-9)).cast("int")
    ordered = (
        hashed.join(held, "h").groupBy("item", "n").agg(F.array_sort(F.collect_list(F.struct("held", "h"))).alias("order"))
        .select("item", F.explode(F.slice("order", F.lit(1), F.col("n") - enough + 1)).alias("own"))
    )
    return named.select("item_id", "item").distinct(), sets, ordered.select("own.h", "item")


def find_items(
    docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT
) -> DataFrame:
    r"""doc_id, row, item_id, n_shingles, n_shared: items of which a document holds enough.

    Words are ``[^\x20\x09-\x0D]+`` with A-Z lower-cased; an item's shingles are counted once, and
    n_shared of its n_shingles occur in the document, at least the share ``containment``. An item
    of fewer words than a shingle is one shingle, found only in documents that are just that text.
    Items without words are never found, nor are any in null or empty texts. Null item ids are
    items like others; of items repeated under one id each text counts as an item, and equal ones
    once. Rows that share doc_id and text are found once.
    """
    members, sets, signed = signatures(items.select("item_id", _words().alias("words")), shingle, containment)
    probes = stored(signed.groupBy("h").agg(F.collect_list("item").alias("items")), "probes")
    rows, highest = probes.agg(F.count("*"), F.max("h")).first()
    hashes = F.array_distinct(F.filter(_hashes("words", shingle), lambda h: h <= F.lit(highest)))
    shingled = (
        docs.select("doc_id", text_key().alias("row"), _words().alias("words"))
        .select("doc_id", "row", F.explode(hashes).alias("h"))
    )
    near = F.broadcast(probes) if rows <= BROADCAST_ROWS else probes
    candidates = stored(
        shingled.join(near, "h").select("doc_id", "row", F.explode("items").alias("item")).distinct(), "candidates"
    )
    left = docs.select(F.col("doc_id").alias("d"), "text", text_key().alias("r"))
    # Joined by a shuffle at every size: a broadcast that ends at some size makes the work jump there.
    which = candidates.select("doc_id", "row").distinct().hint("merge")
    on = left["d"].eqNullSafe(which["doc_id"]) & (left["r"] == which["row"])
    # Shingles of the few documents that have candidates, once for rows alike in id and text.
    own = (
        left.join(which, on, "left_semi").dropDuplicates(["d", "r"])
        .withColumn("words", _words()).select("d", "r", F.explode(_shingles("words", shingle)).alias("t"))
    )
    wanted = candidates.join(
        sets.select("item", F.size("shingles").alias("n_shingles"), F.explode("shingles").alias("s")).hint("rebalance"), "item"
    )
    same = wanted["doc_id"].eqNullSafe(own["d"]) & (wanted["row"] == own["r"]) & (wanted["s"] == own["t"])
    shared = (
        wanted.join(own, same).groupBy("doc_id", "row", "item", "n_shingles").agg(F.count("*").cast("int").alias("n_shared"))
        .where(F.col("n_shared") >= F.lit(containment) * F.col("n_shingles") - F.lit(1e-9))
    )
    return stored(shared, "shared").join(members, "item").select("doc_id", "row", "item_id", "n_shingles", "n_shared").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the rows in which an item is found; see :func:`find_items`."""
    found = stored(find_items(docs, items, **parameters).select("doc_id", "row").distinct(), "found")
    left = docs.withColumn("__row", text_key())
    on = left["doc_id"].eqNullSafe(found["doc_id"]) & (left["__row"] == found["row"])
    return left.join(found, on, "left_anti").drop("__row")


def op7_decontamination(spark, sf_dir) -> DataFrame:
    found = find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared")


def containment_sql(documents: str = "documents") -> str:
    """Exact containment of all items in all documents."""
    blank = "[\\x20\\x09-\\x0D]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def shingles(table: str, key: str) -> str:
        return f"""
  SELECT DISTINCT {key}, s FROM (
    SELECT {key}, unnest([array_to_string(w[i:i + {SHINGLE - 1}], ' ')
                          FOR i IN generate_series(1, greatest(len(w) - {SHINGLE - 1}, 1))]) AS s
    FROM (SELECT {key}, [x FOR x IN regexp_split_to_array({lower.format("coalesce(text, '')")}, '{blank}')
                         IF x <> ''] AS w FROM {table}) WHERE len(w) > 0)"""

    return f"""
WITH items AS ({shingles("benchmark", "item_id")}),
sizes AS (SELECT item_id, CAST(count(*) AS INTEGER) AS n_shingles FROM items GROUP BY item_id),
docs AS ({shingles(documents, "doc_id")}),
shared AS (SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS n_shared
           FROM docs JOIN items USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared FROM shared JOIN sizes USING (item_id)
WHERE n_shared >= {CONTAINMENT} * n_shingles"""


ORACLE = containment_sql()
