"""Bounded samples of labelled documents for the classifiers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudinv.llm.common import held_out

FOLDS, HELD = 5, 0


def training_labels(labels: DataFrame, column: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of at most ``per_class`` documents of each class, and the classes' sizes.

    Held-out ids, null ids and null labels are left out; of contradicting labels the larger
    counts. The sample is the ids with the smallest hashes, so it is the same in every run.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out("doc_id", FOLDS, HELD))
        .groupBy("doc_id")
        .agg(F.max(column).cast("int").alias("label"))
    )
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = [
        known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)
    ]
    return picked[0].union(picked[1]), sizes


def training_rows(docs: DataFrame, labels: DataFrame, column: str, per_class: int):
    """The sampled labels joined with their texts (one text for each id), and the classes' sizes.

    The sample holds at most two times ``per_class`` ids, which bounds the broadcast.
    """
    picked, sizes = training_labels(labels, column, per_class)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return rows, sizes
