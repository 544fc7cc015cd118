"""Connected components of an undirected graph given as pairs, all in DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudinv.llm.common import stored


def components(pairs: DataFrame) -> DataFrame:
    """(node, label) for every node in ``pairs`` (two long columns a, b); label: the component's least node.

    Labels fall to the least label among the neighbours, then to their label's own label, until
    none changes. Each round is written to the shared folder, so both sides of its joins are
    bare shuffles that adaptive execution splits when a node has very many neighbours. Pairs
    with a null are left out, loops and repeats do no harm; no pairs give no rows.
    """
    both = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    edges = stored(
        both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    total = _total(labels)
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        lower = stored(labels.union(heard).groupBy("node").agg(F.min("label").alias("label")), "labels")
        parent = lower.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = stored(lower.join(parent, "label").select("node", F.col("above").alias("label")), "labels")
        before, total = total, _total(labels)
        if before == total:
            return labels


def _total(labels: DataFrame):
    """Labels only ever fall, so an equal sum means equal labels."""
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
