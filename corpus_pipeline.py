"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. A stage's
result is written to the shared scratch folder and read again by the next one. All but the last
return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudinv.llm.common import read, stored
from cloudinv.llm.decontamination import decontaminate
from cloudinv.llm.line_dedup import line_dedup
from cloudinv.llm.packing import pack_documents
from cloudinv.llm.simhash import near_dedup
from cloudinv.llm.toxicity import drop_toxic
from cloudinv.session import configure


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores as toxic go."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; n_chars follows the text. Every document stays."""
    shorter = line_dedup(docs).withColumn("n_chars", F.length("text").cast("long"))
    return shorter.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return pack_documents(docs)


def _configured(stage):
    """The stage in a session with the settings that bound its tasks' memory."""
    return lambda spark, docs, sf_dir: stage(configure(spark), docs, sf_dir)


STAGES = [
    ("toxicity", _configured(toxicity)),
    ("line_dedup", _configured(lines)),
    ("simhash_near_dedup", _configured(near_duplicates)),
    ("decontamination", _configured(decontamination)),
    ("best_fit_packing", _configured(packing)),
]

#: The scores of the first stage are learned, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
