"""Session settings the library relies on, and its shared scratch folder."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # All timestamps are UTC instants.
    "spark.sql.session.timeZone": "UTC",
    # Account ids are twelve digits; inferring a number would lose leading zeros.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # Stored JSON takes some ten times its zstd size in memory. Without this a side that
    # looks small on disk is broadcast although it is not.
    "spark.sql.sources.fileCompressionFactor": "10.0",
    # Rows with long texts reach Python in batches that fit beside the JVM.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # The state of streams lies in files beside the executors' memory; timers need this store.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Splits hot join keys and hot accounts at run time, merges small partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session; sizes stay the cluster's choice."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A runtime setting for what is run or started within."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def workspace(spark: SparkSession, label: str = "run") -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) falls back to a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        base = tempfile.mkdtemp(prefix="cloudinv-")
    return f"{base.rstrip('/')}/cloudinv-{label}-{uuid.uuid4().hex}"
