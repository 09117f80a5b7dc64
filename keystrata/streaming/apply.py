"""Applying a growing log of commands with Structured Streaming.

Each batch folds into the stored state by newest index, so that a batch which is delivered again, as after a restart,
changes nothing. Recomputing the state from the whole log gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystrata.operators.replication import decode
from keystrata.operators.upsert import newest
from keystrata.sources.store import Store

LOG = "index bigint, term bigint, command string"
STATE = "key string, value string, tombstone boolean, index bigint"


def fold(state: DataFrame, log: DataFrame) -> DataFrame:
    """The newest change of each key of a state (STATE, tombstones kept) and more log entries."""
    ops = decode(log).where("kind IN ('set', 'delete') AND key IS NOT NULL")
    return newest(state.unionByName(ops.select("key", "value", (F.col("kind") == "delete").alias("tombstone"), "index")), ["key"], ["index"])


def apply_stream(spark: SparkSession, log_dir: str, store: Store, checkpoint: str, name: str = "state", available_now: bool = False) -> StreamingQuery:
    """Starts a query that keeps ``store``'s relation up to date with the JSON lines that arrive in log_dir."""

    def batch(rows: DataFrame, _: int) -> None:
        old = store.read(name) if store.version(name) else spark.createDataFrame([], STATE)
        store.write(name, fold(old, rows))

    writer = spark.readStream.schema(LOG).json(log_dir).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def live(store: Store, name: str = "state") -> DataFrame:
    return store.read(name).where(~F.col("tombstone")).drop("tombstone")
