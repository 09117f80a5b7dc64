"""The data side of log replication: what is committed, what is applied, and how a follower's log is mended.

Elections, heartbeats and transport are the cluster manager's. Logs have rows (index, term, command).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.operators.upsert import newest_wins

COMMAND = "kind string, key string, value string, txn struct<commit_ts:bigint,writes:array<struct<key:string,value:string,tombstone:boolean>>>"


def commit_index(match: DataFrame, log: DataFrame, current_term: int) -> DataFrame:
    """One row: the largest index of the current term that a majority of nodes holds, 0 if none. match: (node, match_index)."""
    held = match.agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("m")).select(F.element_at("m", F.expr("CAST(size(m) DIV 2 + 1 AS int)")).alias("majority"))
    best = log.where(F.col("term") == current_term).crossJoin(F.broadcast(held)).where(F.col("index") <= F.col("majority"))
    return best.agg(F.coalesce(F.max("index"), F.lit(0)).cast("bigint").alias("commit_index"))


def encode_set(key: Column, value: Column) -> Column:
    return F.to_json(F.struct(F.lit("set").alias("kind"), key.alias("key"), value.alias("value")))


def encode_delete(key: Column) -> Column:
    return F.to_json(F.struct(F.lit("delete").alias("kind"), key.alias("key")))


def encode_commit(commit_ts: Column, writes: Column) -> Column:
    return F.to_json(F.struct(F.lit("txn_commit").alias("kind"), F.struct(commit_ts.alias("commit_ts"), writes.alias("writes")).alias("txn")))


def decode(log: DataFrame) -> DataFrame:
    """(index, kind, key, value, txn) of the entries whose command can be read; others do nothing."""
    parsed = log.withColumn("c", F.from_json("command", COMMAND))
    return parsed.where("c.kind IN ('set', 'delete', 'txn_commit')").select("index", "c.*")


def apply_prefix(log: DataFrame, upto: int) -> DataFrame:
    """(key, value, index): the live state after the plain commands up to an index, each applied once even if repeated."""
    ops = decode(log.where(F.col("index") <= upto)).where("kind IN ('set', 'delete') AND key IS NOT NULL")
    return newest_wins(ops.select("key", "value", "index", (F.col("kind") == "delete").alias("tombstone")), ["key"], ["index"], "tombstone").drop("tombstone")


def reconcile(follower: DataFrame, entries: DataFrame, prev_index: int, prev_term: int) -> DataFrame | None:
    """The follower's log after an append, or None if it lacks the entry before. A term conflict cuts off its tail."""
    if prev_index and follower.where((F.col("index") == prev_index) & (F.col("term") == prev_term)).isEmpty():
        return None
    mine, new = follower.alias("f"), entries.alias("e")
    clash = mine.join(new, F.col("f.index") == F.col("e.index")).where("f.term <> e.term").agg(F.min("f.index")).first()[0]
    kept = follower if clash is None else follower.where(F.col("index") < clash)
    return kept.unionByName(entries.join(kept.select("index"), "index", "left_anti"))


class ReplicatedLog:
    """A log of commands in a store, with the state that its applied prefix leaves.

    Appending, committing, applying and cutting are separate steps, each durable; opening again goes on where the last
    one ended. ``truncate`` rewrites the log without what the state holds already, so that it doesn't grow for ever.
    """

    LOG = "index bigint, term bigint, command string"
    STATE = "key string, value string, index bigint"

    def __init__(self, store, name: str = "log"):
        self.store, self.spark, self.name, self.state = store, store.spark, name, f"{name}_state"
        if not store.version(self.state):
            store.write(self.state, self.spark.createDataFrame([], self.STATE), key="key")
        if not store.version(f"{name}_marks"):
            store.write(f"{name}_marks", self.spark.createDataFrame([("applied", 0), ("cut", 0)], "mark string, index bigint"), key="mark")
        if not store.version(name):
            store.write(name, self.spark.createDataFrame([], self.LOG))

    def entries(self) -> DataFrame:
        return self.store.read(self.name)

    def _mark(self, mark: str) -> int:
        return self.store.read(f"{self.name}_marks").where(F.col("mark") == mark).first()["index"]

    def last_index(self) -> int:
        return max(self._mark("cut"), self.entries().agg(F.coalesce(F.max("index"), F.lit(0))).first()[0])

    def propose(self, commands: list[str], term: int) -> int:
        """Appends commands under the next indexes; the last of these. Another writer's append in between is an error."""
        at, last = self.store.version(self.name), self.last_index()
        rows = [(last + 1 + i, term, c) for i, c in enumerate(commands)]
        if rows:
            self.store.append(self.name, self.spark.createDataFrame(rows, self.LOG), after=at)
        return last + len(rows)

    def follow(self, entries: DataFrame, prev_index: int, prev_term: int) -> bool:
        """Takes a leader's entries; False if the one before them is missing. A term conflict rewrites the log's tail."""
        if prev_index and prev_index == self._mark("cut"):
            prev_index = 0
        log = reconcile(self.entries(), entries, prev_index, prev_term)
        if log is not None:
            self.store.write(self.name, log)
        return log is not None

    def apply(self, upto: int) -> int:
        """Brings the state to an index; entries that it holds already do nothing. How far it is."""
        done = self._mark("applied")
        if upto > done:
            ops = decode(self.entries().where((F.col("index") > done) & (F.col("index") <= upto))).where("kind IN ('set', 'delete') AND key IS NOT NULL")
            last = newest_wins(ops.select("key", "value", "index", (F.col("kind") == "delete").alias("_dead")), ["key"], ["index"])
            self.store.append(self.state, last)
            self._set("applied", upto)
        return max(upto, done)

    def _set(self, mark: str, index: int) -> None:
        self.store.append(f"{self.name}_marks", self.spark.createDataFrame([(mark, index, False)], "mark string, index bigint, _dead boolean"))

    def truncate(self) -> int:
        """Cuts off the entries that are applied; the state stands for them. The last index that was cut."""
        upto = self._mark("applied")
        self._set("cut", upto)
        self.store.write(self.name, self.entries().where(F.col("index") > upto))
        return upto

    def live(self) -> DataFrame:
        """(key, value, index) of the applied state."""
        return self.store.read(self.state).select("key", "value", "index")
