"""Two-phase commit over shards, as queries over prepare and decision logs.

Prepare log: (shard, seq, txn_id, commit_ts, ops array<struct<kind,key,value>>, phase); decisions: (seq, txn_id, outcome).
State is derived from the logs, so a crash between the decision and its application loses nothing.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.operators.upsert import newest, newest_wins

KINDS = ("put", "delete")


def check_ops(ops: list[tuple[str, str, str | None]]) -> None:
    """Refuses unknown kinds before anything is prepared."""
    for kind, _, _ in ops:
        if kind not in KINDS:
            raise ValueError(f"unknown op kind {kind}")


def group_by_shard(txns: DataFrame, shard: Column) -> DataFrame:
    """(txn_id, shard, ops) from (txn_id, ops): the ops of each owner in their order. ``shard`` is an expression over ``key``."""
    ops = txns.select("txn_id", F.posexplode("ops").alias("pos", "op")).withColumn("key", F.col("op.key")).withColumn("shard", shard)
    return ops.groupBy("txn_id", "shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "op"))), lambda x: x["op"]).alias("ops"))


def latest_phase(prepares: DataFrame) -> DataFrame:
    """The last record of each (shard, txn_id)."""
    return newest(prepares, ["shard", "txn_id"], ["seq"])


def pending(prepares: DataFrame) -> DataFrame:
    """Prepared transactions that are neither applied nor aborted."""
    return latest_phase(prepares).where("phase = 'prepared'")


def decisions(log: DataFrame) -> DataFrame:
    """(txn_id, outcome): the last decision of each transaction."""
    return newest(log, ["txn_id"], ["seq"]).select("txn_id", "outcome")


def recover(prepares: DataFrame, log: DataFrame) -> DataFrame:
    """Pending transactions of each shard with how they end: as decided, and abort without a decision."""
    return pending(prepares).join(decisions(log), "txn_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("abort")))


def apply_ops(base: DataFrame, resolved: DataFrame) -> DataFrame:
    """base (key, value) after the ops of committed transactions, by commit_ts and place; keys are routed anew."""
    ops = resolved.where("outcome = 'commit'").select("commit_ts", "txn_id", F.posexplode("ops").alias("pos", "op"))
    delta = ops.select(F.col("op.key").alias("key"), F.col("op.value").alias("value"), (F.col("op.kind") == "delete").alias("tombstone"), "commit_ts", "txn_id", "pos")
    old = base.select("key", "value", F.lit(False).alias("tombstone"), F.lit(-1).cast("bigint").alias("commit_ts"), F.lit("").alias("txn_id"), F.lit(-1).alias("pos"))
    return newest_wins(old.unionByName(delta), ["key"], ["commit_ts", "txn_id", "pos"], "tombstone").select("key", "value")


def outcome(log: DataFrame, txn_id: str) -> str:
    row = decisions(log.where(F.col("txn_id") == txn_id)).first()
    return row.outcome if row else ""


def recovered_counts(resolved: DataFrame) -> DataFrame:
    """How many participants' transactions recovery commits and aborts."""
    return resolved.groupBy("outcome").agg(F.count("*").alias("n"))


PREPARES = "shard string, seq bigint, txn_id string, commit_ts bigint, ops array<struct<kind:string,key:string,value:string>>, phase string"
DECISIONS = "seq bigint, txn_id string, outcome string"


class Crash(RuntimeError):
    """Raised where a simulated coordinator dies."""


class Coordinator:
    """Two-phase commit over the shards of a router: prepare on each, one decision, then application and marks.

    All steps are appends to two relations of the router's store. What counts is the decision: a transaction without
    one is aborted by ``recover``, one that was decided is applied, however often. Applying puts values, so repeating it
    changes nothing unless a later write to the key came between; ``recover`` therefore runs before new commits.
    """

    def __init__(self, router, clock=time.time_ns):
        self.router, self.store, self.clock, self.last = router, router.store, clock, 0
        for name, schema in (("twopc_prepares", PREPARES), ("twopc_decisions", DECISIONS)):
            if not self.store.version(name):
                self.store.write(name, self.store.spark.createDataFrame([], schema))

    def _now(self) -> int:
        self.last = max(self.last + 1, self.clock())
        return self.last

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        self.store.append(name, self.store.spark.createDataFrame(rows, schema))

    @property
    def prepares(self) -> DataFrame:
        return self.store.read("twopc_prepares")

    @property
    def log(self) -> DataFrame:
        return self.store.read("twopc_decisions")

    def prepare(self, ops: list[tuple[str, str, str | None]], txn_id: str | None = None) -> str:
        """Records each shard's part of (kind, key, value) operations; an unknown kind refuses all. The transaction's id."""
        check_ops(ops)
        txn_id, ts, parts = txn_id or uuid.uuid4().hex, self._now(), {}
        if not self.prepares.where(F.col("txn_id") == txn_id).isEmpty():
            raise ValueError(f"transaction {txn_id} exists")
        for op in ops:
            parts.setdefault(self.router.manifest.find(op[1]).id, []).append(op)
        if parts:
            self._append("twopc_prepares", [(shard, ts, txn_id, ts, own, "prepared") for shard, own in sorted(parts.items())], PREPARES)
        return txn_id

    def decide(self, txn_id: str, outcome: str) -> str:
        """Writes the decision unless there is one; the one that holds."""
        held = self.outcome(txn_id)
        if not held:
            self._append("twopc_decisions", [(self._now(), txn_id, outcome)], DECISIONS)
        return held or outcome

    def outcome(self, txn_id: str) -> str:
        """commit, abort, or empty if undecided."""
        return outcome(self.log, txn_id)

    def lookup(self, txn_id: str) -> DataFrame:
        """Each shard's last record of a transaction."""
        return latest_phase(self.prepares.where(F.col("txn_id") == txn_id))

    def pending(self) -> DataFrame:
        return pending(self.prepares)

    def _finish(self, records: list, outcome: str) -> None:
        """Applies or drops prepared records, each routed by its keys as they are owned now, and marks them."""
        if outcome == "commit":
            self.router.put_all([(o.key, None if o.kind == "delete" else o.value) for r in records for o in r.ops])
        phase = "applied" if outcome == "commit" else "aborted"
        if records:
            self._append("twopc_prepares", [(r.shard, self._now(), r.txn_id, r.commit_ts, r.ops, phase) for r in records], PREPARES)

    def commit(self, ops: list[tuple[str, str, str | None]], crash_after: str | None = None) -> str:
        """Prepares, decides and applies; ``crash_after`` prepare or decision raises there, for tests. The id."""
        txn_id = self.prepare(ops)
        if crash_after == "prepare":
            raise Crash(txn_id)
        held = self.decide(txn_id, "commit")
        if crash_after == "decision":
            raise Crash(txn_id)
        self._finish(self.lookup(txn_id).where("phase = 'prepared'").collect(), held)
        return txn_id

    def abort(self, txn_id: str) -> None:
        """Ends a prepared transaction; one that was decided to commit can't be aborted."""
        if self.decide(txn_id, "abort") == "commit":
            raise ValueError(f"transaction {txn_id} was committed")
        self._finish(self.lookup(txn_id).where("phase = 'prepared'").collect(), "abort")

    def recover(self) -> dict[str, int]:
        """Ends what is pending, oldest first: as decided, or by an abort that is written down. How many ended each way.

        Pending transactions are those in flight at a crash, which a coordinator held one by one.
        """
        ended = {"commit": 0, "abort": 0}
        records: dict[tuple, list] = {}
        for r in recover(self.prepares, self.log).collect():
            records.setdefault((r.commit_ts, r.txn_id, r.outcome), []).append(r)
        for (_, txn_id, found), own in sorted(records.items(), key=lambda x: x[0]):
            held = self.decide(txn_id, found)
            self._finish(own, held)
            ended[held] += 1
        return ended
