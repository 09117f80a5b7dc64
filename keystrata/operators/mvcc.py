"""Multi-version reads, commit logs, timestamps and optimistic validation."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.operators.upsert import newest, newest_wins


def snapshot_at(versions: DataFrame, ts: int, key: str = "key") -> DataFrame:
    """The live version of each key at ts: the newest with commit_ts <= ts unless that is a tombstone."""
    return newest_wins(versions.where(F.col("commit_ts") <= ts), [key], ["commit_ts"], "tombstone")


def last_commit(keys: DataFrame, versions: DataFrame, key: str = "key") -> DataFrame:
    """Each key's newest commit_ts, 0 if it was never written."""
    last = versions.groupBy(key).agg(F.max("commit_ts").alias("last_commit_ts"))
    return keys.join(last, key, "left").withColumn("last_commit_ts", F.coalesce("last_commit_ts", F.lit(0)).cast("bigint"))


def written_between(keys: DataFrame, versions: DataFrame, after: int, upto: int, key: str = "key") -> DataFrame:
    """The keys with any commit in (after, upto]."""
    return keys.join(versions.where((F.col("commit_ts") > after) & (F.col("commit_ts") <= upto)), key, "left_semi")


def version_history(versions: DataFrame, key: str = "key") -> DataFrame:
    """Appends version_rank: 1 for a key's newest version. A key's versions meet in one task, ordered with spilling."""
    return versions.withColumn("version_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("commit_ts").desc())))


def apply_commits(log: DataFrame, key: str = "key") -> DataFrame:
    """Versions from a log that may repeat entries: per (key, commit_ts) the one of the least log_index holds."""
    return newest(log, [key, "commit_ts"], ["log_index"], first=True)


def explode_commits(commits: DataFrame) -> DataFrame:
    """(log_index, commit_ts, key, value, tombstone) from rows (log_index, commit_ts, writes array<struct<key,value,tombstone>>)."""
    return commits.select("log_index", "commit_ts", F.explode("writes").alias("w")).select("log_index", "commit_ts", "w.key", "w.value", "w.tombstone")


#: Milliseconds that one task carries stamps over; what is left between such spans is one row for each.
SPAN_MS = 65_536


def hlc_stamp(df: DataFrame, ms: Column, order: str, name: str = "hlc") -> DataFrame:
    """Appends timestamps that rise with ``order`` within a millisecond and never repeat.

    A millisecond's rows begin at its own first stamp, or where the ones before it end if these ran over: a running
    maximum over the milliseconds' counts, within spans of them and then over the spans.
    """
    rows = df.withColumn("_ms", ms.cast("bigint")).withColumn("_span", F.floor(F.col("_ms") / SPAN_MS))
    held = rows.groupBy("_span", "_ms").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_span").orderBy("_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).withColumn("_ahead", F.max(F.shiftleft("_ms", 16) - F.col("_before")).over(upto))
    spans = held.groupBy("_span").agg(F.sum("_n").alias("_total"), F.max("_ahead").alias("_most"))
    past = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_past", F.coalesce(F.sum("_total").over(past), F.lit(0)))
    spans = spans.withColumn("_carry", F.max(F.col("_most") - F.col("_past")).over(past)).select("_span", "_past", "_carry")
    first = F.col("_past") + F.col("_before") + F.greatest(F.col("_ahead") - F.col("_past"), F.col("_carry"))
    starts = held.join(spans, "_span").select("_ms", first.alias("_first"))
    counter = F.row_number().over(Window.partitionBy("_ms").orderBy(order)) - 1
    stamped = rows.withColumn("_nth", counter).join(starts, "_ms", "left")
    return stamped.withColumn(name, F.col("_first") + F.col("_nth")).drop("_ms", "_span", "_nth", "_first").select(*(c for c in df.columns if c != name), name)


class Clock:
    """A hybrid logical clock on the driver; it never repeats a stamp."""

    def __init__(self, now_ms=lambda: time.time_ns() // 1_000_000):
        self.last, self.now_ms = 0, now_ms

    def now(self) -> int:
        self.last = max(self.last + 1, self.now_ms() << 16)
        return self.last

    def update(self, seen: int) -> int:
        self.last = max(self.last, seen)
        return self.now()


def validate_history(txns: DataFrame, versions: DataFrame, window: int, key: str = "key") -> DataFrame:
    """txns (txn_id, key, read_ts, commit_ts) with ``conflict``: whether a fixed history has another commit of the key in (read_ts, commit_ts).

    Joining by key and by windows of that length of commit_ts keeps a hot key's commits in many small groups. A longer
    transaction is joined with every window that it spans.
    """
    spans = txns.where("commit_ts > read_ts").withColumn("_bucket", F.explode(F.expr(f"sequence(read_ts DIV {window}, (commit_ts - 1) DIV {window})")))
    held = versions.select(key, F.col("commit_ts").alias("_ts"), F.expr(f"commit_ts DIV {window}").alias("_bucket"))
    hit = spans.join(held, [key, "_bucket"]).where((F.col("_ts") > F.col("read_ts")) & (F.col("_ts") < F.col("commit_ts"))).select("txn_id").distinct()
    return txns.join(hit.withColumn("conflict", F.lit(True)), "txn_id", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def fold_transactions(txns: list[dict], history: dict[str, int] | None = None) -> list[dict]:
    """Validates transactions in commit order against those accepted before: an aborted one installs nothing.

    txns: {txn_id, read_ts, commit_ts, reads, writes}; history: each key's newest commit. This is a fold over an order,
    so it is for one batch of commits on the driver, as a commit point is.
    """
    last, out = dict(history or {}), []
    for t in sorted(txns, key=lambda t: (t["commit_ts"], t["txn_id"])):
        touched = {*t["reads"], *t["writes"]} if len(t["writes"]) else set()
        ok = not any(t["read_ts"] < last.get(k, 0) <= t["commit_ts"] for k in touched)
        if ok:
            last.update(dict.fromkeys(t["writes"], t["commit_ts"]))
        out.append({"txn_id": t["txn_id"], "commit_ts": t["commit_ts"], "committed": ok})
    return out


def fold_by_group(txns: DataFrame, group: str = "group_id") -> DataFrame:
    """``fold_transactions`` for each group of transactions that share no key with other groups (connected key sets)."""
    import pandas as pd

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fold_transactions(pdf.to_dict("records")), columns=["txn_id", "commit_ts", "committed"])

    return txns.groupBy(group).applyInPandas(apply, "txn_id string, commit_ts bigint, committed boolean")


def overlay(snapshot: DataFrame, own: DataFrame, key: str = "key") -> DataFrame:
    """What a transaction reads: its own writes (key, value, tombstone, seq; last one wins) over a snapshot (key, value)."""
    base = snapshot.select(key, "value", F.lit(False).alias("tombstone"), F.lit(-1).cast("bigint").alias("_seq"))
    delta = own.select(key, "value", "tombstone", F.col("seq").cast("bigint").alias("_seq"))
    return newest_wins(base.unionByName(delta), [key], ["_seq"], "tombstone").select(key, "value")


class Transaction:
    """A session: reads a snapshot, buffers writes, remembers every key it asked for, present or not."""

    def __init__(self, manager: "Transactions", txn_id: str, read_ts: int):
        self.manager, self.txn_id, self.read_ts = manager, txn_id, read_ts
        self.reads: set[str] = set()
        self.writes: dict[str, tuple[str | None, bool]] = {}
        self.done = False

    def _open(self) -> None:
        if self.done:
            raise ValueError("transaction is finished")

    def get(self, key: str) -> str | None:
        self._open()
        if key in self.writes:
            return self.writes[key][0]
        self.reads.add(key)
        row = snapshot_at(self.manager.versions.where(F.col("key") == key), self.read_ts).first()
        return row.value if row else None

    def put(self, key: str, value: str) -> None:
        self._open()
        self.writes[key] = (value, False)

    def delete(self, key: str) -> None:
        self._open()
        self.writes[key] = (None, True)

    def abort(self) -> None:
        self.done = True


class Transactions:
    """Optimistic transactions over a relation of versions (key, commit_ts, value, tombstone) in a store.

    A commit appends its writes as a part, and the store refuses a part that another writer's came before, so that what
    is accepted is durable and validated against everything accepted earlier. ``versions`` starts a new relation.
    """

    SCHEMA = "key string, commit_ts bigint, value string, tombstone boolean"

    def __init__(self, store, versions: DataFrame | None = None, clock: Clock | None = None, name: str = "versions"):
        self.spark, self.store, self.name, self._next = store.spark, store, name, 0
        self.clock, self._seen = clock or Clock(), (0, 0)
        if not store.version(name):
            store.write(name, self.spark.createDataFrame([], self.SCHEMA) if versions is None else versions.select("key", "commit_ts", "value", "tombstone"))

    def _newest(self) -> tuple[int, int]:
        """The relation's version and its last commit, which the clock then follows."""
        at = self.store.version(self.name)
        if self._seen[0] != at:
            self._seen = at, self.store.read(self.name, at).agg(F.coalesce(F.max("commit_ts"), F.lit(0))).first()[0]
            self.clock.update(self._seen[1])
        return self._seen

    @property
    def versions(self) -> DataFrame:
        return self.store.read(self.name)

    def begin(self) -> Transaction:
        """A transaction that reads what is committed now: whatever commits later is stamped later, by any clock."""
        self._next += 1
        return Transaction(self, f"t{self._next}", self._newest()[1])

    def commit(self, t: Transaction) -> tuple[bool, int]:
        """Whether it committed, and its commit timestamp (0 if it wrote nothing or was rejected)."""
        t._open()
        t.done = True
        if not t.writes:
            return True, 0
        at = self._newest()[0]
        ts = self.clock.now()
        touched = self.spark.createDataFrame([(k,) for k in {*t.reads, *t.writes}], "key string")
        if not written_between(touched, self.store.read(self.name, at), t.read_ts, ts).isEmpty():
            return False, 0
        rows = [(k, ts, v, dead) for k, (v, dead) in t.writes.items()]
        self.store.append(self.name, self.spark.createDataFrame(rows, self.SCHEMA), after=at)
        return True, ts
