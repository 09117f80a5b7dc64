"""Range sharding: a manifest of half-open key ranges, and what follows from it. Keys are strings in byte order."""

from __future__ import annotations

import bisect
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.values import in_range
from keystrata.operators.scan import nth_key, nth_keys
from keystrata.sources.store import cut_lineage

#: Past this many shards ownership is found by a range join instead of an expression.
MANY = 2000


@dataclass(frozen=True)
class Shard:
    """Keys from start (included) to end (not included; empty: open)."""

    id: str
    start: str
    end: str

    def contains(self, key: str) -> bool:
        return key >= self.start and (not self.end or key < self.end)

    def overlaps(self, start: str, end: str) -> bool:
        return (not self.end or start < self.end) and (not end or self.start < end)


class Manifest:
    """Shards in key order that cover all keys without gaps."""

    def __init__(self, shards: list[Shard] | None = None):
        self.shards = sorted(shards or [Shard("s0", "", "")], key=lambda s: s.start)
        ends = [s.end for s in self.shards]
        if self.shards[0].start or ends[-1] or any(a != b.start or a <= s.start for a, b, s in zip(ends, self.shards[1:], self.shards, strict=False)):
            raise ValueError("ranges must be in order, without gaps or overlaps")

    def find(self, key: str) -> Shard:
        return self.shards[bisect.bisect_right([s.start for s in self.shards], key) - 1]

    def prune(self, start: str, end: str) -> list[Shard]:
        """The shards that a scan of [start, end) must visit."""
        return [s for s in self.shards if s.overlaps(start, end)]

    def next_id(self) -> str:
        return f"s{max((int(s.id[1:]) for s in self.shards if s.id[1:].isdigit()), default=-1) + 1}"

    def split(self, shard_id: str, key: str) -> Manifest:
        """The shard's range cut at key: the left part keeps the id. A key that isn't strictly inside is refused."""
        old = next((s for s in self.shards if s.id == shard_id), None)
        if old is None:
            raise ValueError(f"no shard {shard_id}")
        if not (old.start < key and old.contains(key)):
            raise ValueError(f"split key {key!r} isn't inside {shard_id}")
        cut = [Shard(old.id, old.start, key), Shard(self.next_id(), key, old.end)]
        return Manifest([s for s in self.shards if s.id != shard_id] + cut)

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(s.id, s.start, s.end) for s in self.shards], "shard string, start string, end string")


def owner(key: Column, manifest: Manifest) -> Column:
    """The id of the shard that owns a key, by binary search over the ranges' starts."""

    def tree(shards: list[Shard]) -> Column:
        if len(shards) == 1:
            return F.lit(shards[0].id)
        mid = len(shards) // 2
        return F.when(key < F.lit(shards[mid].start), tree(shards[:mid])).otherwise(tree(shards[mid:]))

    return F.when(key.isNotNull(), tree(manifest.shards))


def assign(df: DataFrame, key: str, manifest: Manifest) -> DataFrame:
    """df with the owning ``shard``; a null key has none."""
    if len(manifest.shards) <= MANY:
        return df.withColumn("shard", owner(F.col(key), manifest))
    ranges = manifest.frame(df.sparkSession)
    return df.join(ranges, (F.col(key) >= F.col("start")) & ((F.col("end") == "") | (F.col(key) < F.col("end"))), "left").drop("start", "end")


def status(df: DataFrame, key: str, manifest: Manifest) -> DataFrame:
    """Every shard with its range and number of keys."""
    counts = assign(df, key, manifest).groupBy("shard").agg(F.count("*").alias("n_keys"))
    return manifest.frame(df.sparkSession).join(counts, "shard", "left").withColumn("n_keys", F.coalesce("n_keys", F.lit(0)).cast("bigint"))


def range_scan(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    return df.where(in_range(F.col(key), start, end))


def median_key(df: DataFrame, key: str, shard: Shard, n_keys: int) -> str | None:
    """The key at place n // 2 (from 0) of a shard's sorted keys."""
    return nth_key(range_scan(df, key, shard.start, shard.end), key, n_keys // 2)


def rebalance(df: DataFrame, key: str, manifest: Manifest, threshold: int) -> tuple[Manifest, int]:
    """One pass: each shard of more than threshold keys splits once at its median. The manifest, and how many split.

    The medians of all of them are found together, by counts of bins within the shards.
    """
    counts = {r.shard: r.n_keys for r in status(df, key, manifest).collect()}
    hot = [s for s in manifest.shards if counts[s.id] > threshold]
    if not hot:
        return manifest, 0
    rows = assign(df.where(F.col(key).isNotNull()), key, manifest).where(F.col("shard").isin([s.id for s in hot])).select(key, "shard")
    at = nth_keys(rows, key, "shard", {s.id: counts[s.id] // 2 for s in hot})
    now, splits = manifest, 0
    for s in hot:
        if s.id in at and s.start < at[s.id]:
            now, splits = now.split(s.id, at[s.id]), splits + 1
    return now, splits


class Router:
    """Shards as keyed relations (key, value) of a store, with the manifest as a relation of its own.

    A put, get or delete goes to the shard that owns its key, a scan to those that its range meets. A split writes
    the two halves as new relations before the manifest that names them, so that a crash leaves the shard as it was.
    """

    MANIFEST = "manifest"

    def __init__(self, store, manifest: Manifest | None = None):
        self.store, self.spark = store, store.spark
        if store.version(self.MANIFEST):
            rows = store.read(self.MANIFEST).collect()
            self.manifest = Manifest([Shard(r.shard, r.start, r.end) for r in rows])
            self.relation = {r.shard: r.relation for r in rows}
        else:
            self.manifest, self.relation = manifest or Manifest(), {}
            for s in self.manifest.shards:
                self.relation[s.id] = self._made(s, self.spark.createDataFrame([], "key string, value string"))
            self._save()

    def _made(self, shard: Shard, rows: DataFrame) -> str:
        name = f"shard-{shard.id}-{uuid.uuid4().hex[:8]}"
        self.store.write(name, rows, key="key")
        return name

    def _save(self) -> None:
        rows = [(s.id, s.start, s.end, self.relation[s.id]) for s in self.manifest.shards]
        self.store.write(self.MANIFEST, self.spark.createDataFrame(rows, "shard string, start string, end string, relation string"))

    def load(self, rows: DataFrame) -> None:
        """Puts a DataFrame of (key, value) in, each key once. It is sorted once; each shard then reads its own range of files."""
        ordered = rows.where("key IS NOT NULL").select("key", "value", F.lit(False).alias("_dead"))
        ordered = cut_lineage(ordered.repartitionByRange("key").sortWithinPartitions("key"))
        for s in self.manifest.shards:
            self.store.append(self.relation[s.id], range_scan(ordered, "key", s.start, s.end))

    def put_all(self, changes: list[tuple[str, str | None]]) -> None:
        """Writes pairs in order, a value of None deleting its key: one part for each shard."""
        parts: dict[str, dict[str, str | None]] = {}
        for key, value in changes:
            parts.setdefault(self.manifest.find(key).id, {})[key] = value
        for shard, own in parts.items():
            rows = [(k, v, v is None) for k, v in own.items()]
            self.store.append(self.relation[shard], self.spark.createDataFrame(rows, "key string, value string, _dead boolean"))

    def put(self, key: str, value: str) -> None:
        self.put_all([(key, value)])

    def delete(self, key: str) -> None:
        self.put_all([(key, None)])

    def get(self, key: str) -> str | None:
        row = self.store.read(self.relation[self.manifest.find(key).id]).where(F.col("key") == key).first()
        return row.value if row else None

    def get_all(self, keys: DataFrame) -> DataFrame:
        """(key, value) of those of a DataFrame's keys that are there."""
        return self.scan().join(keys.select("key").distinct(), "key", "left_semi").select("key", "value")

    def scan(self, start: str = "", end: str = "") -> DataFrame:
        """(key, value, shard) of the live keys in [start, end), an empty end being open; only shards that it meets are read."""
        out = None
        for s in self.manifest.prune(start, end):
            part = range_scan(self.store.read(self.relation[s.id]), "key", start, end).withColumn("shard", F.lit(s.id))
            out = part if out is None else out.unionByName(part)
        return out

    def status(self) -> DataFrame:
        """Every shard with its range and number of live keys."""
        counts = self.scan().groupBy("shard").agg(F.count("*").alias("n_keys"))
        return self.manifest.frame(self.spark).join(counts, "shard", "left").withColumn("n_keys", F.coalesce("n_keys", F.lit(0)).cast("bigint"))

    def split(self, shard_id: str, key: str) -> None:
        """Cuts a shard at key; keys below stay in it, the others get a shard of a new id."""
        cut = self.manifest.split(shard_id, key)
        rows, names = self.store.read(self.relation[shard_id]), dict(self.relation)
        for s in cut.shards:
            if s.id == shard_id or s.id not in self.relation:
                names[s.id] = self._made(s, range_scan(rows, "key", s.start, s.end))
        self.manifest, self.relation = cut, names
        self._save()

    def rebalance(self, threshold: int) -> int:
        """One pass over all shards; how many of them split."""
        now, splits = rebalance(self.scan().select("key"), "key", self.manifest, threshold)
        old = {s.id for s in self.manifest.shards}
        for s in now.shards:
            if s.id not in old:
                self.split(self.manifest.find(s.start).id, s.start)
        return splits


def rebalance_all(df: DataFrame, key: str, manifest: Manifest, threshold: int, passes: int = 64) -> Manifest:
    """Passes until nothing splits."""
    for _ in range(passes):
        manifest, splits = rebalance(df, key, manifest, threshold)
        if not splits:
            break
    return manifest
