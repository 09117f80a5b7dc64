"""Relations stored as parts under numbered commits, append logs, backup and restore.

A relation is a list of parts, folders of Parquet that never change. A commit names the parts of one version; it is a
file of its own that is created exclusively, so that a reader never sees half a version, a crash leaves the commit
before, and of two writers that start from the same version one fails. A keyed relation takes changes as small parts of
their own: reading lets the newest row of each key win, and once enough parts of one size have gathered they are merged,
so that a change costs its own size and, over time, a logarithm's worth of merging.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keystrata.operators.upsert import newest

#: Parts of one tier that are merged into one of the next.
TRIGGER = 4
#: The column of a keyed relation that marks deleted keys.
DEAD = "_dead"


class Conflict(RuntimeError):
    """Another writer committed first."""


class Folder:
    """A folder of any filesystem that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(""))) if self.exists() else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Makes a file that must not exist."""
        try:
            stream = self.fs.create(self._path(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"{self.path}/{name} exists") from None
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, name: str, to: str) -> None:
        """Publishes a file under its name in one step."""
        if not self.fs.rename(self._path(name), self._path(to)):
            raise OSError(f"could not publish {to}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Store:
    """Named relations under a root, each with commits 1, 2, ..., of which the newest that can be read holds."""

    def __init__(self, spark: SparkSession, root: str, trigger: int = TRIGGER):
        self.spark, self.root, self.trigger = spark, root.rstrip("/"), trigger

    def _folder(self, name: str) -> Folder:
        if not name or "/" in name or name.startswith((".", "_")):
            raise ValueError(f"bad relation name {name!r}")
        return Folder(self.spark, f"{self.root}/{name}")

    @staticmethod
    def _numbers(folder: Folder) -> list[int]:
        found = (n.removeprefix("commit-").removesuffix(".json") for n in folder.names() if n.startswith("commit-"))
        return sorted(int(n) for n in found if n.isdigit())

    def _record(self, name: str, version: int | None = None) -> dict | None:
        """The commit of a version, by default the newest whole one: a writer may have died over a newer."""
        folder = self._folder(name)
        for n in reversed(self._numbers(folder)):
            if version is None or n == version:
                try:
                    return json.loads(folder.read(f"commit-{n:08d}.json"))
                except ValueError:
                    continue
        return None

    def _commit(self, name: str, before: dict | None, parts: list[dict], key: str | None, at: int) -> int:
        record = {"version": at, "parts": parts, "key": key, "after": before["version"] if before else 0}
        self._folder(name).create(f"commit-{at:08d}.json", json.dumps(record))
        return at

    def _next(self, name: str) -> int:
        return max(self._numbers(self._folder(name)), default=0) + 1

    def _part(self, name: str, df: DataFrame, tier: int, sort_key: str | None, key: str | None) -> dict:
        made = f"part-{uuid.uuid4().hex}"
        out = df.repartitionByRange(sort_key).sortWithinPartitions(sort_key) if sort_key else df
        writer = out.write
        if key:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(f"{self._folder(name).path}/{made}")
        return {"dir": made, "tier": tier, "schema": df.schema.jsonValue()}

    def names(self) -> list[str]:
        return [n for n in Folder(self.spark, self.root).names() if not n.startswith((".", "_")) and self._record(n)]

    def version(self, name: str) -> int:
        """The current version, 0 if there is none."""
        record = self._record(name)
        return record["version"] if record else 0

    def stats(self, name: str) -> list[int]:
        """The tiers of the current parts, oldest first."""
        record = self._record(name)
        return [p["tier"] for p in record["parts"]] if record else []

    def write(self, name: str, df: DataFrame, sort_key: str | None = None, key: str | None = None) -> int:
        """Makes df the whole relation. With sort_key, by ranges of it, so that files have narrow key ranges to skip by.

        With ``key`` the relation takes keyed changes; the key gets a bloom filter in its files.
        """
        at, before = self._next(name), self._record(name)
        return self._commit(name, before, [self._part(name, df, 0, sort_key, key)], key, at)

    def append(self, name: str, df: DataFrame, after: int | None = None) -> int:
        """Adds a part, with ``after`` only if that is still the current version. In a keyed relation its rows replace those of their keys, or delete them where ``DEAD`` is true.

        A key must not occur twice in df. Columns that other parts lack are null there, and the other way round.
        """
        at, before = self._next(name), self._record(name)
        if before is None:
            raise ValueError(f"no relation {name}")
        if after is not None and (before["version"] != after or at != after + 1):
            raise Conflict(f"{name} is at {before['version']}, not {after}")
        parts, key = [*before["parts"], self._part(name, df, 0, None, before["key"])], before["key"]
        at = self._commit(name, before, parts, key, at)
        same = len(parts)
        while same and parts[same - 1]["tier"] == parts[-1]["tier"] and (same > 1 or not key):
            same -= 1
        return self.compact(name, same) if len(parts) - same >= self.trigger else at

    def compact(self, name: str, first: int = 0) -> int:
        """Merges the parts from ``first`` on into one of the next tier; deleted keys go once the oldest part is among them."""
        at, before = self._next(name), self._record(name)
        old, merged = before["parts"][:first], before["parts"][first:]
        if len(merged) < 2:
            return before["version"]
        rows = self._merged(name, merged, before["key"], keep=bool(old))
        tier = max(p["tier"] for p in merged) + 1
        return self._commit(name, before, [*old, self._part(name, rows, tier, None, before["key"])], before["key"], at)

    def _merged(self, name: str, parts: list[dict], key: str | None, keep: bool = False) -> DataFrame:
        out, path = None, self._folder(name).path
        for i, p in enumerate(parts):
            rows = self.spark.read.schema(StructType.fromJson(p["schema"])).parquet(f"{path}/{p['dir']}")
            rows = rows.withColumn("_part", F.lit(i)) if key and len(parts) > 1 else rows
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if key and len(parts) > 1:
            out = newest(out, [key], ["_part"]).drop("_part")
        if key and DEAD in out.columns and not keep:
            out = out.where(~F.coalesce(F.col(DEAD), F.lit(False))).drop(DEAD)
        return out

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The relation at a version, by default the current one. Filters by key reach the files of every part."""
        record = self._record(name, version)
        if record is None:
            raise ValueError(f"no relation {name}" + (f" at version {version}" if version else ""))
        return self._merged(name, record["parts"], record["key"])

    def vacuum(self, name: str, keep: int = 1) -> None:
        """Deletes all but the newest ``keep`` versions, and parts that none of these holds."""
        folder = self._folder(name)
        numbers = [n for n in self._numbers(folder) if n <= self.version(name)]
        stay = {p["dir"] for n in numbers[-keep:] for p in (self._record(name, n) or {"parts": []})["parts"]}
        for n in numbers[:-keep]:
            folder.delete(f"commit-{n:08d}.json")
        for n in folder.names():
            if n.startswith("part-") and n not in stay:
                folder.delete(n)

    def backup(self, target: str) -> list[str]:
        """Copies every relation's current version to a target that must not exist; the manifest comes last."""
        if Folder(self.spark, target).exists():
            raise FileExistsError(target)
        found, names = {}, self.names()
        for n in names:
            now = self.read(n)
            now.write.mode("errorifexists").parquet(f"{target.rstrip('/')}/{n}")
            found[n] = {"schema": now.schema.jsonValue(), "key": self._record(n)["key"]}
        Folder(self.spark, target).create("MANIFEST", json.dumps({"relations": found}))
        return names

    @classmethod
    def restore(cls, spark: SparkSession, source: str, root: str) -> Store:
        """A store from a backup; the root must not exist, and names that leave it are refused."""
        if Folder(spark, root).exists():
            raise FileExistsError(root)
        made = cls(spark, root)
        relations = json.loads(Folder(spark, source).read("MANIFEST"))["relations"]
        for n in relations:
            made._folder(n)
        for n, x in relations.items():
            made.write(n, spark.read.schema(StructType.fromJson(x["schema"])).parquet(f"{source.rstrip('/')}/{n}"), key=x["key"])
        return made


_local: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names for checkpoints; in local mode a temporary one if it names none."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if "dir" not in _local:
            _local["dir"] = "file://" + tempfile.mkdtemp(prefix="keystrata-")
        root = _local["dir"]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a table in the session's shared checkpoint folder."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reads JSON lines. The last line of a file may be torn and is left out; one elsewhere is an error."""
    fields = StructType.fromDDL(schema)
    full = StructType([*fields.fields]).add("_corrupt_record", "string")
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("place")).where("value <> ''")
    parsed = lines.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    torn = parsed.where("r._corrupt_record IS NOT NULL").select("file", "place")
    if not torn.isEmpty():
        last = lines.groupBy("file").agg(F.max("place").alias("last"))
        wrong = torn.join(last, "file").where("place < last").first()
        if wrong:
            raise ValueError(f"corrupt log line inside {wrong.file}")
    return parsed.where("r._corrupt_record IS NULL").select(*(F.col(f"r.`{f.name}`") for f in fields))
