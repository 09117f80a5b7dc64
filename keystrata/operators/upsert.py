"""Newest-wins: the state of a keyed table from a log of its changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], order: list[str], first: bool = False) -> DataFrame:
    """One row per key, the one with the largest (or smallest) order. Partial aggregation reduces each key map-side."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.min_by if first else F.max_by)(F.struct(*rest), F.struct(*order)).alias("_newest")
    return df.groupBy(*keys).agg(pick).select(*keys, *(F.col(f"_newest.`{c}`").alias(c) for c in rest)).select(*df.columns)


def newest_wins(df: DataFrame, keys: list[str], order: list[str], tombstone: Column | str | None = None, deleted: bool = False) -> DataFrame:
    """The newest row of each key that isn't a tombstone (``deleted``: only those that are)."""
    if tombstone is None:
        return newest(df, keys, order)
    flag = F.coalesce(F.col(tombstone) if isinstance(tombstone, str) else tombstone, F.lit(False))
    kept = newest(df.withColumn("_tombstone", flag), keys, order)
    return kept.where(F.col("_tombstone") if deleted else ~F.col("_tombstone")).drop("_tombstone")


def merge_levels(levels: list[DataFrame], keys: list[str], within: list[str], tombstone: str | None = "tombstone", keep_tombstones: bool = False) -> DataFrame:
    """Merges levels, newest first: of equal keys the first level's row holds, in a level the largest ``within``."""
    out = None
    for i, level in enumerate(levels):
        part = level.withColumn("_level", F.lit(-i))
        out = part if out is None else out.unionByName(part)
    order = ["_level", *within]
    merged = newest(out, keys, order) if keep_tombstones or tombstone is None else newest_wins(out, keys, order, tombstone)
    return merged.drop("_level")


def level_stats(df: DataFrame, level: str = "level", table: str = "table_id", key: str = "key") -> DataFrame:
    """Tables, records and distinct keys of each level."""
    return df.groupBy(level).agg(F.countDistinct(table).alias("n_tables"), F.count("*").alias("n_records"), F.countDistinct(key).alias("n_keys"))


def key_ranges(df: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """The smallest and largest key of each table."""
    return df.groupBy(*by).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("n_records"))


def compact(l0: DataFrame, l1: DataFrame, key: str = "key", order: str = "seq", tombstone: str = "tombstone", table: str = "table_id", run: str = "run") -> DataFrame:
    """Merges all of L0 with the L1 tables whose key ranges overlap it into one run without tombstones; others stay."""
    low, high = l0.agg(F.min(key), F.max(key)).first()
    ranges = key_ranges(l1, [table], key)
    hit = ranges.where((F.col("min_key") <= F.lit(high)) & (F.col("max_key") >= F.lit(low))).select(table) if low is not None else ranges.where(F.lit(False)).select(table)
    merged = merge_levels([l0, l1.join(hit, table, "left_semi").select(l0.columns)], [key], [order], tombstone).withColumn(table, F.lit(run))
    return merged.unionByName(l1.join(hit, table, "left_anti").select(l0.columns))
