"""Scans, predicates and projections of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.values import column_between, column_equals

#: Bins into which keys are split for ranks, so that no task orders them all, and rows of the sample for each.
MOST_BINS, BIN_ROWS, SAMPLE = 1024, 100_000, 64


def project(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The named columns, all by default; an unknown name is an error."""
    return df if columns is None else df.select(*columns)


def project_raw(df: DataFrame, columns: list[str], raw: str = "raw") -> DataFrame:
    """Fields of a map column of stored values as strings; an unknown name gives nulls."""
    return df.select(*(F.try_element_at(F.col(raw), F.lit(c)).alias(c) for c in columns))


def point_get(df: DataFrame, key: str, value: int | str) -> DataFrame:
    return df.where(column_equals(df, key, value))


def pk_range_num(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Keys from low to high as numbers; reaches the scan as a filter."""
    return df.where(F.col(key).between(low, high))


def pk_range_lex(df: DataFrame, key: str, low: int | str, high: int | str, key_text: str | None = None) -> DataFrame:
    """Keys from low to high by the bytes of their decimal form: of 1 to 20, between 1 and 10 are 1 and 10.

    ``key_text`` names a stored column of that form, through which the bounds reach the scan.
    """
    return df.where((F.col(key_text) if key_text else F.col(key).cast("string")).between(str(low), str(high)))


def filter_eq(df: DataFrame, column: str, value: int | str, nil: bool = False) -> DataFrame:
    return df.where(column_equals(df, column, value, nil))


def filter_between(df: DataFrame, column: str, low: int | str, high: int | str, nil: bool = False) -> DataFrame:
    return df.where(column_between(df, column, low, high, nil))


def in_key_order(df: DataFrame, key: str) -> DataFrame:
    """Rows in byte order of the key's string form, sorted over ranges."""
    return df.orderBy(F.col(key).cast("string"))


def _binned(df: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_bin`` by ascending bounds, and the rows in each bin.

    Bounds are quantiles of a sample of rows, so that a key of many rows is a bin of its own; it has SAMPLE rows for each
    bin, and there is a bin for each BIN_ROWS rows, MOST_BINS at most. Ranks are exact whatever the sample.
    """
    rows = df.count()
    bins = min(MOST_BINS, max(1, -(-rows // BIN_ROWS)))
    bounds = []
    if bins > 1:
        share = min(1.0, bins * SAMPLE / rows)
        sample = df.select(key.alias("k")).where("k IS NOT NULL")
        keys = sorted(r.k for r in (sample.sample(share, seed=7) if share < 1 else sample).collect())
        bounds = sorted({keys[len(keys) * i // bins] for i in range(1, bins)}) if keys else []
    binned = df.withColumn("_bin", _bin_of(key, bounds, 0))
    return binned, binned.groupBy("_bin").agg(F.count("*").alias("_rows"))


def _bin_of(key: Column, bounds: list, first: int) -> Column:
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(key >= F.lit(bounds[mid]), _bin_of(key, bounds[mid + 1 :], first + mid + 1)).otherwise(_bin_of(key, bounds[:mid], first))


def key_rank(df: DataFrame, key: str, name: str = "key_rank") -> DataFrame:
    """Appends each row's place (from 1) in byte order of the key's string form; equal keys in no given order."""
    text = F.col(key).cast("string")
    binned, counts = _binned(df, text)
    before = counts.withColumn("_before", F.sum("_rows").over(Window.orderBy("_bin")) - F.col("_rows")).drop("_rows")
    within = binned.withColumn("_within", F.row_number().over(Window.partitionBy("_bin").orderBy(text)))
    return within.join(F.broadcast(before), "_bin").withColumn(name, (F.col("_before") + F.col("_within")).cast("bigint")).drop("_bin", "_before", "_within")


def nth_keys(df: DataFrame, key: str, by: str, places: dict[str, int]) -> dict[str, str]:
    """For each of some groups the key at a place (from 0) in byte order, exactly; of each only one bin of keys is ordered."""
    text = F.col(key).cast("string")
    binned, _ = _binned(df.where(text.isNotNull()).select(text.alias("_k"), F.col(by).alias("_by")), F.col("_k"))
    counts = {}
    for r in binned.groupBy("_by", "_bin").agg(F.count("*").alias("n")).orderBy("_by", "_bin").collect():
        counts.setdefault(r["_by"], []).append((r["_bin"], r["n"]))
    picks = []
    for group, place in places.items():
        for b, n in counts.get(group, ()):
            if place < n:
                picks.append((group, b, place + 1))
                break
            place -= n
    if not picks:
        return {}
    wanted = df.sparkSession.createDataFrame(picks, "_by string, _bin int, _nth int")
    near = binned.join(F.broadcast(wanted), ["_by", "_bin"]).withColumn("_at", F.row_number().over(Window.partitionBy("_by").orderBy("_k")))
    return {r["_by"]: r["_k"] for r in near.where("_at = _nth").select("_by", "_k").collect()}


def nth_key(df: DataFrame, key: str, n: int) -> str | None:
    """The key at place n (from 0) in byte order, or None past the end."""
    return nth_keys(df.withColumn("_all", F.lit("")), key, "_all", {"": n}).get("")
