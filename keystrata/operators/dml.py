"""Insert, update and delete as rewrites: the inputs stay, the result is the table's next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.operators.upsert import newest


def upsert(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """base with rows put in: a row replaces the one of its key as a whole, columns it lacks being null."""
    missing = [F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns if c not in rows.columns]
    new = rows.select("*", *missing).select(*base.columns)
    tagged = base.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return newest(tagged, [key], ["_new"]).drop("_new")


def matches(predicate: Column | None) -> Column:
    """A predicate that nulls don't satisfy, as a never-null condition."""
    return F.lit(True) if predicate is None else F.coalesce(predicate, F.lit(False))


def update(df: DataFrame, assign: dict[str, Column], predicate: Column | None = None, key: str | None = None) -> DataFrame:
    """df with the assignments made where the predicate holds; the key can't be assigned, nor a column that isn't there."""
    for c in assign:
        if c not in df.columns:
            raise ValueError(f"unknown column {c}")
        if c == key:
            raise ValueError(f"cannot assign primary key {c}")
    hit = matches(predicate)
    return df.withColumns({c: F.when(hit, v.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in assign.items()})


def delete(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """df without the rows that satisfy the predicate; rows for which it is null stay."""
    return df.where(~matches(predicate))


def affected(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """One row: how many rows a predicate selects."""
    return df.agg(F.count(F.when(matches(predicate), 1)).alias("rows_affected"))
