import pytest
from pyspark.sql import functions as F

from keystrata.operators import dml, scan, upsert


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([(i, f"n{i:02d}", None if i == 3 else i % 4) for i in range(1, 21)], "id long, name string, age long")


def test_key_ranges_by_bytes_and_by_number(t, rows):
    assert rows(scan.pk_range_lex(t, "id", 1, 10), "id") == [(1,), (10,)]
    assert rows(scan.pk_range_lex(t, "id", 2, 10)) == []
    assert len(rows(scan.pk_range_num(t, "id", 1, 10))) == 10
    assert rows(scan.pk_range_lex(t.withColumn("k", F.col("id").cast("string")), "id", 1, 10, key_text="k"), "id") == [(1,), (10,)]


def test_equality_of_string_forms(spark, t, rows):
    assert rows(scan.filter_eq(t, "id", "7"), "id") == [(7,)]
    assert rows(scan.filter_eq(t, "id", "07"), "id") == []
    s = spark.createDataFrame([("1",), ("01",), (None,)], "v string")
    assert rows(scan.filter_eq(s, "v", 1)) == [("1",)]
    assert rows(scan.filter_eq(s, "v", "<nil>")) == []
    assert rows(scan.filter_eq(s, "v", "<nil>", nil=True)) == [(None,)]


def test_between_beside_the_key(t, rows):
    assert {r[0] for r in rows(scan.filter_between(t, "age", 1, 2), "age")} == {1, 2}
    assert len(rows(scan.filter_between(t, "age", "0", "9"))) == 19  # the null is out
    assert len(rows(scan.filter_between(t, "name", "n02", "n04"))) == 3


def test_filters_reach_the_scan(spark, t, tmp_path):
    t.write.parquet(f"{tmp_path}/t")
    plan = lambda df: df._jdf.queryExecution().toString()
    stored = spark.read.parquet(f"{tmp_path}/t")
    assert "EqualTo(id,7)" in plan(scan.point_get(stored, "id", 7))
    assert "GreaterThanOrEqual(id,1)" in plan(scan.pk_range_num(stored, "id", 1, 10))
    assert "ReadSchema: struct<name:string>" in plan(scan.project(stored, ["name"]))


def test_rank_and_place_in_key_order(spark, t):
    expected = sorted(str(i) for i in range(1, 21))
    ranked = {r.id: r.key_rank for r in scan.key_rank(t, "id").collect()}
    assert [str(i) for i in sorted(ranked, key=ranked.get)] == expected
    assert [scan.nth_key(t, "id", n) for n in (0, 10, 19, 20)] == [expected[0], expected[10], expected[19], None]
    assert scan.key_rank(t.limit(0), "id").count() == 0
    assert scan.nth_key(t.limit(0), "id", 0) is None


def test_bins_of_hot_keys(spark, monkeypatch):
    """Many bins of few rows, a third of which hold one key; nulls come first."""
    monkeypatch.setattr(scan, "BIN_ROWS", 25)
    keys = [None if i % 41 == 0 else 777 if i % 3 == 0 else i * 37 % 1000 for i in range(900)]
    df = spark.createDataFrame([(k,) for k in keys], "id long").repartition(5)
    binned, counts = scan._binned(df, F.col("id").cast("string"))
    sizes = {r["_bin"]: r["_rows"] for r in counts.collect()}
    assert len(sizes) > 12 and sorted(sizes.values())[-2] < 160
    got = [(r.key_rank, r.id) for r in scan.key_rank(df, "id").collect()]
    assert [k for _, k in sorted(got)] == sorted(keys, key=lambda k: (k is not None, str(k))) and [n for n, _ in sorted(got)] == list(range(1, 901))
    there = sorted(str(k) for k in keys if k is not None)
    assert [scan.nth_key(df, "id", n) for n in (0, 400, len(there) - 1, len(there))] == [there[0], there[400], there[-1], None]


def test_unknown_columns(t, spark, rows):
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        scan.project(t, ["nope"]).collect()
    raw = spark.createDataFrame([({"a": "1"},)], "raw map<string,string>")
    assert rows(scan.project_raw(raw, ["a", "b"])) == [("1", None)]


LOG = [("x", 1, "old", False), ("y", 2, "b", False), ("x", 3, "mid", False), ("x", 4, "new", False), ("z", 5, "c", False), ("y", 6, None, True), ("w", 7, None, True)]


def test_newest_wins_and_tombstones(spark, rows):
    log = spark.createDataFrame(LOG, "key string, seq long, value string, tombstone boolean")
    assert rows(upsert.newest_wins(log, ["key"], ["seq"], "tombstone"), "key", "value") == [("x", "new"), ("z", "c")]
    assert rows(upsert.newest_wins(log, ["key"], ["seq"], "tombstone", deleted=True), "key") == [("w",), ("y",)]
    assert upsert.newest_wins(log.limit(0), ["key"], ["seq"], "tombstone").count() == 0


def test_levels_and_compaction(spark, rows):
    schema = "key string, seq long, value string, tombstone boolean, table_id string"
    memory = spark.createDataFrame([("a", 1, None, True, "m")], schema)
    l0 = spark.createDataFrame([("a", 9, "l0", False, "q"), ("b", 9, "l0", False, "q"), ("c", 8, None, True, "q")], schema)
    l1 = spark.createDataFrame([("b", 99, "l1", False, "t1"), ("c", 99, "l1", False, "t1"), ("x", 1, None, True, "t2")], schema)
    # A level's place decides, not its sequence numbers.
    assert rows(upsert.merge_levels([memory, l0, l1], ["key"], ["seq"]), "key", "value") == [("b", "l0")]
    merged = upsert.compact(l0, l1)
    assert rows(merged, "table_id", "key") == [("run", "a"), ("run", "b"), ("t2", "x")]
    assert rows(upsert.compact(l0.limit(0), l1), "table_id") == [("t1",), ("t1",), ("t2",)]


def test_upsert_replaces_whole_rows(t, spark, rows):
    new = spark.createDataFrame([(1, "one"), (99, "new")], "id long, name string")
    out = dml.upsert(t, new, "id")
    assert rows(out.where("id IN (1, 99)")) == [(1, "one", None), (99, "new", None)]
    assert out.count() == 21


def test_update_and_delete_keep_rows_whose_predicate_is_null(t, rows):
    assert dml.delete(t, F.col("age") == 1).where("id = 3").count() == 1
    assert dml.delete(t).count() == 0
    changed = dml.update(t, {"name": F.lit("z")}, F.col("age") == 1, "id")
    assert changed.where("name = 'z'").count() == 5
    assert rows(dml.affected(t, F.col("age") == 1)) == [(5,)]
    with pytest.raises(ValueError, match="primary key"):
        dml.update(t, {"id": F.lit(1)}, None, "id")
    with pytest.raises(ValueError, match="unknown"):
        dml.update(t, {"nope": F.lit(1)})
