import pytest
from pyspark.sql import functions as F

from keystrata.operators import mvcc, replication, schema, sharding, twopc
from keystrata.operators.sharding import Manifest, Router, Shard
from keystrata.sources.keyed import KeyedTable
from keystrata.sources.store import Conflict, Store

V = "key string, commit_ts long, value string, tombstone boolean"


@pytest.fixture(scope="module")
def versions(spark):
    return spark.createDataFrame([("k", 10, "a", False), ("k", 20, "b", False), ("k", 30, None, True), ("j", 25, "c", False)], V)


def test_snapshots(versions, rows):
    at = lambda ts: rows(mvcc.snapshot_at(versions, ts), "key", "value")
    assert [at(5), at(10), at(29), at(30)] == [[], [("k", "a")], [("j", "c"), ("k", "b")], [("j", "c")]]
    assert rows(mvcc.last_commit(versions.select("key").distinct().union(versions.sparkSession.createDataFrame([("n",)], "key string")), versions)) == [("j", 25), ("k", 30), ("n", 0)]
    assert rows(mvcc.written_between(versions.select("key").distinct(), versions, 25, 30)) == [("k",)]


def test_repeated_log_entries_first_wins(spark, rows):
    log = spark.createDataFrame([("k", 10, "a", False, 1), ("k", 10, "other", False, 2)], V + ", log_index long")
    assert rows(mvcc.apply_commits(log), "value") == [("a",)]


def test_commits_explode(spark, rows):
    log = spark.createDataFrame([(1, 10, [("a", "x", False), ("b", None, True)])], "log_index long, commit_ts long, writes array<struct<key:string,value:string,tombstone:boolean>>")
    assert rows(mvcc.explode_commits(log), "key", "tombstone") == [("a", False), ("b", True)]


def test_transactions_snapshot_conflict_and_absent_reads(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/txns")
    m = mvcc.Transactions(store)
    a = m.begin()
    a.put("k", "1")
    assert a.get("k") == "1"
    assert m.commit(a)[0]
    one, two = m.begin(), m.begin()
    assert one.get("k") == two.get("k") == "1"
    one.put("k", "2")
    two.put("k", "3")
    assert m.commit(one)[0] and not m.commit(two)[0]
    reader, writer = m.begin(), m.begin()
    assert reader.get("absent") is None
    writer.put("absent", "x")
    assert m.commit(writer)[0]
    reader.put("other", "y")
    assert not m.commit(reader)[0]
    last = m.begin()
    assert last.get("k") == "2"
    last.delete("k")
    assert last.get("k") is None
    assert m.commit(last)[0] and m.begin().get("k") is None
    with pytest.raises(ValueError, match="finished"):
        last.put("k", "z")
    again, other = mvcc.Transactions(store, clock=mvcc.Clock(lambda: 1)), mvcc.Transactions(store)
    a, b = again.begin(), other.begin()
    assert a.read_ts > 1 << 20 and a.get("absent") == b.get("absent") == "x"  # a late clock follows the commits
    a.put("absent", "1")
    b.put("absent", "2")
    assert again.commit(a)[0] and not other.commit(b)[0]


def test_stamps_never_repeat(spark):
    """More rows in a millisecond than its counter holds, twice, with rows in the ones that follow and in later spans."""
    per = {1: 70_000, 2: 3, 3: 65_536, 4: 1, 70_000: 2, 2_000_000: 66_000, 2_000_001: 1}
    df = spark.createDataFrame([(ms, n) for ms, n in per.items()], "ms long, n int").selectExpr("ms", "explode(sequence(1, n)) AS i").repartition(5)
    got = [(r.hlc, r.ms, r.i) for r in mvcc.hlc_stamp(df, F.col("ms"), "i").collect()]
    want, free = [], 0
    for ms, n in sorted(per.items()):
        free = max(free, ms << 16)
        want += [(free + i, ms, i + 1) for i in range(n)]
        free += n
    assert sorted(got) == want


def test_long_transactions_are_validated(spark, rows):
    txns = spark.createDataFrame([("a", "k", 0, 300), ("b", "k", 160, 300), ("c", "k", 300, 300)], "txn_id string, key string, read_ts long, commit_ts long")
    held = spark.createDataFrame([("k", 150), ("k", 300), ("j", 200)], "key string, commit_ts long")
    assert rows(mvcc.validate_history(txns, held, 50), "txn_id", "conflict") == [("a", True), ("b", False), ("c", False)]


def test_fold_accepts_after_an_abort(spark, rows):
    txn = lambda i, read, at, reads, writes: {"txn_id": i, "read_ts": read, "commit_ts": at, "reads": reads, "writes": writes}
    txns = [txn("a", 0, 10, [], ["k"]), txn("b", 5, 20, ["k"], ["j"]), txn("c", 15, 30, ["j"], ["j"]), txn("d", 0, 40, ["k"], [])]
    got = {r["txn_id"]: r["committed"] for r in mvcc.fold_transactions(txns)}
    assert got == {"a": True, "b": False, "c": True, "d": True}
    df = spark.createDataFrame([(t["txn_id"], t["read_ts"], t["commit_ts"], t["reads"], t["writes"], 0) for t in txns], "txn_id string, read_ts long, commit_ts long, reads array<string>, writes array<string>, group_id int")
    assert {r.txn_id: r.committed for r in mvcc.fold_by_group(df).collect()} == got


def test_fifty_writers_of_one_key_lose_no_update():
    txns = [{"txn_id": f"{i:02d}", "read_ts": i // 2, "commit_ts": i + 1, "reads": ["k"], "writes": ["k"]} for i in range(50)]
    out = mvcc.fold_transactions(txns)
    done = [t for t in out if t["committed"]]
    assert len(out) == 50 and done
    last = 0
    for t in done:
        assert txns[int(t["txn_id"])]["read_ts"] >= last
        last = t["commit_ts"]


def test_clock_never_repeats():
    clock = mvcc.Clock(lambda: 7)
    seen = [clock.now() for _ in range(70_000)]
    assert len(set(seen)) == len(seen) and seen == sorted(seen)
    assert clock.update(1 << 40) > 1 << 40


def test_schema_chain(spark, rows):
    c = schema.Catalog()
    c.create("t", [("id", "INT"), ("name", "STRING")], 100)
    c.add_column("t", "note", "STRING", "none", 200)
    c.drop_column("t", "name", 300)
    at = lambda ts: [r.column_name for r in schema.active_at(c.frame(spark), ts).orderBy("pos").collect()]
    assert [at(50), at(100), at(250), at(300)] == [[], ["id", "name"], ["id", "name", "note"], ["id", "note"]]
    raw = spark.createDataFrame([({"id": "1", "name": "x"},)], "raw map<string,string>")
    columns = [x[:3] for x in c.columns("t", 250)]
    assert rows(schema.materialize(raw, columns)) == [(1, "x", "none")]
    assert rows(schema.materialize(raw, columns, defaults=False)) == [(1, "x", None)]
    for bad in (lambda: c.create("t", [("id", "INT")], 1), lambda: c.add_column("t", "note", "INT", None, 400), lambda: c.drop_column("t", "name", 400), lambda: c.add_column("u", "a", "INT", None, 1)):
        with pytest.raises(ValueError):
            bad()


def test_manifest():
    m = Manifest().split("s0", "m")
    assert [m.find(k).id for k in ("", "a", "m", "z")] == ["s0", "s0", "s1", "s1"]
    assert [s.id for s in m.prune("a", "b")] == ["s0"] and [s.id for s in m.prune("l", "n")] == ["s0", "s1"]
    for shard, key in (("s0", ""), ("s0", "m"), ("s1", "a"), ("s9", "a")):
        with pytest.raises(ValueError):
            m.split(shard, key)
    with pytest.raises(ValueError):
        Manifest([Shard("a", "", "k"), Shard("b", "m", "")])


def test_rebalance_until_small(spark):
    df = spark.createDataFrame([(f"k-{i:04d}",) for i in range(200)], "key string")
    m = sharding.rebalance_all(df, "key", Manifest(), 50)
    counts = [r.n_keys for r in sharding.status(df, "key", m).collect()]
    assert len(counts) >= 4 and max(counts) <= 50 and sum(counts) == 200
    half = sharding.rebalance(df.limit(100), "key", Manifest(), 60)[0]
    assert [r.n_keys for r in sharding.status(df.limit(100), "key", half).collect()] == [50, 50]
    many = Manifest([Shard(f"s{i}", "" if i == 0 else f"k-{i:04d}", f"k-{i + 1:04d}" if i < 199 else "") for i in range(200)])
    sharding.MANY, saved = 10, sharding.MANY
    try:
        assert sharding.assign(df, "key", many).groupBy("shard").count().where("count > 1").count() <= 1
    finally:
        sharding.MANY = saved


OPS = "array<struct<kind:string,key:string,value:string>>"


def test_two_phase_commit_recovery(spark, rows):
    ops = lambda a, z: [("put", "alice", a), ("put", "zoe", z)]
    txns = spark.createDataFrame([("t1", ops("40", "60"))], f"txn_id string, ops {OPS}")
    owner = sharding.owner(F.col("key"), Manifest([Shard("s0", "", "m"), Shard("s1", "m", "")]))
    grouped = twopc.group_by_shard(txns, owner)
    assert rows(grouped.select("shard", F.col("ops")[0]["key"].alias("key"))) == [("s0", "alice"), ("s1", "zoe")]
    prepares = grouped.select("shard", F.lit(1).alias("seq"), "txn_id", F.lit(5).cast("long").alias("commit_ts"), "ops", F.lit("prepared").alias("phase"))
    base = spark.createDataFrame([("alice", "100"), ("zoe", "0")], "key string, value string")
    decided = spark.createDataFrame([(1, "t1", "commit")], "seq long, txn_id string, outcome string")
    committed = twopc.recover(prepares, decided)
    assert rows(twopc.recovered_counts(committed)) == [("commit", 2)]
    assert rows(twopc.apply_ops(base, committed)) == [("alice", "40"), ("zoe", "60")]
    lost = twopc.recover(prepares, decided.limit(0))
    assert rows(lost, "outcome") == [("abort",), ("abort",)]
    assert rows(twopc.apply_ops(base, lost)) == [("alice", "100"), ("zoe", "0")]
    done = prepares.unionByName(prepares.withColumn("seq", F.lit(2)).withColumn("phase", F.lit("applied")))
    assert twopc.pending(done).count() == 0
    assert twopc.outcome(decided, "t1") == "commit" and twopc.outcome(decided, "t2") == ""
    with pytest.raises(ValueError, match="unknown op"):
        twopc.check_ops([("swap", "a", "b")])


def test_replicated_log(spark, rows):
    log = spark.range(1, 11).select(F.col("id").alias("index"), F.expr("CASE WHEN id < 6 THEN 1 ELSE 2 END").alias("term"))
    match = lambda *m: spark.createDataFrame([(i, x) for i, x in enumerate(m)], "node long, match_index long")
    got = [replication.commit_index(match(*m), log, 2).first()[0] for m in ((10, 8, 3), (10, 4, 3), (7, 7, 7))]
    assert got == [8, 0, 7]
    mine = log.where("index <= 8")
    entries = spark.createDataFrame([(7, 3), (8, 3), (9, 3)], "index long, term int")
    assert replication.reconcile(mine, entries, 20, 2) is None
    assert rows(replication.reconcile(mine, entries, 6, 2))[-3:] == [(7, 3), (8, 3), (9, 3)]
    assert replication.reconcile(mine, entries.limit(0), 6, 2).count() == 8


def test_long_transactions_meet_the_windows_between(spark, rows):
    txns = spark.createDataFrame([("long", "k", 0, 100), ("clear", "j", 0, 100), ("empty", "k", 45, 45), ("edges", "k", 45, 46)], "txn_id string, key string, read_ts long, commit_ts long")
    versions = spark.createDataFrame([("k", 45), ("j", 100), ("j", 0)], "key string, commit_ts long")
    assert rows(mvcc.validate_history(txns, versions, 10), "txn_id", "conflict") == [("clear", False), ("edges", False), ("empty", False), ("long", True)]


def test_commit_abort_and_recovery_over_shards(spark, rows, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    router = Router(store, Manifest([Shard("s0", "", "m"), Shard("s1", "m", "")]))
    router.put_all([("alice", "100"), ("zoe", "0")])
    c = twopc.Coordinator(router)
    done = c.commit([("put", "alice", "40"), ("put", "zoe", "60")])
    assert c.outcome(done) == "commit" and rows(c.lookup(done), "shard", "phase") == [("s0", "applied"), ("s1", "applied")]
    assert (router.get("alice"), router.get("zoe")) == ("40", "60")
    with pytest.raises(ValueError, match="unknown op"):
        c.prepare([("put", "alice", "1"), ("grow", "zoe", "2")])
    with pytest.raises(twopc.Crash) as lost:
        c.commit([("put", "alice", "1"), ("delete", "zoe", None)], crash_after="prepare")
    with pytest.raises(twopc.Crash) as decided:
        c.commit([("put", "alice", "7"), ("put", "zed", "8")], crash_after="decision")
    held = c.prepare([("put", "bob", "5")])
    c.abort(held)
    assert rows(c.lookup(held), "phase") == [("aborted",)]
    with pytest.raises(ValueError, match="committed"):
        c.abort(done)
    assert (router.get("alice"), router.get("zed")) == ("40", None) and c.pending().count() == 4
    router.split("s1", "zf")  # recovery routes by the keys' owners of then
    again = twopc.Coordinator(Router(Store(spark, f"file://{tmp_path}/db")))
    assert again.recover() == {"commit": 1, "abort": 1} and again.pending().count() == 0
    assert rows(again.router.scan()) == [("alice", "7", "s0"), ("zed", "8", "s1"), ("zoe", "60", "s2")]
    assert (again.outcome(str(lost.value)), again.outcome(str(decided.value)), again.outcome("none")) == ("abort", "commit", "")
    assert again.recover() == {"commit": 0, "abort": 0}


def test_routed_access_splits_and_reopening(spark, rows, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db", trigger=3)
    router = Router(store)
    router.load(spark.createDataFrame([(f"key-{i:03d}", f"v{i}") for i in range(100)], "key string, value string"))
    router.split("s0", "key-050")
    assert rows(router.status(), "shard", "n_keys") == [("s0", 50), ("s1", 50)]
    router.put("key-049x", "new")
    router.delete("key-050")
    again = Router(store)
    assert (again.get("key-049x"), again.get("key-050"), again.get("key-099")) == ("new", None, "v99")
    assert rows(again.scan("key-048", "key-052"), "key", "shard") == [("key-048", "s0"), ("key-049", "s0"), ("key-049x", "s0"), ("key-051", "s1")]
    assert rows(again.get_all(spark.createDataFrame([("key-001",), ("nope",), ("key-001",)], "key string")), "key") == [("key-001",)]
    while again.rebalance(30):
        pass
    assert again.status().agg(F.max("n_keys"), F.sum("n_keys")).first()[:] == (25, 100) or again.status().agg(F.max("n_keys")).first()[0] <= 30
    assert rows(Router(store).scan(), "key") == rows(router.scan(), "key")
    with pytest.raises(ValueError):
        again.split("s0", "zzz")


def test_buffered_writes_flush_merge_and_replay(spark, rows, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db", trigger=3)
    t = KeyedTable(store, "t", flush_bytes=40)
    want = {}
    for i in range(14):
        batch = [(f"k{(i * 5 + j) % 17}", None if (i + j) % 6 == 5 else f"v{i}.{j}") for j in range(3)]
        t.put_all(batch)
        want.update(batch)
    live = sorted((k, v) for k, v in want.items() if v is not None)
    assert rows(t.scan()) == live and max(store.stats("t")) >= 1 and len(store.stats("t")) < 7
    t.put("late", "1")
    assert t.buffer and rows(KeyedTable(store, "t").scan()) == sorted([*live, ("late", "1")])  # replayed
    t.delete("late")
    t.close()
    again = KeyedTable(Store(spark, f"file://{tmp_path}/db"), "t")
    assert not again.buffer and again.get("late") is None and rows(again.scan()) == live and again.get(live[0][0]) == live[0][1]


def test_writers_that_start_from_one_version(spark, rows, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    store.write("t", df)
    store.append("t", df, after=1)
    with pytest.raises(Conflict):
        store.append("t", df, after=1)
    folder = store._folder("t")
    folder.create("commit-00000003.json", '{"versi')  # a writer that died: the version before holds, its number isn't used again
    assert store.version("t") == 2 and store.append("t", df) == 4 and len(rows(store.read("t"))) == 3
    with pytest.raises(Conflict):
        folder.create("commit-00000004.json", "{}")


def test_log_is_cut_and_recovered(spark, rows, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    put = lambda k, v: f'{{"kind":"set","key":"{k}","value":"{v}"}}'
    log = replication.ReplicatedLog(store)
    assert log.propose([put("a", 1), put("b", 2), '{"kind":"delete","key":"a"}', "{torn"], 1) == 4
    assert log.apply(2) == 2 and rows(log.live(), "key", "value") == [("a", "1"), ("b", "2")]
    assert log.truncate() == 2 and rows(log.entries(), "index") == [(3,), (4,)]
    again = replication.ReplicatedLog(Store(spark, f"file://{tmp_path}/db"))
    assert again.propose([put("c", 3)], 1) == 5 and again.apply(5) == 5 and again.apply(3) == 5
    assert rows(again.live(), "key", "value") == [("b", "2"), ("c", "3")]
    assert again.truncate() == 5 and again.entries().isEmpty() and again.last_index() == 5
    newer = spark.createDataFrame([(6, 2, put("d", 4)), (7, 2, put("e", 5))], replication.ReplicatedLog.LOG)
    assert again.follow(newer, 5, 1) and not again.follow(newer, 9, 2) and again.apply(7) == 7
    assert rows(again.live(), "key") == [("b",), ("c",), ("d",), ("e",)]
