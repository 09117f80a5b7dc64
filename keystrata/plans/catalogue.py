"""The registered queries over the driver's tables, each with the SQL that gives the same rows.

The change log is ``events``: key user_id, sequence and commit timestamp event_id, an event of type 'error' a tombstone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.operators import dml, mvcc, replication, scan, schema, sharding, twopc, upsert
from keystrata.operators.sharding import Manifest, Router, Shard
from keystrata.plans.dialect import DialectError
from keystrata.plans.engine import Engine
from keystrata.sources.keyed import KeyedTable
from keystrata.sources.store import Store, append_log, read_log, scratch
from keystrata.streaming.apply import LOG, apply_stream, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """The events as (key, commit_ts, value, tombstone)."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("commit_ts"), "value", (F.col("event_type") == "error").alias("tombstone"))


# A newest-wins state in SQL, and the events as versions.
V = "v AS (SELECT user_id AS key, event_id AS commit_ts, value, event_type = 'error' AS tombstone FROM events)"
NEWEST = "SELECT * FROM v WHERE {where} QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) = 1"


# Scans, predicates, projections.


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def full_scan(spark, sf):
    return scan.project(table(spark, sf, "nation"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def project_cols(spark, sf):
    return scan.project(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey = 1000")
def point_get(spark, sf):
    return scan.point_get(table(spark, sf, "orders"), "o_orderkey", 1000).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = -1")
def point_get_miss(spark, sf):
    return scan.point_get(table(spark, sf, "orders"), "o_orderkey", -1).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) BETWEEN '1000' AND '1009'")
def pk_range_lex(spark, sf):
    return scan.pk_range_lex(table(spark, sf, "orders"), "o_orderkey", 1000, 1009).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 1000 AND 1009")
def pk_range_num(spark, sf):
    return scan.pk_range_num(table(spark, sf, "orders"), "o_orderkey", 1000, 1009).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) BETWEEN '2' AND '10'")
def pk_range_empty(spark, sf):
    return scan.pk_range_lex(table(spark, sf, "orders"), "o_orderkey", 2, 10).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq_nonpk(spark, sf):
    return scan.filter_eq(table(spark, sf, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_size FROM part WHERE CAST(p_size AS VARCHAR) = '7'")
def filter_eq_crosstype(spark, sf):
    return scan.filter_eq(table(spark, sf, "part"), "p_size", "7").select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 15")
def filter_between_int(spark, sf):
    return scan.filter_between(table(spark, sf, "part"), "p_size", 5, 15).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand BETWEEN 'Brand#2' AND 'Brand#3'")
def filter_between_str(spark, sf):
    return scan.filter_between(table(spark, sf, "part"), "p_brand", "Brand#2", "Brand#3").select("p_partkey", "p_brand")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) AS key_rank FROM orders")
def scan_in_key_order(spark, sf):
    return scan.key_rank(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(NULL AS VARCHAR) AS missing FROM nation")
def project_raw_fields(spark, sf):
    raw = table(spark, sf, "nation").select(F.create_map(F.lit("n_nationkey"), F.col("n_nationkey").cast("string"), F.lit("n_name"), F.col("n_name")).alias("raw"))
    return scan.project_raw(raw, ["n_nationkey", "n_name", "missing"])


# Newest wins, levels, compaction.


@query(f"WITH {V} SELECT key, commit_ts, value FROM ({NEWEST.format(where='true')}) WHERE NOT tombstone")
def kv_live(spark, sf):
    return upsert.newest_wins(versions(spark, sf), ["key"], ["commit_ts"], "tombstone").select("key", "commit_ts", "value")


@query(f"WITH {V} SELECT count(*) AS n FROM ({NEWEST.format(where='true')}) WHERE NOT tombstone")
def kv_live_count(spark, sf):
    return upsert.newest_wins(versions(spark, sf), ["key"], ["commit_ts"], "tombstone").agg(F.count("*").alias("n"))


@query(f"WITH {V} SELECT key, commit_ts FROM ({NEWEST.format(where='true')}) WHERE tombstone")
def kv_deleted_keys(spark, sf):
    return upsert.newest_wins(versions(spark, sf), ["key"], ["commit_ts"], "tombstone", deleted=True).select("key", "commit_ts")


def levels(spark: SparkSession, sf: str) -> DataFrame:
    """Versions with a level and table: quarters of event_id modulo 10,000, the oldest in L1, the newest in memory."""
    quarter = F.expr("commit_ts % 10000 DIV 2500")
    level = F.when(quarter == 0, "L1").when(quarter == 3, "memtable").otherwise("L0")
    return versions(spark, sf).withColumn("level", level).withColumn("table_id", F.when(F.col("level") == "L1", F.concat(F.lit("l1-"), F.expr("key DIV 50"))).otherwise(F.concat(F.lit("q"), quarter)))


LEVELS = V + """, l AS (
  SELECT *, CASE commit_ts % 10000 // 2500 WHEN 0 THEN 'L1' WHEN 3 THEN 'memtable' ELSE 'L0' END AS level,
    CASE commit_ts % 10000 // 2500 WHEN 0 THEN 'l1-' || (key // 50) ELSE 'q' || (commit_ts % 10000 // 2500) END AS table_id FROM v)"""


@query(f"""WITH {LEVELS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE table_id WHEN 'q3' THEN 0 WHEN 'q2' THEN 1 WHEN 'q1' THEN 2 ELSE 3 END, commit_ts DESC) AS n FROM l)
SELECT key, commit_ts, value FROM r WHERE n = 1 AND NOT tombstone""")
def lsm_levels_merge(spark, sf):
    rows = levels(spark, sf)
    parts = [rows.where(F.col("table_id") == t) for t in ("q3", "q2", "q1")] + [rows.where("level = 'L1'")]
    return upsert.merge_levels(parts, ["key"], ["commit_ts"]).select("key", "commit_ts", "value")


@query(f"WITH {LEVELS} SELECT level, count(DISTINCT table_id) AS n_tables, count(*) AS n_records, count(DISTINCT key) AS n_keys FROM l GROUP BY level")
def lsm_stats(spark, sf):
    return upsert.level_stats(levels(spark, sf))


@query(f"WITH {LEVELS} SELECT level, table_id, min(key) AS min_key, max(key) AS max_key, count(*) AS n_records FROM l GROUP BY level, table_id")
def sst_minmax(spark, sf):
    return upsert.key_ranges(levels(spark, sf), ["level", "table_id"])


@query(f"""WITH {LEVELS}, l0 AS (SELECT * FROM l WHERE level = 'L0'),
l1 AS (SELECT * FROM l WHERE level = 'L1' UNION ALL SELECT key + 1000000000, commit_ts, value, tombstone, level, 'far-' || table_id FROM l WHERE level = 'L1'),
hit AS (SELECT table_id FROM l1 GROUP BY table_id HAVING min(key) <= (SELECT max(key) FROM l0) AND max(key) >= (SELECT min(key) FROM l0)),
m AS (SELECT *, 0 AS p FROM l0 UNION ALL SELECT *, 1 FROM l1 WHERE table_id IN (SELECT table_id FROM hit)),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, commit_ts DESC) AS n FROM m)
SELECT 'run' AS table_id, key, commit_ts, tombstone FROM r WHERE n = 1 AND NOT tombstone
UNION ALL SELECT table_id, key, commit_ts, tombstone FROM l1 WHERE table_id NOT IN (SELECT table_id FROM hit)""")
def compact_partial(spark, sf):
    """All of L0 with the L1 tables that it overlaps; as many tables of keys far above stay as they are."""
    rows = levels(spark, sf)
    l1 = rows.where("level = 'L1'")
    far = l1.withColumn("key", F.col("key") + 1_000_000_000).withColumn("table_id", F.concat(F.lit("far-"), "table_id"))
    merged = upsert.compact(rows.where("level = 'L0'"), l1.unionByName(far), order="commit_ts")
    return merged.select("table_id", "key", "commit_ts", "tombstone")


@query("""WITH c AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer)
SELECT lpad(CAST(k AS VARCHAR), 9, '0') AS key, CASE WHEN k % 5 = 1 THEN 'again' WHEN k % 7 < 6 THEN 'r' || (k % 7) ELSE v END AS value
FROM c WHERE k % 5 = 1 OR NOT (k % 7 < 6 AND k % 3 = 0)""")
def lsm_write_path(spark, sf):
    """A keyed relation after seven appended parts of puts and deletes, merged as they gather."""
    store = Store(spark, scratch(spark, "lsm"))
    base = table(spark, sf, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("key"), F.col("c_mktsegment").alias("value"))
    store.write("t", base.select("key", "value"), sort_key="key", key="key")
    for r in range(6):
        store.append("t", base.where(F.col("c_custkey") % 7 == r).select("key", F.lit(f"r{r}").alias("value"), (F.col("c_custkey") % 3 == 0).alias("_dead")))
    store.append("t", base.where("c_custkey % 5 = 1").select("key", F.lit("again").alias("value"), F.lit(False).alias("_dead")))
    return store.read("t")


@query("SELECT * FROM (VALUES ('a', '1'), ('c', '3x'), ('d', '4')) t(key, value)")
def kv_buffered(spark, sf):
    """Puts and deletes through a buffer that flushes, and what a second opening replays."""
    store = Store(spark, scratch(spark, "kv"))
    first = KeyedTable(store, "t", flush_bytes=8)
    first.put_all([("a", "1"), ("b", "2"), ("c", "3"), ("b", None)])
    first.put_all([("c", "3x"), ("d", "4")])
    return KeyedTable(store, "t").scan()


# Data changes.


@query("""WITH d AS (
  SELECT o_orderkey, 0::BIGINT AS o_custkey, CAST(NULL AS VARCHAR) AS o_orderstatus FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT -1 - o_orderkey, o_custkey, 'N' FROM orders WHERE o_orderkey % 50 = 1)
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d) UNION ALL SELECT * FROM d""")
def upsert_rows(spark, sf):
    base = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    replaced = base.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit(0).cast("bigint").alias("o_custkey"))
    added = base.where("o_orderkey % 50 = 1").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"))
    return dml.upsert(base, replaced.unionByName(added, allowMissingColumns=True), "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 'RETAIL' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_where(spark, sf):
    return dml.update(table(spark, sf, "customer"), {"c_mktsegment": F.lit("RETAIL")}, F.col("c_nationkey") == 7, "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, 'RETAIL' AS c_mktsegment FROM customer")
def update_all(spark, sf):
    return dml.update(table(spark, sf, "customer"), {"c_mktsegment": F.lit("RETAIL")}, key="c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT count(*) FILTER (c_nationkey = 7) AS rows_affected FROM customer")
def update_count(spark, sf):
    return dml.affected(table(spark, sf, "customer"), F.col("c_nationkey") == 7)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def delete_where(spark, sf):
    return dml.delete(table(spark, sf, "orders"), F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey FROM orders WHERE false")
def delete_all(spark, sf):
    return dml.delete(table(spark, sf, "orders")).select("o_orderkey")


# Versions and transactions.


def _snapshot(ts: int) -> None:
    name = f"mvcc_snapshot_{ {50: 'early', 5000: 'mid', 2**62: 'latest'}[ts] }"

    def run(spark, sf):
        return mvcc.snapshot_at(versions(spark, sf), ts).select("key", "commit_ts", "value")

    QUERIES[name] = run
    ORACLE[name] = f"WITH {V} SELECT key, commit_ts, value FROM ({NEWEST.format(where=f'commit_ts <= {ts}')}) WHERE NOT tombstone"


for _ts in (50, 5000, 2**62):
    _snapshot(_ts)


@query("SELECT c_custkey AS key, coalesce((SELECT max(event_id) FROM events WHERE user_id = c_custkey), 0) AS last_commit_ts FROM customer")
def mvcc_last_commit(spark, sf):
    return mvcc.last_commit(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), versions(spark, sf))


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_id > 400 AND event_id <= 450)")
def mvcc_window_conflicts(spark, sf):
    return mvcc.written_between(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), versions(spark, sf), 400, 450)


@query(f"WITH {V} SELECT key, commit_ts, tombstone, CAST(row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) AS INT) AS version_rank FROM v")
def mvcc_version_history(spark, sf):
    return mvcc.version_history(versions(spark, sf)).select("key", "commit_ts", "tombstone", "version_rank")


@query(f"WITH {V} SELECT key, commit_ts, value FROM v")
def mvcc_apply_idempotent(spark, sf):
    v = versions(spark, sf)
    log = v.withColumn("log_index", F.col("commit_ts")).unionByName(v.where("commit_ts % 3 = 0").withColumn("log_index", F.col("commit_ts") + 10_000_000).withColumn("value", F.lit(-1.0)))
    return mvcc.apply_commits(log).select("key", "commit_ts", "value")


@query("""WITH t AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT event_id AS txn_id, user_id AS key, coalesce(before > event_id - 50, false) AS conflict FROM t""")
def txn_validate(spark, sf):
    txns = versions(spark, sf).select(F.col("commit_ts").alias("txn_id"), "key", (F.col("commit_ts") - 50).alias("read_ts"), "commit_ts")
    return mvcc.validate_history(txns, versions(spark, sf), 50).select("txn_id", "key", "conflict")


@query(f"""WITH {V}, s AS ({NEWEST.format(where='commit_ts <= 500')}),
o AS (SELECT key, value, tombstone, commit_ts AS seq FROM v WHERE commit_ts > 500 AND commit_ts <= 600 QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) = 1)
SELECT key, value FROM o WHERE NOT tombstone UNION ALL SELECT key, value FROM s WHERE NOT tombstone AND key NOT IN (SELECT key FROM o)""")
def txn_read_own_writes(spark, sf):
    v = versions(spark, sf)
    own = v.where("commit_ts > 500 AND commit_ts <= 600").withColumnRenamed("commit_ts", "seq")
    return mvcc.overlay(mvcc.snapshot_at(v, 500), own)


@query("""SELECT event_id, ((epoch_us(ts) // 1000) << 16) + row_number() OVER (PARTITION BY epoch_us(ts) // 1000 ORDER BY event_id) - 1 AS hlc FROM events""")
def hlc_stamp(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    ms = F.expr("unix_micros(CAST(ts AS timestamp)) DIV 1000")
    return mvcc.hlc_stamp(e, ms, "event_id").select("event_id", "hlc")


@query("""WITH x AS (SELECT event_id * 10 + i AS stamp_id, event_id // 8000 AS ms FROM events, range(10) t(i)),
m AS (SELECT ms, count(*) AS n FROM x GROUP BY ms), p AS (SELECT ms, sum(n) OVER (ORDER BY ms) - n AS before FROM m),
f AS (SELECT ms, before + max((ms << 16) - before) OVER (ORDER BY ms) AS first FROM p)
SELECT stamp_id, (first + row_number() OVER (PARTITION BY ms ORDER BY stamp_id) - 1)::BIGINT AS hlc FROM x JOIN f USING (ms)""")
def hlc_overflow(spark, sf):
    """Ten stamps for each event, 80,000 in a millisecond: what doesn't fit goes on in the next without repeating."""
    e = table(spark, sf, "events").select("event_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    return mvcc.hlc_stamp(e.withColumn("stamp_id", F.col("event_id") * 10 + F.col("i")), F.expr("event_id DIV 8000"), "stamp_id").select("stamp_id", "hlc")


@query("""WITH t AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT event_id AS txn_id, user_id AS key, coalesce(before > event_id - 700, false) AS conflict FROM t""")
def txn_validate_long(spark, sf):
    """Transactions that span many of the windows by which validation is split."""
    txns = versions(spark, sf).select(F.col("commit_ts").alias("txn_id"), "key", (F.col("commit_ts") - 700).alias("read_ts"), "commit_ts")
    return mvcc.validate_history(txns, versions(spark, sf), 50).select("txn_id", "key", "conflict")


@query(f"""WITH {V}, s AS (SELECT key, value FROM ({NEWEST.format(where='true')}) WHERE NOT tombstone)
SELECT CAST(key AS VARCHAR) AS key, CAST(value AS VARCHAR) AS value FROM s WHERE key NOT IN (1, 2) UNION ALL SELECT '1', 'one'""")
def txn_session(spark, sf):
    """The newest snapshot after one transaction that commits and one that loses to it."""
    start = versions(spark, sf).select(F.col("key").cast("string").alias("key"), "commit_ts", F.col("value").cast("string").alias("value"), "tombstone")
    manager = mvcc.Transactions(Store(spark, scratch(spark, "txn")), start, mvcc.Clock(lambda: 0))
    kept, lost = manager.begin(), manager.begin()
    kept.put("1", "one")
    kept.delete("2")
    lost.get("1")
    lost.put("3", "three")
    if not manager.commit(kept)[0] or manager.commit(lost)[0]:
        raise AssertionError("the second transaction read what the first wrote")
    return mvcc.snapshot_at(manager.versions, 2**62).select("key", "value")


# Sharding.

MANIFEST = Manifest([Shard("s0", "", "00000500"), Shard("s1", "00000500", "00001000"), Shard("s2", "00001000", "")])
KEYED = "k AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS key FROM orders)"
OWNED = KEYED + ", a AS (SELECT key, CASE WHEN key < '00000500' THEN 's0' WHEN key < '00001000' THEN 's1' ELSE 's2' END AS shard FROM k)"


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("key"))


@query(f"WITH {OWNED} SELECT key, shard FROM a")
def shard_assign(spark, sf):
    return sharding.assign(keyed(spark, sf), "key", MANIFEST)


@query(f"""WITH {OWNED}, m(shard, "start", "end") AS (VALUES ('s0', '', '00000500'), ('s1', '00000500', '00001000'), ('s2', '00001000', ''))
SELECT m.*, count(a.key) AS n_keys FROM m LEFT JOIN a USING (shard) GROUP BY ALL""")
def shard_counts(spark, sf):
    return sharding.status(keyed(spark, sf), "key", MANIFEST)


@query(f"WITH {OWNED} SELECT key, shard FROM a WHERE key >= '00000400' AND key < '00000600'")
def shard_prune(spark, sf):
    """Only the shards that the scan meets are asked."""
    met = Manifest.prune(MANIFEST, "00000400", "00000600")
    parts = [sharding.range_scan(keyed(spark, sf), "key", max(s.start, "00000400"), min(s.end or "00000600", "00000600")).withColumn("shard", F.lit(s.id)) for s in met]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {KEYED} SELECT key AS split_key FROM k QUALIFY row_number() OVER (ORDER BY key) = (SELECT count(*) FROM k) // 2 + 1")
def shard_split_median(spark, sf):
    rows = keyed(spark, sf)
    whole = Shard("s0", "", "")
    return spark.createDataFrame([(sharding.median_key(rows, "key", whole, rows.count()),)], "split_key string")


@query(f"""WITH {OWNED}, n AS (SELECT shard, key, row_number() OVER (PARTITION BY shard ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY shard) AS n FROM a),
c AS (SELECT shard, key AS at, row_number() OVER (ORDER BY shard) + 2 AS id FROM n WHERE n > 900 AND i = n // 2),
f AS (SELECT a.key, CASE WHEN c.at IS NOT NULL AND a.key >= c.at THEN 's' || c.id ELSE a.shard END AS shard FROM a LEFT JOIN c USING (shard))
SELECT shard, count(*) AS n_keys FROM f GROUP BY shard""")
def shard_rebalance(spark, sf):
    rows = keyed(spark, sf)
    now, _ = sharding.rebalance(rows, "key", MANIFEST, 900)
    return sharding.status(rows, "key", now).where("n_keys > 0").select("shard", "n_keys")


@query(f"""WITH {KEYED}, h AS (SELECT CASE WHEN CAST(key AS BIGINT) % 3 = 0 THEN '00000777' ELSE key END AS key FROM k)
SELECT key AS split_key FROM h QUALIFY row_number() OVER (ORDER BY key) = (SELECT count(*) FROM h) * 9 // 10 + 1""")
def shard_split_hot(spark, sf):
    """The key at nine tenths where a third of the rows hold one key."""
    rows = keyed(spark, sf).select(F.when(F.col("key").cast("bigint") % 3 == 0, F.lit("00000777")).otherwise(F.col("key")).alias("key"))
    return spark.createDataFrame([(scan.nth_key(rows, "key", rows.count() * 9 // 10),)], "split_key string")


@query("SELECT count(*) AS n_keys, true AS within FROM orders")
def shard_rebalance_all(spark, sf):
    """Splits until no shard holds more than 400 keys: all keys are still owned, and no shard is larger."""
    rows = keyed(spark, sf)
    done = sharding.status(rows, "key", sharding.rebalance_all(rows, "key", MANIFEST, max(400, rows.count() // 40)))
    return done.agg(F.sum("n_keys").alias("n_keys"), (F.max("n_keys") <= max(400, rows.count() // 40)).alias("within"))


def routed(spark: SparkSession, sf: str) -> Router:
    """Orders in the shards of MANIFEST: key, customer."""
    router = Router(Store(spark, scratch(spark, "router")), MANIFEST)
    rows = table(spark, sf, "orders")
    router.load(rows.select(F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("key"), F.col("o_custkey").cast("string").alias("value")))
    return router


ROUTED = "o AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS key, CAST(o_custkey AS VARCHAR) AS value FROM orders)"


@query(f"""WITH {ROUTED}, c AS (SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer)
SELECT key, CASE WHEN key = '00000002' THEN 'put' ELSE value END AS value FROM o JOIN c USING (key) WHERE key <> '00000001'""")
def kv_routed_get(spark, sf):
    """Routed gets of the keys that customers have, after a routed put and delete."""
    router = routed(spark, sf)
    router.put_all([("00000002", "put"), ("00000001", None)])
    return router.get_all(table(spark, sf, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("key")))


@query(f"""WITH {ROUTED} SELECT key, value, CASE WHEN key < '00000500' THEN 's0' WHEN key < '00001000' THEN 's1' ELSE 's2' END AS shard FROM o
WHERE key >= '00000400' AND key < '00001200'""")
def router_scan(spark, sf):
    return routed(spark, sf).scan("00000400", "00001200")


@query(f"""WITH {ROUTED}, m(shard, "start", "end") AS (VALUES ('s0', '', '00000250'), ('s3', '00000250', '00000500'), ('s1', '00000500', '00001000'), ('s2', '00001000', '')),
a AS (SELECT key, CASE WHEN key < '00000250' THEN 's0' WHEN key < '00000500' THEN 's3' WHEN key < '00001000' THEN 's1' ELSE 's2' END AS shard FROM o)
SELECT m.*, count(a.key) AS n_keys FROM m LEFT JOIN a USING (shard) GROUP BY ALL""")
def shard_split(spark, sf):
    """A split, seen by a router that opens the store anew."""
    router = routed(spark, sf)
    router.split("s0", "00000250")
    return Router(router.store).status()


# Schema versions.

CHAIN = [
    ("nation", 100, 0, "n_nationkey", "INT", None, 100), ("nation", 100, 1, "n_name", "STRING", None, 100),
    ("nation", 200, 0, "n_nationkey", "INT", None, 100), ("nation", 200, 1, "n_name", "STRING", None, 100), ("nation", 200, 2, "comment", "STRING", "none", 200),
    ("nation", 300, 0, "n_nationkey", "INT", None, 100), ("nation", 300, 1, "comment", "STRING", "none", 200),
]


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    some = F.create_map(F.lit("n_nationkey"), F.col("n_nationkey").cast("string"), F.lit("n_name"), F.col("n_name"))
    return n.select(F.when(F.col("n_nationkey") % 5 == 0, F.map_concat(some, F.create_map(F.lit("comment"), F.lit("kept")))).otherwise(some).alias("raw"))


def _columns(ts: int) -> list[tuple[str, str, str | None]]:
    return [c[:3] for c in schema.Catalog(CHAIN).columns("nation", ts)]


@query("SELECT * FROM (VALUES ('nation', 200::BIGINT, 0, 'n_nationkey', 'INT'), ('nation', 200, 1, 'n_name', 'STRING'), ('nation', 200, 2, 'comment', 'STRING')) t(table_name, since, pos, column_name, column_type)")
def schema_active_at(spark, sf):
    return schema.active_at(schema.Catalog(CHAIN).frame(spark), 250).select("table_name", "since", "pos", "column_name", "column_type")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CASE WHEN n_nationkey % 5 = 0 THEN 'kept' ELSE 'none' END AS comment FROM nation")
def schema_materialize(spark, sf):
    return schema.materialize(_raw(spark, sf), _columns(250))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'kept' END AS comment FROM nation")
def schema_sql_null(spark, sf):
    return schema.materialize(_raw(spark, sf), _columns(350), defaults=False)


# Two-phase commit: transactions of four events each, over three shards by key.

SHARD_OF = "CASE WHEN user_id < 50 THEN 'a' WHEN user_id < 100 THEN 'b' ELSE 'c' END"
PREPARED = f"""p AS (
  SELECT DISTINCT {SHARD_OF} AS shard, event_id // 4 AS txn FROM events),
l AS (SELECT shard, txn, CASE WHEN txn % 3 = 0 THEN 'prepared' ELSE 'applied' END AS phase FROM p)"""


def _prepares(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events").select(F.expr("event_id DIV 4").alias("txn"), F.expr(SHARD_OF).alias("shard"))
    first = e.distinct().select("shard", F.col("txn").alias("seq"), F.col("txn").cast("string").alias("txn_id"), F.col("txn").alias("commit_ts"), F.lit("prepared").alias("phase"))
    log = first.unionByName(first.where("seq % 3 <> 0").withColumn("phase", F.lit("applied")).withColumn("seq", F.col("seq") + 100_000_000))
    decided = first.select("seq", "txn_id").distinct().where("seq % 5 <> 0").withColumn("outcome", F.expr("CASE WHEN seq % 7 = 0 THEN 'abort' ELSE 'commit' END"))
    return log, decided


@query(f"WITH {PREPARED} SELECT shard, CAST(txn AS VARCHAR) AS txn_id FROM l WHERE phase = 'prepared'")
def twopc_pending(spark, sf):
    return twopc.pending(_prepares(spark, sf)[0]).select("shard", "txn_id")


@query(f"""WITH {PREPARED} SELECT shard, CAST(txn AS VARCHAR) AS txn_id, CASE WHEN txn % 5 = 0 OR txn % 7 = 0 THEN 'abort' ELSE 'commit' END AS outcome
FROM l WHERE phase = 'prepared'""")
def twopc_recover(spark, sf):
    return twopc.recover(*_prepares(spark, sf)).select("shard", "txn_id", "outcome")


@query(f"""WITH {PREPARED} SELECT CASE WHEN txn % 5 = 0 OR txn % 7 = 0 THEN 'abort' ELSE 'commit' END AS outcome, count(*) AS n
FROM l WHERE phase = 'prepared' GROUP BY 1""")
def twopc_recover_counts(spark, sf):
    return twopc.recovered_counts(twopc.recover(*_prepares(spark, sf)))


@query(f"""SELECT CAST(event_id // 4 AS VARCHAR) AS txn_id, {SHARD_OF} AS shard, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY event_id) AS keys
FROM events GROUP BY 1, 2""")
def twopc_group_by_shard(spark, sf):
    e = table(spark, sf, "events")
    op = F.struct(F.lit("put").alias("kind"), F.col("user_id").alias("key"), F.col("value"))
    txns = e.groupBy(F.expr("event_id DIV 4").cast("string").alias("txn_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", op.alias("op")))), lambda x: x["op"]).alias("ops"))
    return twopc.group_by_shard(txns, F.expr(SHARD_OF.replace("user_id", "key"))).select("txn_id", "shard", F.array_join(F.transform("ops", lambda o: o["key"].cast("string")), ",").alias("keys"))


@query(f"""WITH {V}, o AS (SELECT *, commit_ts // 4 AS txn FROM v WHERE commit_ts >= 500 AND commit_ts // 4 % 3 = 0 AND commit_ts // 4 % 5 <> 0 AND commit_ts // 4 % 7 <> 0),
n AS (SELECT key, commit_ts, value FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) = 1),
b AS (SELECT key, value FROM ({NEWEST.format(where='commit_ts < 500')}) WHERE NOT tombstone)
SELECT key, value FROM n UNION ALL SELECT key, value FROM b WHERE key NOT IN (SELECT key FROM n)""")
def twopc_apply_recovered(spark, sf):
    """The state at 500 after the pending transactions that were decided to commit."""
    e = table(spark, sf, "events").where("event_id >= 500")
    op = F.struct(F.lit("put").alias("kind"), F.col("user_id").alias("key"), F.col("value"))
    txn = F.expr("event_id DIV 4")
    prepares = e.groupBy(txn.alias("seq"), F.expr(SHARD_OF).alias("shard")).agg(F.array_sort(F.collect_list(F.struct("event_id", op.alias("op")))).alias("o"))
    prepares = prepares.select("shard", "seq", F.col("seq").cast("string").alias("txn_id"), F.col("seq").alias("commit_ts"), F.transform("o", lambda x: x["op"]).alias("ops"), F.expr("CASE WHEN seq % 3 = 0 THEN 'prepared' ELSE 'applied' END").alias("phase"))
    decided = _prepares(spark, sf)[1]
    base = mvcc.snapshot_at(versions(spark, sf), 499)
    return twopc.apply_ops(base, twopc.recover(prepares, decided))


@query(f"""WITH {ROUTED}, n(key, value) AS (VALUES ('00000001', 'c1'), ('00000600', 'c2'), ('00009999x', 'd1'))
SELECT * FROM n UNION ALL SELECT key, value FROM o WHERE key NOT IN (SELECT key FROM n) AND key <> '00000700'""")
def twopc_commit(spark, sf):
    """Orders after a commit over two shards, one that crashes before its decision, one after it, an abort, and recovery."""
    c = twopc.Coordinator(routed(spark, sf))
    c.commit([("put", "00000001", "c1"), ("put", "00000600", "c2")])
    for step, ops in (("prepare", [("put", "00000002", "lost"), ("put", "00000800", "lost")]), ("decision", [("put", "00009999x", "d1"), ("delete", "00000700", None)])):
        try:
            c.commit(ops, crash_after=step)
        except twopc.Crash:
            pass
    c.abort(c.prepare([("put", "00000003", "lost")]))
    again = twopc.Coordinator(Router(c.store))
    again.recover()
    return again.router.scan().select("key", "value")


# Replicated log.


@query("""WITH m AS (SELECT c_custkey % 5 AS node, max(c_custkey) AS match_index FROM customer WHERE c_custkey % 5 <> 4 OR c_custkey < 50 GROUP BY 1)
SELECT coalesce(max(event_id), 0) AS commit_index FROM events
WHERE event_id % 1000 >= 20 AND event_id <= (SELECT match_index FROM m ORDER BY match_index DESC LIMIT 1 OFFSET 2)""")
def raft_commit_index(spark, sf):
    match = table(spark, sf, "customer").where("c_custkey % 5 <> 4 OR c_custkey < 50").groupBy((F.col("c_custkey") % 5).alias("node")).agg(F.max("c_custkey").alias("match_index"))
    log = table(spark, sf, "events").select(F.col("event_id").alias("index"), F.when(F.col("event_id") % 1000 >= 20, 2).otherwise(1).alias("term"))
    return replication.commit_index(match, log, 2)


def _log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    key = F.col("user_id").cast("string")
    command = F.when(F.col("event_type") == "error", replication.encode_delete(key)).when(F.col("event_id") % 97 == 0, F.lit("{torn")).otherwise(replication.encode_set(key, F.col("event_type")))
    return e.select(F.col("event_id").alias("index"), F.lit(1).cast("bigint").alias("term"), command.alias("command"))


@query("""WITH o AS (SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value, event_id AS index FROM events WHERE event_id <= 700 AND (event_type = 'error' OR event_id % 97 <> 0)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT key, value, index FROM o WHERE value <> 'error'""")
def raft_apply_prefix(spark, sf):
    log = _log(spark, sf)
    return replication.apply_prefix(log.unionByName(log.where("index % 2 = 0")), 700)


@query("""WITH m AS (SELECT max(event_id) AS m FROM events)
SELECT event_id AS index, CASE WHEN event_id < m * 3 // 10 THEN 1 ELSE 2 END::BIGINT AS term FROM events, m""")
def raft_append_reconcile(spark, sf):
    """A follower of the first six tenths, its tail diverged, gets entries from a quarter on, of a newer term from three tenths on."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("index"))
    last = e.agg(F.max("index")).first()[0]
    follower = e.where(F.col("index") < last * 6 // 10).withColumn("term", F.lit(1).cast("bigint"))
    newer = F.when(F.col("index") < last * 3 // 10, 1).otherwise(2).cast("bigint")
    entries = e.where(F.col("index") >= last // 4).withColumn("term", newer)
    return replication.reconcile(follower, entries, last // 4 - 1, 1)


@query("""WITH o AS (SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value, event_id + 1 AS index FROM events WHERE event_type = 'error' OR event_id % 97 <> 0
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT key, value, index FROM o WHERE value <> 'error'""")
def raft_log_truncated(spark, sf):
    """The state of a log that was applied and cut at its middle, then followed, reopened and applied to its end."""
    store = Store(spark, scratch(spark, "raft"))
    whole = _log(spark, sf).withColumn("index", F.col("index") + 1)
    last = whole.agg(F.max("index")).first()[0]
    log = replication.ReplicatedLog(store)
    log.follow(whole.where(F.col("index") <= last * 2 // 3), 0, 0)
    log.apply(last // 2)
    log.truncate()
    again = replication.ReplicatedLog(store)
    again.follow(whole.where(F.col("index") > last // 2), last // 2, 1)
    again.apply(last)
    return again.live()


LIVE = """WITH o AS (SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value, event_id AS index FROM events WHERE event_type = 'error' OR event_id % 97 <> 0
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT key, value, index FROM o WHERE value <> 'error'"""


@query(LIVE)
def stream_apply(spark, sf):
    """The log as a stream of JSON lines, applied by a query that ends with what is there."""
    root = scratch(spark, "stream")
    append_log(_log(spark, sf), f"{root}/log")
    store = Store(spark, f"{root}/state")
    apply_stream(spark, f"{root}/log", store, f"{root}/checkpoint", available_now=True).awaitTermination()
    return live(store).select("key", "value", "index")


@query(LIVE)
def log_replay(spark, sf):
    """The log written, read back and applied as a whole."""
    path = scratch(spark, "log")
    append_log(_log(spark, sf), path)
    return replication.apply_prefix(read_log(spark, path, LOG), 2**62)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def backup_roundtrip(spark, sf):
    """A store's relation after backup and restore."""
    root = scratch(spark, "backup")
    made = Store(spark, f"{root}/a")
    made.write("nation", table(spark, sf, "nation"), sort_key="n_nationkey")
    made.backup(f"{root}/saved")
    return Store.restore(spark, f"{root}/saved", f"{root}/b").read("nation")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey BETWEEN 3 AND 9 THEN 'changed' ELSE n_name END AS name, CAST(NULL AS VARCHAR) AS note
FROM nation WHERE n_regionkey <> 2""")
def sql_dialect(spark, sf):
    """Statements of the dialect over nation."""
    engine = Engine(spark)
    engine.import_table("n", table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region")), "id")
    engine.sql("UPDATE n SET name = 'changed' WHERE id BETWEEN 3 AND 9")
    engine.sql("DELETE FROM n WHERE region = 2")
    engine.sql("ALTER TABLE n DROP COLUMN region")
    engine.sql("ALTER TABLE n ADD COLUMN note STRING DEFAULT 'x'")
    return engine.sql("SELECT id, name, note FROM n")


@query("""SELECT * FROM (VALUES (1::BIGINT, 'a', 'none'), (2, 'b2', 'x'), (4, NULL, 'none')) t(id, name, note)""")
def sql_durable(spark, sf):
    """CREATE, INSERT, UPDATE, DELETE and ALTER on a store, read by an engine that opens it anew, through its newest schema."""
    store = Store(spark, scratch(spark, "sql"))
    engine = Engine(spark, store)
    for text in (
        "CREATE TABLE t (id INT, name STRING, PRIMARY KEY (id))", "INSERT INTO t VALUES (1, 'a')", "INSERT INTO t VALUES (2, 'b')", "INSERT INTO t VALUES (3, 'c')", "INSERT INTO t (id) VALUES (4)",
        "ALTER TABLE t ADD COLUMN note STRING DEFAULT 'none'", "UPDATE t SET name = 'b2', note = 'x' WHERE id = 2", "DELETE FROM t WHERE name = 'c'",
    ):
        engine.sql(text)
    again = Engine(spark, store)
    return again.as_of("t", max(again.catalog.versions("t")))


@query("SELECT * FROM (VALUES ('CREATE', true), ('INSERT', true), ('UPDATE', true), ('SELECT', true), ('ALTER', true)) t(statement, refused)")
def sql_type_errors(spark, sf):
    """Statements that the schema forbids are refused before anything changes."""
    engine = Engine(spark)
    engine.import_table("n", table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name")), "id")
    out = []
    for text in ("CREATE TABLE n (a INT, PRIMARY KEY (a))", "INSERT INTO n VALUES ('x', 'y')", "UPDATE n SET name = 5", "SELECT nope FROM n", "ALTER TABLE n DROP COLUMN id"):
        try:
            engine.sql(text)
            out.append((text.split()[0], False))
        except DialectError:
            out.append((text.split()[0], True))
    return spark.createDataFrame(out, "statement string, refused boolean")
