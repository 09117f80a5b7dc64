import json

import pytest

from keystrata.plans import dialect
from keystrata.plans.engine import Engine
from keystrata.sources.store import Store, append_log, read_log
from keystrata.streaming.apply import LOG, apply_stream, fold, live


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE users (id INT, name STRING, age INT, PRIMARY KEY (id));")
    for i in range(1, 13):
        e.sql(f"INSERT INTO users VALUES ({i}, 'n{i}', {i * 10})")
    return e


def test_crud(engine, rows):
    q = lambda s: rows(engine.sql(s))
    assert [r.id for r in engine.sql("SELECT id FROM users").collect()] == [1, 10, 11, 12, 2, 3, 4, 5, 6, 7, 8, 9]
    assert q("select name from users where id = 2") == [("n2",)]
    assert q("SELECT id FROM users WHERE id BETWEEN 1 AND 10") == [(1,), (10,)]
    assert q("SELECT id FROM users WHERE age BETWEEN 20 AND 40") == [(2,), (3,), (4,)]
    assert q("SELECT id FROM users WHERE age = '30'") == [(3,)]
    assert q("UPDATE users SET name = 'x', age = 1 WHERE id = 2")[0][0] == 1
    assert q("SELECT * FROM users WHERE id = 2") == [(2, "x", 1)]
    assert q("INSERT INTO users (id, name) VALUES (2, 'it''s')") == [(1, "inserted")]
    assert q("SELECT * FROM users WHERE id = 2") == [(2, "it's", None)]
    assert q("DELETE FROM users WHERE age = 30")[0][0] == 1
    assert q("DELETE FROM users WHERE age BETWEEN 500 AND 900")[0][0] == 0
    assert len(q("SELECT * FROM users")) == 11  # the row of null age stays
    assert q("DELETE FROM users")[0][0] == 11 and q("SELECT * FROM users") == []


def test_exact_large_integers(engine, rows):
    engine.sql(f"INSERT INTO users VALUES ({2**62 + 1}, 'big', 0)")
    assert rows(engine.sql(f"SELECT name FROM users WHERE id = {2**62 + 1}")) == [("big",)]
    assert rows(engine.sql(f"SELECT name FROM users WHERE id = {2**62}")) == []


def test_schema_evolution(engine, rows):
    before = max(engine.catalog.versions("users"))
    engine.sql("ALTER TABLE users ADD COLUMN email STRING DEFAULT 'none'")
    added = max(engine.catalog.versions("users"))
    engine.sql("INSERT INTO users (id, email) VALUES (1, 'a@b')")
    assert rows(engine.sql("SELECT id, email FROM users WHERE id = 2")) == [(2, None)]  # a default isn't shown here
    assert rows(engine.as_of("users", added).where("id IN (1, 2)"), "id", "email") == [(1, "a@b"), (2, "none")]
    assert "email" not in engine.as_of("users", before).columns
    engine.sql("ALTER TABLE users DROP name")
    assert "name" not in engine.sql("SELECT * FROM users").columns
    engine.sql("ALTER TABLE users ADD name INT")
    assert rows(engine.sql("SELECT name FROM users WHERE id = 3")) == [(None,)]  # old values stay gone
    assert engine.catalog_frame().select("since").distinct().count() == 4


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM users WHERE id = 1 AND age = 2", "SELECT * FROM users ORDER BY id", "INSERT INTO users VALUES (1, 'a', 2), (2, 'b', 3)", "SELECT nope FROM users", "SELECT * FROM nobody",
        "INSERT INTO users VALUES ('1', 'a', 2)", "INSERT INTO users (name) VALUES ('a')", "INSERT INTO users (id) VALUES (1, 2)", "UPDATE users SET id = 4", "UPDATE users SET age = 'x' WHERE id = 77",
        "UPDATE users SET nope = 1", "ALTER TABLE users DROP id", "ALTER TABLE users ADD age INT", "CREATE TABLE users (a INT)", "CREATE TABLE t (a INT, PRIMARY KEY (b))", "CREATE TABLE t (a FLOAT)",
        "DROP TABLE users", "SELECT * FROM users WHERE id < 3", f"SELECT * FROM users WHERE id = {2**63}", "",
    ],
)
def test_errors(engine, text):
    with pytest.raises(dialect.DialectError):
        engine.sql(text)


def test_quoted_names():
    assert dialect.parse('SELECT "select" FROM "from" WHERE "key" BETWEEN \'a\' AND \'b\'').columns == ["select"]


def test_store_versions_backup_restore(spark, rows, tmp_path):
    s = Store(spark, f"file://{tmp_path}/root")
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert s.version("t") == 0
    s.write("t", df, sort_key="k")
    s.write("t", s.read("t").where("k = 1"))  # reads what it replaces
    assert rows(s.read("t")) == [(1, "a")] and len(rows(s.read("t", 1))) == 2
    s.write("empty", df.limit(0))
    assert s.backup(f"file://{tmp_path}/saved") == ["empty", "t"]
    with pytest.raises(FileExistsError):
        s.backup(f"file://{tmp_path}/saved")
    back = Store.restore(spark, f"file://{tmp_path}/saved", f"file://{tmp_path}/other")
    assert rows(back.read("t")) == [(1, "a")] and back.read("empty").schema == df.schema
    with pytest.raises(FileExistsError):
        Store.restore(spark, f"file://{tmp_path}/saved", f"file://{tmp_path}/other")
    s.vacuum("t")
    with pytest.raises(ValueError):
        s.read("t", 1).count()
    for bad in ("../x", "", ".x"):
        with pytest.raises(ValueError):
            s.write(bad, df)


def test_engine_on_a_store_survives_reopening(spark, rows, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db")
    e = Engine(spark, s)
    e.sql("CREATE TABLE t (k STRING, v STRING)")
    e.sql("INSERT INTO t VALUES ('a', '1')")
    e.sql("ALTER TABLE t ADD w INT")
    e.sql("INSERT INTO t VALUES ('b', '2', 3)")
    again = Engine(spark, s)
    assert rows(again.sql("SELECT * FROM t")) == [("a", "1", None), ("b", "2", 3)]
    again.sql("UPDATE t SET w = 9 WHERE k = 'a'")
    assert rows(Engine(spark, s).sql("SELECT w FROM t WHERE k = 'a'")) == [(9,)]


def test_a_statement_appends_only_its_rows(spark, rows, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db", trigger=100)
    e = Engine(spark, s)
    e.import_table("t", spark.range(5000).selectExpr("id", "CAST(id % 7 AS string) AS v"), "id")
    before = len(s.stats("table_t"))
    for text in ("INSERT INTO t VALUES (9, 'x')", "UPDATE t SET v = 'y' WHERE id = 10", "DELETE FROM t WHERE id BETWEEN 11 AND 11", "DELETE FROM t WHERE id = 99999"):
        e.sql(text)
    record = s._record("table_t")
    sizes = [spark.read.parquet(f"{tmp_path}/db/table_t/{p['dir']}").count() for p in record["parts"]]
    assert sizes[before:] == [1, 1, 1]
    assert rows(e.sql("SELECT * FROM t WHERE id BETWEEN 9 AND 11")) == [(10, "y"), (9, "x")] or rows(e.sql("SELECT * FROM t WHERE id = 9")) == [(9, "x")]
    s.compact("table_t")
    assert len(s.stats("table_t")) == 1 and Engine(spark, s).sql("SELECT * FROM t").count() == 4999


def test_torn_log_lines(spark, rows, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.json").write_text('{"index":1,"ter\n{"index":2,"term":1,"command":"y"}\n')
    with pytest.raises(Exception, match="corrupt log line"):
        read_log(spark, f"{tmp_path}/bad", LOG).collect()
    append_log(spark.createDataFrame([(1, 1, "x")], LOG), f"{tmp_path}/log")
    (tmp_path / "log" / "part-torn.json").write_text('{"index":2,"term":1,"command":"y"}\n{"index":3,"ter')
    assert rows(read_log(spark, f"{tmp_path}/log", LOG), "index") == [(1,), (2,)]


def test_stream_equals_batch(spark, rows, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    entry = lambda i, kind, key, value=None: json.dumps({"index": i, "term": 1, "command": json.dumps({"kind": kind, "key": key, "value": value})}) + "\n"
    s = Store(spark, f"file://{tmp_path}/state")

    def run():
        q = apply_stream(spark, str(log), s, f"{tmp_path}/ck", available_now=True)
        q.awaitTermination(120)

    (log / "a.json").write_text(entry(1, "set", "a", "1") + entry(2, "set", "b", "2") + entry(3, "delete", "a"))
    run()
    assert rows(live(s), "key", "value") == [("b", "2")]
    (log / "b.json").write_text(entry(2, "set", "b", "2") + entry(4, "set", "a", "3") + '{"index":5,"term":1,"command":"torn{"}\n' + entry(1, "set", "a", "1"))
    run()
    assert rows(live(s), "key", "value") == [("a", "3"), ("b", "2")]
    whole = fold(spark.createDataFrame([], "key string, value string, tombstone boolean, index bigint"), spark.read.schema(LOG).json(str(log)))
    assert rows(whole.where("NOT tombstone"), "key", "value") == [("a", "3"), ("b", "2")]
