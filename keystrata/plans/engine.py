"""The dialect on DataFrames: statements become rewrites and filters, and Catalyst plans them.

Rows hold one column per column ever added, named by its birth, so that a dropped and re-added name doesn't bring old
values back. INSERT replaces the row of its key. SELECT shows null where a row lacks a column, even one with a default:
``Engine.as_of`` applies defaults. WHERE compares string forms, and ranges of keys go by bytes of their string form.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.values import column_between, column_equals
from keystrata.operators import dml
from keystrata.operators.schema import TYPES, Catalog
from keystrata.plans import dialect as d
from keystrata.sources.store import DEAD, Store, cut_lineage

#: After so many changes a table without a store is written to the session's checkpoint folder, to cut its lineage.
CUT_EVERY = 16


class Engine:
    """A catalog and its tables. With a store, a statement that changes rows appends only these, as a part of its own."""

    def __init__(self, spark: SparkSession, store: Store | None = None, clock=time.time_ns):
        self.spark, self.store, self.clock = spark, store, clock
        self.catalog, self.keys, self.tables, self.changes = Catalog(), {}, {}, {}
        if store is not None and "catalog" in store.names():
            rows = [tuple(r) for r in store.read("catalog").collect()]
            self.catalog = Catalog([r[:7] for r in rows])
            self.keys = {r[0]: r[7] for r in rows}
            self.tables = {t: store.read(f"table_{t}") for t in self.keys}

    def sql(self, text: str) -> DataFrame:
        """SELECT gives its rows; other statements one row (rows_affected, message)."""
        s = d.parse(text)
        run = {d.CreateTable: self._create, d.Insert: self._insert, d.Select: self._select, d.Update: self._update, d.Delete: self._delete, d.AlterTable: self._alter}
        return run[type(s)](s)

    def as_of(self, table: str, ts: int) -> DataFrame:
        """The table through the schema that held at ts, with defaults for what rows lack; an error before its first."""
        self._known(table)
        columns = self.catalog.columns(table, ts)
        if not columns:
            raise d.DialectError(f"{table} has no version at {ts}")
        raw = self.tables[table]
        return raw.select(*(self._stored(raw, n, born, k, default).alias(n) for n, k, default, born in columns))

    def raw(self, table: str) -> DataFrame:
        """Everything that is stored, dropped columns included: name@birth, and which columns each row was written with."""
        self._known(table)
        return self.tables[table]

    def catalog_frame(self) -> DataFrame:
        return self.catalog.frame(self.spark)

    def import_table(self, table: str, df: DataFrame, key: str) -> None:
        """Makes a table of a DataFrame of long and string columns; of equal keys any one row is kept."""
        kinds = {v: k for k, v in TYPES.items()}
        columns = [(n, kinds[t]) for n, t in df.dtypes]
        self._create(d.CreateTable(table, columns, key))
        self._change(table, dml.newest(self._written(table, df), [self._key_column(table)], ["_has"]))

    def _known(self, table: str) -> None:
        if table not in self.tables:
            raise d.DialectError(f"no table {table}")

    def _status(self, n: int, message: str) -> DataFrame:
        return self.spark.createDataFrame([(n, message)], "rows_affected bigint, message string")

    @staticmethod
    def _name(column: str, born: int) -> str:
        return f"{column}@{born}"

    def _key_column(self, table: str) -> str:
        return next(self._name(n, b) for n, _, _, b in self.catalog.columns(table) if n == self.keys[table])

    def _stored(self, raw: DataFrame, name: str, born: int, kind: str, default: str | None = None) -> Column:
        column = self._name(name, born)
        value = F.col(f"`{column}`") if column in raw.columns else F.lit(None).cast(TYPES[kind])
        if default is None:
            return value
        return F.when(F.array_contains("_has", column), value).otherwise(F.lit(default).cast(TYPES[kind]))

    def _view(self, table: str) -> DataFrame:
        self._known(table)
        raw = self.tables[table]
        return raw.select(*(self._stored(raw, n, b, k).alias(n) for n, k, _, b in self.catalog.columns(table)))

    def _written(self, table: str, df: DataFrame) -> DataFrame:
        """Rows with the stored names of the columns that df has."""
        now = [(n, self._name(n, b), k) for n, k, _, b in self.catalog.columns(table) if n in df.columns]
        return df.select(*(F.col(f"`{n}`").cast(TYPES[k]).alias(stored) for n, stored, k in now), F.array(*(F.lit(s) for _, s, _ in now)).alias("_has"))

    def _start(self, table: str, df: DataFrame) -> None:
        """Makes df the table's rows."""
        if self.store is not None:
            self.store.write(f"table_{table}", df, key=self._key_column(table))
            df = self.store.read(f"table_{table}")
        self.tables[table] = df

    def _change(self, table: str, delta: DataFrame, dead: bool = False) -> None:
        """Puts rows in, each in place of the one of its key, or takes those of their keys out."""
        self.changes[table] = self.changes.get(table, 0) + 1
        key, base = self._key_column(table), self.tables[table]
        if self.store is not None:
            self.store.append(f"table_{table}", delta.withColumn(DEAD, F.lit(dead)))
            self.tables[table] = self.store.read(f"table_{table}")
            return
        base = self._widened(table)
        df = base.join(delta.select(f"`{key}`"), key, "left_anti").select(*(f"`{c}`" for c in base.columns)) if dead else dml.upsert(base, delta, key)
        self.tables[table] = cut_lineage(df) if self.changes[table] % CUT_EVERY == 0 else df

    def _save_catalog(self) -> None:
        if self.store is not None:
            rows = [(*r, self.keys[r[0]]) for r in self.catalog.rows]
            self.store.write("catalog", self.spark.createDataFrame(rows, "table_name string, since bigint, pos int, column_name string, column_type string, default_value string, added bigint, key_column string"))

    def _predicate(self, table: str, view: DataFrame, p: d.Predicate | None) -> Column | None:
        if p is None:
            return None
        if p.column not in view.columns:
            raise d.DialectError(f"no column {p.column} in {table}")
        if p.high is None:
            return column_equals(view, p.column, p.low)
        if p.column == self.keys[table]:
            return F.col(p.column).cast("string").between(str(p.low), str(p.high))
        return column_between(view, p.column, p.low, p.high)

    def _check(self, table: str, column: str, value: d.Value) -> None:
        kinds = {n: k for n, k, _, _ in self.catalog.columns(table)}
        if column not in kinds:
            raise d.DialectError(f"no column {column} in {table}")
        if (kinds[column] == "INT") != isinstance(value, int):
            raise d.DialectError(f"{column} is {kinds[column]}, not {json.dumps(value)}")

    def _create(self, s: d.CreateTable) -> DataFrame:
        if s.key not in [c for c, _ in s.columns]:
            raise d.DialectError(f"primary key {s.key} isn't a column")
        try:
            self.catalog.create(s.table, s.columns, self.clock())
        except ValueError as e:
            raise d.DialectError(str(e)) from None
        self.keys[s.table] = s.key
        schema = ", ".join(f"`{self._name(n, b)}` {TYPES[k]}" for n, k, _, b in self.catalog.columns(s.table))
        self._start(s.table, self.spark.createDataFrame([], schema + ", _has array<string>"))
        self._save_catalog()
        return self._status(0, f"created {s.table}")

    def _insert(self, s: d.Insert) -> DataFrame:
        self._known(s.table)
        names = s.columns or [n for n, *_ in self.catalog.columns(s.table)]
        if len(names) != len(s.values) or len(set(names)) < len(names):
            raise d.DialectError("columns and values differ")
        for c, v in zip(names, s.values, strict=True):
            self._check(s.table, c, v)
        if self.keys[s.table] not in names:
            raise d.DialectError(f"a value for the primary key {self.keys[s.table]} is needed")
        kinds = {n: TYPES[k] for n, k, _, _ in self.catalog.columns(s.table)}
        row = self.spark.createDataFrame([tuple(s.values)], ", ".join(f"`{n}` {kinds[n]}" for n in names))
        self._change(s.table, self._written(s.table, row))
        return self._status(1, "inserted")

    def _widened(self, table: str) -> DataFrame:
        """The stored rows with a column for each of the newest version's."""
        raw = self.tables[table]
        new = {self._name(n, b): F.lit(None).cast(TYPES[k]) for n, k, _, b in self.catalog.columns(table) if self._name(n, b) not in raw.columns}
        return raw.withColumns(new) if new else raw

    def _select(self, s: d.Select) -> DataFrame:
        view = self._view(s.table)
        for c in s.columns or []:
            if c not in view.columns:
                raise d.DialectError(f"no column {c} in {s.table}")
        p = self._predicate(s.table, view, s.where)
        found = view if p is None else view.where(p)
        order = F.col(self.keys[s.table]).cast("string")
        return found.orderBy(order).select(*(s.columns or view.columns))

    def _raw_predicate(self, table: str, p: d.Predicate | None) -> tuple[DataFrame, Column]:
        """The stored rows and the predicate as a column ``_hit`` of them."""
        raw = self._widened(table)
        names = {n: self._name(n, b) for n, _, _, b in self.catalog.columns(table)}
        view = raw.select("*", *(F.col(f"`{stored}`").alias(n) for n, stored in names.items()))
        return view.withColumn("_hit", dml.matches(self._predicate(table, view, p))).drop(*names), raw

    def _update(self, s: d.Update) -> DataFrame:
        self._known(s.table)
        for c, v in s.assign.items():
            self._check(s.table, c, v)
            if c == self.keys[s.table]:
                raise d.DialectError(f"cannot assign the primary key {c}")
        hits, raw = self._raw_predicate(s.table, s.where)
        hits = hits.where("_hit")
        n = hits.count()
        births = {c: (self._name(c, b), TYPES[k]) for c, k, _, b in self.catalog.columns(s.table)}
        new = {births[c][0]: F.lit(v).cast(births[c][1]) for c, v in s.assign.items()}
        new["_has"] = F.array_union("_has", F.array(*(F.lit(births[c][0]) for c in s.assign)))
        if n:
            self._change(s.table, hits.withColumns(new).select(*(f"`{c}`" for c in raw.columns)))
        return self._status(n, "updated")

    def _delete(self, s: d.Delete) -> DataFrame:
        self._known(s.table)
        hits, _ = self._raw_predicate(s.table, s.where)
        hits = hits.where("_hit")
        n = hits.count()
        if n:
            self._change(s.table, hits.select(f"`{self._key_column(s.table)}`"), dead=True)
        return self._status(n, "deleted")

    def _alter(self, s: d.AlterTable) -> DataFrame:
        self._known(s.table)
        try:
            if s.kind is None:
                if s.column == self.keys[s.table]:
                    raise d.DialectError(f"cannot drop the primary key {s.column}")
                self.catalog.drop_column(s.table, s.column, self.clock())
            else:
                if s.default is not None and (s.kind == "INT") != isinstance(s.default, int):
                    raise d.DialectError(f"the default isn't {s.kind}")
                self.catalog.add_column(s.table, s.column, s.kind, None if s.default is None else str(s.default), self.clock())
        except ValueError as e:
            raise e if isinstance(e, d.DialectError) else d.DialectError(str(e)) from None
        self._save_catalog()
        return self._status(0, f"altered {s.table}")
