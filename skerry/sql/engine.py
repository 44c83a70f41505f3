"""The engine behind the dialect: a catalogue, stored tables, and statements.

Tables are Parquet below a root folder that all executors share. A change writes
new files and then a new catalogue, so a reader sees either all of it or none;
INSERT adds files, UPDATE and DELETE write the changed table anew.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import hygiene as H
from skerry.sql import sysviews
from skerry.sql.emit import AGGREGATES, SCALARS, Emitter, Scope, cast_sql, collation, literal, name_of, spark_type
from skerry.sql.lexer import SqlError, fingerprint, split
from skerry.sql.parser import Node, parse

ROW = "_rowid"


@dataclass
class Column:
    name: str
    type: tuple[str, list[int]]
    nullable: bool = True
    identity: bool = False
    collation: str | None = None
    default: object = None  # of plain JSON values
    has_default: bool = False


@dataclass
class Table:
    name: str
    columns: list[Column]
    keys: list[dict] = field(default_factory=list)  # name, primary, columns
    checks: list[dict] = field(default_factory=list)  # name, text
    foreign: list[dict] = field(default_factory=list)  # name, columns, parent, keys, delete, update
    paths: list[str] = field(default_factory=list)
    next_id: int = 1
    temp: bool = False
    version: int = 0

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise SqlError(f"{self.name} has no column {name}")

    @property
    def primary(self) -> list[str]:
        return next((k["columns"] for k in self.keys if k["primary"]), [])

    @property
    def identity(self) -> str | None:
        """The single whole-number primary key, which is the row's identity too."""
        if len(self.primary) == 1 and self.column(self.primary[0]).type[0] in ("INTEGER", "BIGINT"):
            return self.column(self.primary[0]).name
        return None

    @property
    def schema(self) -> str:
        return ", ".join([f"{ROW} bigint", *(f"{name_of(c.name)} {spark_type(c.type)}" for c in self.columns)])


@dataclass
class Function:
    """A scalar function of the user's."""

    name: str
    arity: int
    type: str
    deterministic: bool
    null_propagating: bool
    description: str
    spark_name: str


class Engine:
    """A database. execute() takes one statement, script() several.

    root: where tables are stored; without one a new folder in spark.checkpoint.dir
    or, in local sessions, a temporary one of this machine. An engine opened on the
    same root finds its tables.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if root is None and folder:
            root = f"{folder}/skerry-db-{uuid.uuid4().hex}"
        if root is None:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("an engine on a cluster needs a root folder that all executors share")
            root = tempfile.mkdtemp(prefix="skerry-db-")
        self.spark, self.root = spark, root
        self.functions: dict[tuple[str, int], Function] = {}
        self.temp: dict[str, Table] = {}
        self.attached: dict[str, DataFrame] = {}
        self.tables: dict[str, Table] = {}
        self.views: dict[str, dict] = {}
        self.indexes: dict[str, dict] = {}
        self.rules: dict[str, dict] = {}
        self.external: dict[str, dict] = {}
        self.saved: dict[str, dict] = {}
        self.stats: dict[str, dict] = {}
        self._number, self._open = 0, []
        self._load()

    # --- the catalogue
    def _fs(self) -> tuple[object, Callable]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        return path(self.root).getFileSystem(conf), path

    def _load(self) -> None:
        fs, path = self._fs()
        folder = f"{self.root}/catalogue"
        if not fs.exists(path(folder)):
            return
        names = [s.getPath().getName() for s in fs.listStatus(path(folder)) if fs.exists(path(f"{folder}/{s.getPath().getName()}/_SUCCESS"))]
        if not names:
            return
        self._number = max(map(int, names))
        state = json.loads(self.spark.read.text(f"{folder}/{self._number}", wholetext=True).first()["value"])
        for key, t in state.pop("tables").items():
            t["columns"] = [Column(**{**c, "type": (c["type"][0], c["type"][1])}) for c in t["columns"]]
            self.tables[key] = Table(**t)
        for name, value in state.items():
            setattr(self, name, value)

    def _save(self) -> None:
        """Store the catalogue as its next number; the greatest complete one counts."""
        state = {"tables": {k: asdict(t) for k, t in self.tables.items()}}
        state |= {n: getattr(self, n) for n in ("views", "indexes", "rules", "external", "saved", "stats")}
        self._number += 1
        row = self.spark.createDataFrame([(json.dumps(state),)], "value string")
        row.coalesce(1).write.text(f"{self.root}/catalogue/{self._number}")

    def _changed(self, table: Table) -> None:
        table.version += 1
        if table.temp:
            return
        self._save()

    def find(self, name: str) -> Table:
        """A session's table before a stored one."""
        key = name.lower()
        if key in self.temp or key in self.tables:
            return self.temp.get(key) or self.tables[key]
        raise SqlError(f"no such table: {name}")

    def attach(self, name: str, df: DataFrame) -> None:
        """Name a DataFrame, which statements can read but not change."""
        self.attached[name.lower()] = df

    def plain(self, table: Table) -> DataFrame:
        """A table's rows as they are stored, with their identity."""
        if not table.paths:
            return self.spark.createDataFrame([], table.schema)
        return self.spark.read.schema(table.schema).parquet(*table.paths)

    def rows(self, table: Table, hidden: bool = False) -> DataFrame:
        """A table's rows; text columns with a collation compare by it. hidden adds the row's identity."""
        df = _collated(table, self.plain(table))
        return df if hidden else df.drop(ROW)

    def frame(self, name: str) -> DataFrame:
        """What a name in FROM stands for."""
        key = name.lower()
        if key in self.temp or (key in self.tables and key not in self.attached):
            return self.rows(self.find(name))
        if key in self.attached:
            return self.attached[key]
        if key in self.views:
            if key in self._open:
                raise SqlError(f"view {name} refers to itself")
            self._open.append(key)
            try:
                return self.select(parse(self.views[key]["text"]), {})
            finally:
                self._open.pop()
        if key in self.external:
            from skerry.sources.files import read_archive

            return read_archive(self.spark, self.external[key]["path"])
        if key.startswith("sys_"):
            return sysviews.view(self, key[4:])
        raise SqlError(f"no such table: {name}")

    def relation(self, name: str) -> tuple[str, list[tuple[str, str]]]:
        """A view of Spark's over what a name stands for, and its columns."""
        return self.register_view(self.frame(name))

    def register_view(self, df: DataFrame) -> tuple[str, list[tuple[str, str]]]:
        view = f"_skerry_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        self._views.append(view)
        return view, [(f.name, f.dataType.simpleString()) for f in df.schema.fields]

    # --- functions
    def register(
        self, name: str, arity: int, fn: Callable, returns: str = "string", deterministic: bool = True, null_propagating: bool = False, vectorized: bool = False, description: str = ""
    ) -> None:
        """Add a scalar function for all statements and pipelines; overloads differ by arity.

        fn takes and returns values, or Series if vectorized. null_propagating: a
        NULL argument gives NULL, and fn never sees one.
        """
        key = (name.upper(), arity)
        if name.upper() in SCALARS or name.upper() in AGGREGATES:
            raise SqlError(f"{name} is a built-in function")
        if key in self.functions:
            raise SqlError(f"{name} of {arity} arguments is registered already")
        run = fn
        if null_propagating and vectorized:

            def run(*columns: pd.Series) -> pd.Series:
                full = reduce(lambda a, b: a & b, (c.notna() for c in columns))
                out = pd.Series([None] * len(full), dtype=object)
                if full.any():
                    out[full.to_numpy()] = list(fn(*(c[full] for c in columns)))
                return out

        elif null_propagating:

            def run(*args: object) -> object:
                return None if any(a is None for a in args) else fn(*args)

        if vectorized:
            made = F.pandas_udf(_typed_series(run, arity), returns)
        else:
            made = F.udf(run, returns, useArrow=True)
        made = made if deterministic else made.asNondeterministic()
        spark_name = f"skerry_udf_{name.lower()}_{arity}"
        self.spark.udf.register(spark_name, made)
        kind = "string" if returns == "text" else returns
        self.functions[key] = Function(name, arity, kind, deterministic, null_propagating, description, spark_name)

    # --- statements
    def script(self, text: str, params: dict[str, object] | None = None) -> DataFrame | None:
        """Run the statements of a script in order; the last one's result."""
        out = None
        for statement in split(text):
            out = self.execute(statement, params)
        return out

    def execute(self, sql: str, params: dict[str, object] | None = None) -> DataFrame:
        """Run one statement; a query's rows, or rows_affected."""
        return self.run(parse(sql), params or {})

    def run(self, s: Node, params: dict[str, object]) -> DataFrame:
        if s.kind == "query":
            return self.select(s, params)
        return getattr(self, f"_{s.kind}")(s, params)

    def _done(self, n: int = 0) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "rows_affected long")

    def spark_sql(self, q: Node, params: dict[str, object]) -> str:
        return Emitter(self, params).query(q, Scope())

    def select(self, q: Node, params: dict[str, object]) -> DataFrame:
        kept, self._views = getattr(self, "_views", []), []
        try:
            return self.spark.sql(self.spark_sql(q, params))
        finally:
            for view in self._views:
                self.spark.catalog.dropTempView(view)
            self._views = kept

    def _over(self, table: Table, items: Callable[[Emitter, Scope], list[str]], where: Node | None, params: dict[str, object], rows: DataFrame | None = None) -> DataFrame:
        """SELECT items FROM table WHERE where, with the row's identity in reach."""
        kept, self._views = getattr(self, "_views", []), []
        try:
            emitter, scope = Emitter(self, params), Scope()
            view, columns = self.register_view(self.rows(table, True) if rows is None else rows)
            scope.add(table.name, columns)
            scope.no_windows = True
            found = ", ".join(items(emitter, scope))
            test = f" WHERE {emitter.truth(where, scope)}" if where else ""
            return self.spark.sql(f"SELECT {found} FROM {view} AS {name_of(table.name)}{test}")
        finally:
            for view in self._views:
                self.spark.catalog.dropTempView(view)
            self._views = kept

    def _if(self, s: Node, params: dict[str, object]) -> DataFrame:
        out = self._done()
        if bool(self.select(s.query, params).limit(1).count()) != s.negated:
            for inner in s.body:
                out = self.run(inner, params)
        return out

    # --- tables
    def _free(self, name: str, temp: bool = False) -> None:
        key = name.lower()
        taken = key in self.temp if temp else key in self.tables or key in self.views or key in self.external
        if taken or key.startswith("sys_"):
            raise SqlError(f"{name} exists already")

    def _create_table(self, s: Node, params: dict[str, object]) -> DataFrame:
        if s.quiet and (s.name.lower() in (self.temp if s.temp else self.tables)):
            return self._done()
        self._free(s.name, s.temp)
        columns: list[Column] = []
        for c in s.columns:
            if c.name.lower() == ROW or any(c.name.lower() == o.name.lower() for o in columns):
                raise SqlError(f"column {c.name} can't be added")
            columns.append(self._declared(c))
        table = Table(s.name, columns, temp=s.temp)
        for c in s.constraints:
            self._constrain(table, c)
        (self.temp if s.temp else self.tables)[s.name.lower()] = table
        self._changed(table)
        return self._done()

    def _declared(self, c: Node) -> Column:
        column = Column(c.name, c.type, c.nullable, c.identity, c.collation)
        if c.default is not None:
            column.default, column.has_default = self._plain(c.default, column), True
        return column

    def _plain(self, default: Node, column: Column) -> object:
        value = Emitter(self)._constant(default)
        return {"hex": value.hex()} if isinstance(value, bytes) else value if value is None or column.type[0] != "DECIMAL" else str(value)

    def _constrain(self, table: Table, c: Node) -> None:
        """Add a parsed constraint to a table's metadata."""
        used = {d["name"].lower() for d in (*table.keys, *table.checks, *table.foreign)}

        def named(kind: str) -> str:
            if c.name:
                if c.name.lower() in used:
                    raise SqlError(f"constraint {c.name} exists already")
                return c.name
            n = 1
            while f"{kind}_{table.name}_{n}".lower() in used:
                n += 1
            return f"{kind}_{table.name}_{n}"

        if c.kind == "check":
            self._over(table, lambda e, s: [e.truth(c.test, s)], None, {}).schema  # is it a condition over this table?
            table.checks.append({"name": named("ck"), "text": c.text})
        elif c.kind == "key":
            columns = [table.column(x).name for x in c.columns]
            if c.primary:
                if table.primary:
                    raise SqlError(f"{table.name} has a primary key already")
                for x in columns:
                    table.column(x).nullable = False
            table.keys.append({"name": named("pk" if c.primary else "uq"), "primary": c.primary, "columns": columns})
        else:
            parent = table if c.parent.lower() == table.name.lower() else self.find(c.parent)
            keys = [parent.column(k).name for k in c.keys] if c.keys else parent.primary
            if len(keys) != len(c.columns) or not any(set(map(str.lower, k["columns"])) == set(map(str.lower, keys)) for k in parent.keys):
                raise SqlError(f"{c.parent} has no key that {table.name} could refer to")
            columns = [table.column(x).name for x in c.columns]
            table.foreign.append({"name": named("fk"), "columns": columns, "parent": parent.name, "keys": keys, "delete": c.delete, "update": c.update})

    def _create_external(self, s: Node, params: dict[str, object]) -> DataFrame:
        if not (s.quiet and s.name.lower() in self.external):
            self._free(s.name)
            self.external[s.name.lower()] = {"name": s.name, "path": s.path}
            self._save()
        return self._done()

    def _create_index(self, s: Node, params: dict[str, object]) -> DataFrame:
        """Indexes are kept as metadata; a unique one is a constraint too."""
        if s.name.lower() in self.indexes:
            if s.quiet:
                return self._done()
            raise SqlError(f"{s.name} exists already")
        table = self.find(s.table)
        columns = [table.column(c).name for c, _ in s.columns]
        if s.unique and self._repeated(self.rows(table), columns):
            raise SqlError(f"{s.name}: rows of {table.name} are not unique")
        self.indexes[s.name.lower()] = {"name": s.name, "table": table.name, "columns": columns, "collations": [c for _, c in s.columns], "unique": s.unique}
        self._save()
        return self._done()

    def _create_view(self, s: Node, params: dict[str, object]) -> DataFrame:
        if not (s.quiet and s.name.lower() in self.views):
            self._free(s.name)
            self.select(s.query, {})
            self.views[s.name.lower()] = {"name": s.name, "text": s.text}
            self._save()
        return self._done()

    def _create_rule(self, s: Node, params: dict[str, object]) -> DataFrame:
        if s.name.lower() in self.rules:
            raise SqlError(f"{s.name} exists already")
        table = self.find(s.table)
        if s.column:
            table.column(s.column)
        self._over(table, lambda e, scope: [e.truth(s.test, scope)], None, {})
        self.rules[s.name.lower()] = {"name": s.name, "table": table.name, "column": s.column, "text": s.text, "message": s.message}
        self._save()
        return self._done()

    def _drop(self, s: Node, params: dict[str, object]) -> DataFrame:
        key = s.name.lower()
        place = self.views if s.what == "VIEW" else self.indexes if s.what == "INDEX" else self.external if s.external else self.temp if s.temp else self.tables
        if s.what == "TABLE" and not s.temp and not s.external and key in self.temp:
            place = self.temp
        if s.what == "TRIGGER" or key not in place:
            if s.quiet:
                return self._done()
            raise SqlError(f"no such {s.what.lower()}: {s.name}")
        if place is self.tables:
            others = [t.name for t in self.tables.values() if t.name.lower() != key and any(f["parent"].lower() == key for f in t.foreign)]
            if others:
                raise SqlError(f"{s.name} is referred to by {', '.join(others)}")
            self.indexes = {k: v for k, v in self.indexes.items() if v["table"].lower() != key}
            self.rules = {k: v for k, v in self.rules.items() if v["table"].lower() != key}
            self.stats.pop(key, None)
        del place[key]
        if place is not self.temp:
            self._save()
        return self._done()

    def _persist(self, s: Node, params: dict[str, object]) -> DataFrame:
        if s.name.lower() not in self.temp:
            raise SqlError(f"no such temporary table: {s.name}")
        self._free(s.target)
        old = self.temp[s.name.lower()]
        made = Table(**{**old.__dict__, "name": s.target, "temp": False, "paths": list(old.paths)})
        self.tables[s.target.lower()] = made
        self._changed(made)
        return self._done()

    def _alter(self, s: Node, params: dict[str, object]) -> DataFrame:
        table, a = self.find(s.table), s.args
        old = table.name.lower()
        if s.action == "add_constraint":
            self._constrain(table, a["constraint"])
            try:
                self._check(table, self.plain(table), None, self.plain(table))
            except SqlError:
                for kept in (table.keys, table.checks, table.foreign):
                    kept[:] = [d for d in kept if d["name"] != self._last(table, a["constraint"])]
                raise
        elif s.action == "add_column":
            column = self._declared(a["column"])
            if any(column.name.lower() == c.name.lower() for c in table.columns):
                raise SqlError(f"{table.name} has a column {column.name} already")
            if not column.nullable and column.default is None and self.rows(table).limit(1).count():
                raise SqlError(f"column {column.name} needs a default for the rows there are")
            df = self.plain(table).withColumn(column.name, F.expr(self._default_sql(column)))
            table.columns.append(column)
            self._rewrite(table, df)
            for c in a["constraints"]:
                self._constrain(table, c)
        elif s.action == "drop_column":
            column = table.column(a["name"])
            users = [d["name"] for d in (*table.keys, *table.foreign) if column.name in d["columns"]]
            users += [c["name"] for c in table.checks if re.search(rf"\b{re.escape(column.name)}\b", c["text"], re.I)]
            users += [i["name"] for i in self.indexes.values() if i["table"].lower() == old and column.name in i["columns"]]
            if users or len(table.columns) == 1:
                raise SqlError(f"column {column.name} is needed by {', '.join(users) or 'the table'}")
            df = self.plain(table).drop(column.name)
            table.columns.remove(column)
            self._rewrite(table, df)
        elif s.action in ("drop_constraint", "drop_primary_key"):
            gone = a["name"].lower() if "name" in a else next((k["name"].lower() for k in table.keys if k["primary"]), "")
            if not any(d["name"].lower() == gone for d in (*table.keys, *table.checks, *table.foreign)):
                raise SqlError(f"no such constraint on {table.name}")
            for kept in (table.keys, table.checks, table.foreign):
                kept[:] = [d for d in kept if d["name"].lower() != gone]
        elif s.action == "rename_table":
            self._free(a["to"], table.temp)
            place = self.temp if table.temp else self.tables
            place[a["to"].lower()] = place.pop(old)
            for t in self.tables.values():
                for f in t.foreign:
                    f["parent"] = a["to"] if f["parent"].lower() == old else f["parent"]
            for d in (*self.indexes.values(), *self.rules.values()):
                d["table"] = a["to"] if d["table"].lower() == old else d["table"]
            table.name = a["to"]
        elif s.action == "rename_column":
            column = table.column(a["name"])
            if any(c.name.lower() == a["to"].lower() for c in table.columns if c is not column):
                raise SqlError(f"{table.name} has a column {a['to']} already")
            df = self.plain(table).withColumnRenamed(column.name, a["to"])
            swap = lambda names: [a["to"] if n == column.name else n for n in names]
            for d in (*table.keys, *table.foreign):
                d["columns"] = swap(d["columns"])
            for t in self.tables.values():
                for f in t.foreign:
                    f["keys"] = swap(f["keys"]) if f["parent"].lower() == old else f["keys"]
            for i in self.indexes.values():
                i["columns"] = swap(i["columns"]) if i["table"].lower() == old else i["columns"]
            for c in table.checks:
                c["text"] = re.sub(rf"\b{re.escape(column.name)}\b", a["to"], c["text"], flags=re.I)
            column.name = a["to"]
            self._rewrite(table, df)
        elif s.action == "rename_index":
            if a["name"].lower() not in self.indexes or a["to"].lower() in self.indexes:
                raise SqlError(f"index {a['name']} can't be renamed")
            made = self.indexes.pop(a["name"].lower())
            self.indexes[a["to"].lower()] = made | {"name": a["to"]}
        elif s.action == "reseed":
            table.next_id = a["next"]
        else:
            column = table.column(a["name"])
            if s.action == "set_type":
                sql, _ = cast_sql(name_of(column.name), spark_type(column.type), a["type"])
                df = self.plain(table).withColumn(column.name, F.expr(sql))
                column.type = a["type"]
                self._rewrite(table, df)
            elif s.action == "set_default":
                column.has_default = a["default"] is not None
                column.default = self._plain(a["default"], column) if column.has_default else None
            elif s.action == "set_collation":
                column.collation = a["collation"]
            else:
                if not a["nullable"] and self.rows(table).filter(F.col(name_of(column.name)).isNull()).limit(1).count():
                    raise SqlError(f"column {column.name} holds NULLs")
                column.nullable = a["nullable"]
        self._changed(table)
        return self._done()

    @staticmethod
    def _last(table: Table, c: Node) -> str:
        return {"check": table.checks, "key": table.keys, "foreign": table.foreign}[c.kind][-1]["name"]

    # --- rows
    def _default_sql(self, column: Column) -> str:
        value = bytes.fromhex(column.default["hex"]) if isinstance(column.default, dict) else column.default
        return cast_sql(*literal(value), column.type)[0]

    def _write(self, table: Table, df: DataFrame) -> str:
        path = f"{self.root}/tables/{uuid.uuid4().hex}"
        kinds = [(c.name, spark_type(c.type)) for c in table.columns]
        df.select(ROW, *(F.col(name_of(c)).cast(k).alias(c) for c, k in kinds)).write.parquet(path)
        return path

    def _rewrite(self, table: Table, df: DataFrame) -> None:
        table.paths = [self._write(table, df)]

    @staticmethod
    def _repeated(df: DataFrame, columns: list[str]) -> bool:
        names = [name_of(c) for c in columns]
        return bool(df.dropna(subset=columns).groupBy(*names).count().filter("count > 1").limit(1).count())

    def _check(self, table: Table, rows: DataFrame, others: DataFrame | None, whole: DataFrame | None) -> None:
        """Raise if new rows break a constraint. others: the table's unchanged rows; whole: all rows if they are to be checked together."""
        rows = _collated(table, rows)
        others, whole = (df if df is None else _collated(table, df) for df in (others, whole))
        nulls = reduce(lambda a, b: a | b, (F.col(name_of(c.name)).isNull() for c in table.columns if not c.nullable), F.lit(False))
        if rows.filter(nulls).limit(1).count():
            raise SqlError(f"NULL in a column of {table.name} that takes none")
        for check in table.checks:
            test = parse(f"SELECT 1 WHERE {check['text']}").body.where
            bad = self._over(table, lambda e, s: [ROW], Node("not", of=test), {}, rows)  # noqa: B023
            if bad.limit(1).count():
                raise SqlError(f"CHECK constraint {check['name']} of {table.name} is broken")
        unique = [k["columns"] for k in table.keys] + [i["columns"] for i in self.indexes.values() if i["unique"] and i["table"].lower() == table.name.lower()]
        for columns in unique:
            same = rows.dropna(subset=columns)
            if others is not None:
                hit = same.join(others.select(*(F.col(name_of(c)).alias(f"_o{i}") for i, c in enumerate(columns))), reduce(lambda a, b: a & b, (F.col(name_of(c)) == F.col(f"_o{i}") for i, c in enumerate(columns))), "left_semi")
                if hit.limit(1).count():
                    raise SqlError(f"({', '.join(columns)}) of {table.name} is not unique")
            if self._repeated(same if whole is None else whole, columns):
                raise SqlError(f"({', '.join(columns)}) of {table.name} is not unique")
        for f in table.foreign:
            parent = rows if whole is None else whole
            if f["parent"].lower() != table.name.lower():
                parents = _collated(self.find(f["parent"]), self._staged_rows(self.find(f["parent"])))
            else:
                parents = parent if others is None else parent.unionByName(others)
            keys = parents.select(*(F.col(name_of(k)).alias(f"_p{i}") for i, k in enumerate(f["keys"])))
            on = reduce(lambda a, b: a & b, (F.col(name_of(c)) == F.col(f"_p{i}") for i, c in enumerate(f["columns"])))
            if rows.dropna(subset=f["columns"]).join(keys, on, "left_anti").limit(1).count():
                raise SqlError(f"FOREIGN KEY constraint {f['name']} of {table.name} is broken")

    def _staged_rows(self, table: Table) -> DataFrame:
        staged = getattr(self, "_staged", {})
        return staged[table.name.lower()] if table.name.lower() in staged else self.plain(table)

    def _insert(self, s: Node, params: dict[str, object]) -> DataFrame:
        table = self.find(s.table)
        names = [table.column(c).name for c in s.columns] if s.columns is not None else [c.name for c in table.columns]
        emitter, lines = Emitter(self, params), []
        for row in s.rows:
            if len(row) != len(names):
                raise SqlError(f"{len(names)} values are needed for {table.name}, not {len(row)}")
            given = dict(zip(names, row, strict=True))
            made = []
            for c in table.columns:
                e = given.get(c.name)
                if e is None or e.kind == "default":
                    sql = self._default_sql(c) if c.name != table.identity else f"CAST(NULL AS {spark_type(c.type)})"
                elif e.kind == "literal" and e.type == "real" and c.type[0] == "DECIMAL":
                    sql = cast_sql(f"'{e.value}'", "string", c.type)[0]
                else:
                    sql = cast_sql(*emitter.value(e, Scope()), c.type)[0]
                made.append(f"{sql} AS {name_of(c.name)}")
            lines.append("SELECT " + ", ".join(made))
        if not lines[0]:
            raise SqlError("nothing to insert")
        # VALUES is as long as the statement at most, so its rows pass through the driver
        found = [r for i in range(0, len(lines), 500) for r in self.spark.sql(" UNION ALL ".join(lines[i : i + 500])).collect()]
        at, rows = table.next_id, []
        for r in found:
            values = list(r)
            if table.identity:
                i = [c.name for c in table.columns].index(table.identity)
                values[i] = at if values[i] is None else values[i]
                row_id = values[i]
            else:
                row_id = at
            at = max(at, row_id + 1)
            rows.append((row_id, *values))
        new = self.spark.createDataFrame(rows, table.schema)
        self._check(table, new, self.plain(table), None)
        table.paths.append(self._write(table, new))
        table.next_id = at
        self._changed(table)
        return self._done(len(rows))

    def append(self, name: str, df: DataFrame, overwrite: bool = False) -> int:
        """Add a DataFrame's rows to a table, all or none, each value cast to its column's type.

        Columns that df lacks get their defaults; identities go up from the next one.
        """
        table, have = self.find(name), {c.lower(): c for c in df.columns}
        unknown = sorted(set(have) - {c.name.lower() for c in table.columns})
        if unknown:
            raise SqlError(f"{name} has no column {unknown[0]}")
        kinds = dict(df.dtypes)
        made = []
        for c in table.columns:
            if c.name.lower() in have:
                own = have[c.name.lower()]
                made.append(F.expr(cast_sql(name_of(own), kinds[own], c.type)[0]).alias(c.name))
            else:
                made.append(F.expr(self._default_sql(c)).alias(c.name))
        rows = df.select(*made)
        next_id = 1 if overwrite else table.next_id
        if table.identity and table.identity.lower() in have:
            rows = rows.select(F.col(name_of(table.identity)).cast("bigint").alias(ROW), "*")
        else:
            numbered = self._stored(rows.withColumn(ROW, F.monotonically_increasing_id()))
            # gaps between partitions are harmless: an identity only has to grow
            rows = numbered.withColumn(ROW, F.col(ROW) + next_id)
            if table.identity:
                rows = rows.withColumn(table.identity, F.col(ROW).cast(spark_type(table.column(table.identity).type)))
        rows = self._stored(rows.select(ROW, *(name_of(c.name) for c in table.columns)))
        n, top = rows.agg(F.count("*"), F.max(ROW)).first()
        if n:
            self._check(table, rows, None if overwrite else self.plain(table), rows if overwrite else None)
        path = self._write(table, rows)
        table.paths = [path] if overwrite else [*table.paths, path]
        table.next_id = max(next_id, (top or 0) + 1)
        self._changed(table)
        return n

    def _update(self, s: Node, params: dict[str, object]) -> DataFrame:
        table = self.find(s.table)
        sets = {table.column(n).name: e for n, e in s.sets}

        def items(emitter: Emitter, scope: Scope) -> list[str]:
            out = [ROW]
            for c in table.columns:
                out.append(name_of(c.name))
                if c.name in sets:
                    e = sets[c.name]
                    sql = cast_sql(f"'{e.value}'", "string", c.type) if e.kind == "literal" and e.type == "real" and c.type[0] == "DECIMAL" else cast_sql(*emitter.value(e, scope), c.type)
                    out.append(f"{sql[0]} AS {name_of('_set_' + c.name)}")
            return out

        hit = self._stored(self._over(table, items, s.where, params))
        n = hit.count()
        if n:
            # a whole-number key is the row's identity too
            row_id = F.col(name_of("_set_" + table.identity)).cast("bigint").alias(ROW) if table.identity in sets else F.col(ROW)
            new = hit.select(row_id, *(F.col(name_of("_set_" + c.name if c.name in sets else c.name)).alias(c.name) for c in table.columns))
            rest = self.plain(table).join(hit.select(ROW), ROW, "left_anti")
            self._staged = {table.name.lower(): rest.unionByName(new)}
            try:
                self._check(table, new, None, self._staged[table.name.lower()])
                for c, f in self._children(table):
                    moved = reduce(lambda a, b: a | b, (~F.col(name_of(k)).eqNullSafe(F.col(name_of("_set_" + k))) for k in f["keys"] if k in sets), F.lit(False))
                    if any(k in sets for k in f["keys"]):
                        gone = hit.filter(moved).select(*(F.col(name_of(k)).alias(f"_k{i}") for i, k in enumerate(f["keys"])), *(F.col(name_of("_set_" + k if k in sets else k)).alias(f"_n{i}") for i, k in enumerate(f["keys"])))
                        self._follow(c, f, f["update"], gone)
                self._commit()
            finally:
                self._staged = {}
        return self._done(n)

    def _delete(self, s: Node, params: dict[str, object]) -> DataFrame:
        table = self.find(s.table)
        gone = self._stored(self._over(table, lambda e, scope: [ROW, *(name_of(c.name) for c in table.columns)], s.where, params))
        n = gone.count()
        if n:
            self._staged = {}
            try:
                self._remove(table, gone)
                self._commit()
            finally:
                self._staged = {}
        return self._done(n)

    def _stored(self, df: DataFrame) -> DataFrame:
        """df written to the root and read again: what a statement found before it changes anything."""
        path = f"{self.root}/work/{uuid.uuid4().hex}"
        df = df.select(*(F.col(name_of(f.name)).cast("string").alias(f.name) if f.dataType.simpleString().startswith("string") else F.col(name_of(f.name)) for f in df.schema.fields))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _children(self, table: Table) -> list[tuple[Table, dict]]:
        place = [*self.tables.values(), *self.temp.values()]
        return [(t, f) for t in place for f in t.foreign if f["parent"].lower() == table.name.lower()]

    def _remove(self, table: Table, gone: DataFrame) -> None:
        """Stage a table without the rows `gone`, and what its foreign keys ask for."""
        self._staged[table.name.lower()] = self._staged_rows(table).join(gone.select(ROW), ROW, "left_anti")
        for child, f in self._children(table):
            keys = gone.select(*(F.col(name_of(k)).alias(f"_k{i}") for i, k in enumerate(f["keys"])))
            self._follow(child, f, f["delete"], keys)

    def _follow(self, child: Table, f: dict, action: str, keys: DataFrame) -> None:
        """Carry out a foreign key's action on the child's rows that refer to `keys` (_k0, ..)."""
        rows = self._staged_rows(child)
        on = reduce(lambda a, b: a & b, (F.col(name_of(c)) == F.col(f"_k{i}") for i, c in enumerate(f["columns"])))
        hit = self._stored(rows.join(keys, on, "left_semi"))
        if not hit.limit(1).count():
            return
        if action in ("RESTRICT", "NO ACTION"):
            raise SqlError(f"FOREIGN KEY constraint {f['name']} of {child.name} is broken")
        if action == "CASCADE" and "_n0" not in keys.columns:
            self._remove(child, hit)
            return
        if action == "CASCADE":
            changed = hit.join(keys, on).withColumns({c: F.col(f"_n{i}") for i, c in enumerate(f["columns"])}).select(*hit.columns)
        elif action == "SET NULL":
            changed = hit.withColumns({c: F.lit(None).cast(spark_type(child.column(c).type)) for c in f["columns"]})
        else:
            changed = hit.withColumns({c: F.expr(self._default_sql(child.column(c))) for c in f["columns"]})
        whole = rows.join(hit.select(ROW), ROW, "left_anti").unionByName(changed)
        self._staged[child.name.lower()] = whole
        self._check(child, changed, None, whole)

    def _commit(self) -> None:
        """Write all staged tables, then point the catalogue at them."""
        paths = {key: self._write(self.find(key), df) for key, df in self._staged.items()}
        for key, path in paths.items():
            table = self.find(key)
            table.paths, table.version = [path], table.version + 1
        if any(not self.find(key).temp for key in paths):
            self._save()

    # --- hygiene
    def _keyed(self, name: str, on: list[Node]) -> tuple[Table, DataFrame, list[str]]:
        table = self.find(name)
        keys = [f"_on{i}" for i in range(len(on))]
        items = lambda e, s: [ROW, *(name_of(c.name) for c in table.columns), *(f"{e.value(x, s)[0]} AS {k}" for x, k in zip(on, keys, strict=True))]
        return table, self._over(table, items, None, {}), keys

    def _find_duplicates(self, s: Node, params: dict[str, object]) -> DataFrame:
        table, df, keys = self._keyed(s.table, s.on)
        pk = table.primary
        df = df.withColumn("_pk", F.concat_ws(",", *(F.col(name_of(c)).cast("string") for c in pk)) if pk else F.lit(None).cast("string"))
        return H.find_duplicates(df, keys, ROW, "_pk")

    def _dedup(self, s: Node, params: dict[str, object]) -> DataFrame:
        table, df, keys = self._keyed(s.table, s.on)
        summary = H.dedup_summary(df, keys, ROW, table.name).first()
        kept = H.dedup(df, keys, ROW, s.keep)
        gone = self._stored(df.join(kept.select(ROW), ROW, "left_anti").drop(*keys))
        self._staged = {}
        try:
            self._remove(table, gone)
            self._commit()
        finally:
            self._staged = {}
        return self.spark.createDataFrame([tuple(summary)], "table_name string, duplicate_group_count long, rows_deleted long, rows_kept long")

    def _merge(self, s: Node, params: dict[str, object]) -> DataFrame:
        table, df, keys = self._keyed(s.table, s.on)
        df = self._stored(df)
        schema = "table_name string, duplicate_group_count long, rows_deleted long, rows_kept long, rows_updated long, merge_conflict_count long, merge_conflicts string"
        identity = [table.identity] if table.identity else []
        summary = H.merge_summary(df.drop(*identity), keys, ROW, table.name).first()
        merged = H.merge_duplicates(df.drop(*identity), keys, ROW)
        merged = merged.withColumns({c: F.col(ROW).cast(spark_type(table.column(c).type)) for c in identity}).select(ROW, *(name_of(c.name) for c in table.columns))
        gone = self._stored(df.join(merged.select(ROW), ROW, "left_anti").drop(*keys))
        self._staged = {}
        try:
            self._remove(table, gone)
            self._staged[table.name.lower()] = merged
            self._check(table, merged, None, merged)
            self._commit()
        finally:
            self._staged = {}
        return self.spark.createDataFrame([tuple(summary)], schema)

    def _validate(self, s: Node, params: dict[str, object]) -> DataFrame:
        table = self.find(s.table)
        rules = [r for r in self.rules.values() if r["table"].lower() == table.name.lower()]
        tests = [parse(f"SELECT 1 WHERE {r['text']}").body.where for r in rules]
        pk = table.primary
        key = "concat_ws(',', " + ", ".join(f"CAST({name_of(c)} AS STRING)" for c in pk) + ")" if pk else "CAST(NULL AS STRING)"
        df = self._over(table, lambda e, sc: [ROW, f"{key} AS _pk", *(f"{e.truth(t, sc)} AS _t{i}" for i, t in enumerate(tests))], None, {})
        if not rules:
            empty = "rule_name string, table_name string, column_name string, rowid long, primary_key string, message string"
            return self.spark.createDataFrame([], empty)
        return H.validate(df, [(r["name"], r["column"], f"_t{i}", r["message"]) for i, r in enumerate(rules)], ROW, table.name, "_pk")

    def _find_orphans(self, s: Node, params: dict[str, object]) -> DataFrame:
        child = self.find(s.child)
        pairs = []
        if s.parent:
            column = s.column or next((f["columns"][0] for f in child.foreign if f["parent"].lower() == s.parent.lower()), None)
            if column is None:
                raise SqlError("FIND ORPHANS needs the child's column")
            pairs.append((child.column(column).name, s.parent, s.key, None))
        for f in child.foreign if not s.parent else []:
            if len(f["columns"]) == 1 and (s.column is None or f["columns"][0].lower() == s.column.lower()):
                pairs.append((f["columns"][0], f["parent"], f["keys"][0], f["name"]))
        if not pairs:
            raise SqlError(f"{child.name} has no foreign key to check")
        rows = self.rows(child, True)
        return H.union_all([H.find_orphans(rows, c, self.frame(p), k, ROW, child.name, self.find(p).name, n) for c, p, k, n in pairs])

    # --- statistics and plans
    def _analyze(self, s: Node, params: dict[str, object]) -> DataFrame:
        for table in [self.find(s.table)] if s.table else list(self.tables.values()):
            df = self.rows(table)
            plain = [c.name for c in table.columns]
            columns = [r.asDict() for r in H.column_stats(df).collect()]
            hitters = {c: [r.asDict() for r in H.heavy_hitters(df, c).collect()] for c in plain}
            numeric = [c.name for c in table.columns if spark_type(c.type).split("(")[0] in ("smallint", "int", "bigint", "double", "decimal")]
            bars = {c: [[r["bucket"], str(r["low"]), str(r["high"]), r["row_count"]] for r in H.histogram(df, c).orderBy("bucket").collect()] for c in numeric}
            lists = {i["name"]: i["columns"] for i in self.indexes.values() if i["table"].lower() == table.name.lower() and len(i["columns"]) > 1}
            lists |= {k["name"]: k["columns"] for k in table.keys if len(k["columns"]) > 1}
            prefixes = {n: [[r["prefix"], r["distinct_count"]] for r in H.prefix_counts(df, cols).collect()] for n, cols in lists.items()}
            self.stats[table.name.lower()] = {"version": table.version, "rows": df.count(), "columns": columns, "hitters": hitters, "bars": bars, "prefixes": prefixes}
        self._save()
        return self._done()

    def _explain(self, s: Node, params: dict[str, object]) -> DataFrame:
        if s.target.kind != "query":
            if s.mode != "ANALYZE":
                raise SqlError("EXPLAIN of a change needs ANALYZE, which carries it out")
            done = self.run(s.target, params)
            return sysviews.explain_change(self, s.target.kind, done.first()["rows_affected"])
        df = self.select(s.target, params)
        return sysviews.estimate(df) if s.mode == "ESTIMATE" else sysviews.physical(df, s.mode == "ANALYZE")

    # --- saved statements
    def save_query(self, name: str, sql: str) -> None:
        parse(sql)
        stamp = pd.Timestamp.now("UTC").strftime("%Y-%m-%dT%H:%M:%SZ")
        before = self.saved.get(name.lower(), {})
        self.saved[name.lower()] = {"name": name, "sql": sql, "created": before.get("created", stamp), "updated": stamp, "id": before.get("id", len(self.saved) + 1)}
        self._save()

    def run_saved(self, name: str, params: dict[str, object] | None = None) -> DataFrame:
        """A saved statement, or procedure, with values for its parameters."""
        if name.lower() not in self.saved:
            raise SqlError(f"no saved query {name}")
        return self.execute(self.saved[name.lower()]["sql"], params)

    fingerprint = staticmethod(fingerprint)


def _collated(table: Table, df: DataFrame) -> DataFrame:
    """df of a table's columns, in which text columns compare by their declared collation."""
    made = {c.name: F.collate(F.col(name_of(c.name)), collation(c.collation)) for c in table.columns if c.collation and c.collation != "BINARY"}
    return df.withColumns(made) if made else df


def _typed_series(fn: Callable, arity: int) -> Callable:
    """fn with the type hints that tell a vectorised function of `arity` Series."""
    names = ", ".join(f"a{i}: pd.Series" for i in range(arity))
    space: dict[str, object] = {"pd": pd, "fn": fn}
    exec(f"def run({names}) -> pd.Series:\n    return fn({', '.join(f'a{i}' for i in range(arity))})", space)  # noqa: S102
    return space["run"]
