"""The catalogue's views, and plans as rows."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame

from skerry.sql.emit import AGGREGATES, SCALARS

MAX_NODES, MAX_TEXT = 500, 512
_SIZED = ("DECIMAL", "CHAR", "VARCHAR", "BINARY", "VARBINARY", "TIME", "DATETIME2", "DATETIMEOFFSET", "BIT", "VARBIT")


def _type(kind: tuple[str, list[int]]) -> str:
    return f"{kind[0]}({','.join(map(str, kind[1]))})" if kind[1] and kind[0] in _SIZED else kind[0]


def _tables(engine: object) -> list[tuple]:
    return [(t.name, len(t.columns), t.primary[0] if len(t.primary) == 1 else None) for t in engine.tables.values()]


def _columns(tables: dict) -> list[tuple]:
    return [
        (t.name, c.name, i, _type(c.type), int(c.nullable), int(c.name in t.primary), int(c.identity or c.name == t.identity), int(c.type[0] == "ROWVERSION"), c.collation)
        for t in tables.values()
        for i, c in enumerate(t.columns, 1)
    ]


def _indexes(engine: object) -> list[tuple]:
    return [
        (x["name"], x["table"], c, i, int(x["unique"]), how)
        for x in engine.indexes.values()
        for i, (c, how) in enumerate(zip(x["columns"], x["collations"], strict=True), 1)
    ]


def _foreign(engine: object) -> list[tuple]:
    return [
        (f["name"], t.name, c, f["parent"], k, f["delete"], f["update"])
        for t in engine.tables.values()
        for f in t.foreign
        for c, k in zip(f["columns"], f["keys"], strict=True)
    ]


def _objects(engine: object) -> list[tuple]:
    out = [(t.name, "TABLE", None) for t in engine.tables.values()]
    out += [(x["name"], "INDEX", x["table"]) for x in engine.indexes.values()]
    out += [(v["name"], "VIEW", None) for v in engine.views.values()]
    out += [(f["name"], "FOREIGN KEY", t.name) for t in engine.tables.values() for f in t.foreign]
    out += [(k["name"], "PRIMARY KEY" if k["primary"] else "UNIQUE", t.name) for t in engine.tables.values() for k in t.keys]
    return out + [(c["name"], "CHECK", t.name) for t in engine.tables.values() for c in t.checks]


def _functions(engine: object) -> list[tuple]:
    names = {"string": "TEXT", "int": "INTEGER", "bigint": "BIGINT", "double": "REAL", None: "ANY"}
    moving = {"DATE", "TIME", "NOW"}
    own_null = {"TEXT", "NZ", "ISNULL", "ISEMPTY", "IIF", "SWITCH", "CHOOSE", "COALESCE", "IFNULL", "NULLIF", "VAL", "CSTR"}
    out = []
    for name, (canonical, least, most, kind) in SCALARS.items():
        arity = str(least) if least == most else f"{least}..{'n' if most == 99 else most}"
        null = "custom" if canonical in own_null else "propagates"
        out.append((name, canonical, f"{canonical}({arity})", "SCALAR", "BIGINT" if canonical == "LEN" else names[kind], null, "statementstable" if canonical in moving else "immutable", int(canonical not in moving), 1))
    out += [(n, n, f"{n}(1)", "AGGREGATE", "BIGINT" if n == "COUNT" else "ANY", "skips", "immutable", 1, 1) for n in sorted(AGGREGATES)]
    out += [(n, n, f"{n}()", "WINDOW", "ANY", "custom", "immutable", 1, 1) for n in ("DENSE_RANK", "FIRST_VALUE", "LAG", "LAST_VALUE", "LEAD", "RANK", "ROW_NUMBER")]
    for f in engine.functions.values():
        out.append((f.name, f.name, f"{f.name}({f.arity})", "SCALAR", names.get(f.type, f.type.upper()), "propagates" if f.null_propagating else "custom", "immutable" if f.deterministic else "volatile", int(f.deterministic), 0))
    return out


def _stats(engine: object) -> list[tuple]:
    out = []
    for key, s in engine.stats.items():
        table, stale = engine.tables.get(key), False
        if table:
            stale = table.version != s["version"]
            out.append((table.name, engine.rows(table).count() if stale else s["rows"], 1, int(stale)))
    return out


def _column_stats(engine: object) -> list[tuple]:
    out = []
    for key, s in engine.stats.items():
        if table := engine.tables.get(key):
            places = {c.name: i for i, c in enumerate(table.columns, 1)}
            for c in s["columns"]:
                out.append((table.name, c["column_name"], places.get(c["column_name"]), c["distinct_count"], c["non_null_count"], c["min_value"], c["max_value"], int(table.version != s["version"])))
    return out


def _hitters(engine: object) -> list[tuple]:
    return [
        (engine.tables[key].name, column, h["value"], h["row_count"], h["frequency_ppm"], int(engine.tables[key].version != s["version"]))
        for key, s in engine.stats.items()
        if key in engine.tables
        for column, found in s["hitters"].items()
        for h in found
    ]


def _analyzed(engine: object) -> list[tuple]:
    """(table's name, its statistics, whether they are stale)."""
    return [(engine.tables[k].name, s, int(engine.tables[k].version != s["version"])) for k, s in engine.stats.items() if k in engine.tables]


def _histograms(engine: object) -> list[tuple]:
    return [(t, c, *bar, stale) for t, s, stale in _analyzed(engine) for c, bars in s["bars"].items() for bar in bars]


def _prefixes(engine: object) -> list[tuple]:
    return [(t, i, columns, n, stale) for t, s, stale in _analyzed(engine) for i, found in s["prefixes"].items() for columns, n in found]


_VIEWS = {
    "tables": ("table_name string, column_count int, primary_key_column string", _tables),
    "columns": ("table_name string, column_name string, ordinal_position int, data_type string, is_nullable int, is_primary_key int, is_identity int, is_row_version int, collation string", lambda e: _columns(e.tables)),
    "temp_tables": ("table_name string, column_count int", lambda e: [(t.name, len(t.columns)) for t in e.temp.values()]),
    "temp_columns": ("table_name string, column_name string, ordinal_position int, data_type string, is_nullable int, is_primary_key int, is_identity int, is_row_version int, collation string", lambda e: _columns(e.temp)),
    "indexes": ("index_name string, table_name string, column_name string, ordinal_position int, is_unique int, collation string", _indexes),
    "views": ("view_name string, sql string", lambda e: [(v["name"], v["text"]) for v in e.views.values()]),
    "triggers": ("trigger_name string, table_name string, timing string, event string, body_sql string", lambda e: []),
    "objects": ("object_name string, object_type string, parent_table_name string", _objects),
    "foreign_keys": ("constraint_name string, table_name string, column_name string, referenced_table_name string, referenced_column_name string, on_delete string, on_update string", _foreign),
    "key_constraints": ("constraint_name string, table_name string, constraint_kind string, column_name string, ordinal_position int", lambda e: [(k["name"], t.name, "PRIMARY KEY" if k["primary"] else "UNIQUE", c, i) for t in e.tables.values() for k in t.keys for i, c in enumerate(k["columns"], 1)]),
    "check_constraints": ("constraint_name string, table_name string, expression string", lambda e: [(c["name"], t.name, c["text"]) for t in e.tables.values() for c in t.checks]),
    "functions": ("function_name string, canonical_name string, signature string, function_kind string, return_type string, null_behavior string, volatility string, is_deterministic int, is_builtin int", _functions),
    "external_tables": ("table_name string, path string", lambda e: [(x["name"], x["path"]) for x in e.external.values()]),
    "validation_rules": ("rule_name string, table_name string, column_name string, expression string, message string", lambda e: [(r["name"], r["table"], r["column"], r["text"], r["message"]) for r in e.rules.values()]),
    "saved_queries": ("id int, name string, sql_text string, created_utc string, updated_utc string", lambda e: [(q["id"], q["name"], q["sql"], q["created"], q["updated"]) for q in e.saved.values()]),
    "table_stats": ("table_name string, row_count long, row_count_is_exact int, has_stale_columns int", _stats),
    "column_stats": ("table_name string, column_name string, ordinal_position int, distinct_count long, non_null_count long, min_value string, max_value string, is_stale int", _column_stats),
    "planner_histograms": ("table_name string, column_name string, bucket int, low string, high string, row_count long, is_stale int", _histograms),
    "planner_index_prefix_stats": ("table_name string, index_name string, columns string, distinct_count long, is_stale int", _prefixes),
    "planner_heavy_hitters": ("table_name string, column_name string, value string, row_count long, frequency_ppm long, is_stale int", _hitters),
}


def view(engine: object, name: str) -> DataFrame:
    from skerry.sql.lexer import SqlError

    if name not in _VIEWS:
        raise SqlError(f"no such table: sys.{name}")
    schema, make = _VIEWS[name]
    return engine.spark.createDataFrame(make(engine), schema)


_PLAN = (
    "node_id int, parent_node_id int, operator_type string, estimated_rows long, estimated_cost double, actual_rows long, actual_loops long, elapsed_microseconds long, "
    "access_path string, object_name string, index_name string, join_type string, predicate string, status string, diagnostic_code string"
)
_LINE = re.compile(r"^(?P<edge>[ :|+-]*)(?:\*\(\d+\) )?(?P<name>[A-Z]\w*)(?P<rest>.*)$")
_LITERALS = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w#])[+-]?\d+(?:\.\d+)?(?![\w#])")


def _snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def redacted(text: str) -> str:
    """A predicate without the values of its literals."""
    return _LITERALS.sub("?", re.sub(r"((?:=|<|>|StartsWith|Contains|EndsWith|LIKE)\s*)[^\s(),]+(?=[),])", lambda m: m[1] + ("?" if "#" not in m[0] else m[0][len(m[1]) :]), text))[:MAX_TEXT]


def _nodes(text: str) -> list[tuple[int, str, str]]:
    """(depth, name, rest) of the operators of a plan's text."""
    out = []
    for line in text.splitlines():
        m = _LINE.match(line)
        if m and not line.startswith("=="):
            out.append((len(m["edge"]) // 3, m["name"], m["rest"]))
    return out


def _text(df: DataFrame, mode: str) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def physical(df: DataFrame, analyze: bool) -> DataFrame:
    """The physical plan as rows, at most MAX_NODES; analyze runs it once and adds what it took."""
    text = df._jdf.queryExecution().executedPlan().toString()
    rows, parents, actual, took = [], [], None, None
    if analyze:
        began = time.time()
        actual = df.count()
        took = int((time.time() - began) * 1e6)
    found = [n for n in _nodes(text) if n[1] != "AdaptiveSparkPlan"]
    for i, (depth, name, rest) in enumerate(found[:MAX_NODES]):
        while parents and parents[-1][0] >= depth:
            parents.pop()
        parent = parents[-1][1] if parents else None
        parents.append((depth, i))
        join = re.search(r"\b(Inner|LeftOuter|RightOuter|LeftSemi|LeftAnti|Cross|ExistenceJoin)\b", rest) if "Join" in name else None
        scan = "Scan" in name
        test = re.search(r"^ \((.*)\)$", rest) if name == "Filter" else None
        where = re.search(r"(?:InMemoryFileIndex\([^)]*\)\[([^\]]*)\])", rest)
        root = i == 0 and analyze
        rows.append((
            i, parent, _snake(name), None, None, actual if root else None, 1 if root else None, took if root else None, "table_scan" if scan else None,
            (where[1].rsplit("/", 1)[-1][:MAX_TEXT] if where else None) if scan else None, None, _snake(join[1]) if join else None, redacted(test[1]) if test else None,
            "executed" if analyze else "planned", None,
        ))
    if len(found) > MAX_NODES:
        last = rows[-1]
        rows[-1] = (*last[:13], last[13], "plan_truncated")
    return df.sparkSession.createDataFrame(rows, _PLAN)


def explain_change(engine: object, kind: str, n: int) -> DataFrame:
    return engine.spark.createDataFrame([(0, None, kind, None, None, n, 1, None, None, None, None, None, None, "executed", None)], _PLAN)


def estimate(df: DataFrame) -> DataFrame:
    """What Spark's optimiser expects of a query's steps, which are not run."""
    text = _text(df, "cost").split("== Physical Plan ==")[0]
    rows = [(0, None, "statement", None, "diagnostic-only", None, None, "optimizer", "not_executed", None)]
    for i, (_, name, rest) in enumerate(_nodes(text)[: MAX_NODES - 1], 1):
        size = re.search(r"sizeInBytes=([\d.E+]+) ?(\w*)", rest)
        count = re.search(r"rowCount=([\d.E+]+)", rest)
        units = {"B": 1, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30, "TiB": 2**40, "PiB": 2**50, "EiB": 2**60}
        cost = float(size[1]) * units.get(size[2], 1) if size else None
        kind = {"Filter": "filter", "Relation": "access_path", "LogicalRDD": "access_path", "Join": "join"}.get(name, _snake(name))
        rows.append((i, 0, kind, None, "estimate", int(float(count[1])) if count else None, cost, "statistics" if count else "size", "not_executed", redacted(rest.split("Statistics")[0].strip(" ,")) or None))
    schema = "node_id int, parent_node_id int, node_kind string, target string, decision string, estimated_rows long, estimated_cost double, stats_source string, stats_state string, detail string"
    return df.sparkSession.createDataFrame(rows, schema)


__all__ = ["estimate", "explain_change", "physical", "redacted", "view"]
