"""Pipeline packages: JSON in and out, validation, and runs with modes, metrics, rejects and hooks.

A run is one distributed plan from source to destination. Its rows are written
to a new place first and appended in one step, so a run that fails has written
nothing, and resuming it means running it again; a run that has succeeded is not
repeated. Batches are therefore a measure only (rows read by batch size).
"""

from __future__ import annotations

import datetime
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import pipeline as P
from skerry.sources import files
from skerry.streaming.incremental import since

SOURCES, DESTINATIONS = ("csvFile", "jsonFile", "table", "sqlQuery"), ("table", "csvFile", "jsonFile")
TRANSFORMS = ("select", "rename", "cast", "filter", "derive", "deduplicate")
EVENTS = ("onRunStarted", "onBatchCompleted", "onRunSucceeded", "onRunFailed")
MODES = ("validate", "dryRun", "run", "resume")
_CALL = re.compile(r"\s*([A-Za-z_]\w*)\s*\((.*)\)\s*", re.S)
_POSITION = "_position"


def load(text: str) -> dict:
    """A package from JSON; keys and kinds are told apart without regard to case."""
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("a package is a JSON object")
    return _cased(found)


def dump(package: dict) -> str:
    return json.dumps(package, indent=2)


_NAMES = (
    "name version description source transforms destination options incremental hooks kind path tableName queryText hasHeaderRow overwrite selectColumns renameMappings castMappings "
    "filterExpression derivedColumns deduplicateKeys target column targetType expression batchSize errorMode checkpointInterval maxRejects watermarkColumn lastProcessedValue event commandName arguments stopOnFailure"
).split()


def _cased(value: object, inside: str = "") -> object:
    known = {n.lower(): n for n in _NAMES}
    if isinstance(value, dict) and inside != "arguments":
        return {known.get(k.lower(), k): _cased(v, known.get(k.lower(), k)) for k, v in value.items()}
    if isinstance(value, list):
        return [_cased(v, inside) for v in value]
    if isinstance(value, str) and inside in ("kind", "event", "errorMode"):
        kinds = {k.lower(): k for k in (*SOURCES, *DESTINATIONS, *TRANSFORMS, *EVENTS, "failFast", "skipBadRows")}
        return kinds.get(value.lower(), value)
    return value


def validate(package: dict, functions: dict[tuple[str, int], object] | None = None) -> list[tuple[str, str]]:
    """(code, path) of everything that is wrong with a package."""
    out: list[tuple[str, str]] = []
    blank = lambda d, key: not str(d.get(key) or "").strip()

    def need(bad: bool, code: str, path: str) -> None:
        if bad:
            out.append((f"pipeline.{code}", path))

    source, target, options = package.get("source") or {}, package.get("destination") or {}, package.get("options") or {}
    need(blank(package, "name"), "name.required", "name")
    need(blank(package, "version"), "version.required", "version")
    kind = source.get("kind")
    need(kind not in SOURCES, "source.kind.unsupported", "source.kind")
    need(kind in ("csvFile", "jsonFile") and blank(source, "path"), "source.path.required", "source.path")
    need(kind == "table" and blank(source, "tableName"), "source.table.required", "source.tableName")
    need(kind == "sqlQuery" and blank(source, "queryText"), "source.query.required", "source.queryText")
    kind = target.get("kind")
    need(kind not in DESTINATIONS, "destination.kind.unsupported", "destination.kind")
    need(kind == "table" and blank(target, "tableName"), "destination.table.required", "destination.tableName")
    need(kind in ("csvFile", "jsonFile") and blank(target, "path"), "destination.path.required", "destination.path")
    need(options.get("batchSize", 1000) <= 0, "options.batchSize.invalid", "options.batchSize")
    need(options.get("checkpointInterval", 1000) <= 0, "options.checkpointInterval.invalid", "options.checkpointInterval")
    need(options.get("maxRejects", 0) < 0, "options.maxRejects.invalid", "options.maxRejects")
    need(package.get("incremental") is not None and blank(package["incremental"], "watermarkColumn"), "incremental.watermark.required", "incremental.watermarkColumn")
    for i, t in enumerate(package.get("transforms") or []):
        path, kind = f"transforms[{i}]", t.get("kind")
        need(kind not in TRANSFORMS, "transform.kind.unsupported", f"{path}.kind")
        need(kind == "select" and not t.get("selectColumns"), "transform.select.columns.required", f"{path}.selectColumns")
        need(kind == "rename" and not t.get("renameMappings"), "transform.rename.mappings.required", f"{path}.renameMappings")
        for j, m in enumerate(t.get("renameMappings") or []):
            need(blank(m, "source") or blank(m, "target"), "transform.rename.mapping.invalid", f"{path}.renameMappings[{j}]")
        need(kind == "cast" and not t.get("castMappings"), "transform.cast.mappings.required", f"{path}.castMappings")
        for j, m in enumerate(t.get("castMappings") or []):
            need(blank(m, "column"), "transform.cast.column.required", f"{path}.castMappings[{j}].column")
        need(kind == "filter" and blank(t, "filterExpression"), "transform.filter.expression.required", f"{path}.filterExpression")
        need(kind == "derive" and not t.get("derivedColumns"), "transform.derive.columns.required", f"{path}.derivedColumns")
        for j, m in enumerate(t.get("derivedColumns") or []):
            need(blank(m, "name") or blank(m, "expression"), "transform.derive.column.invalid", f"{path}.derivedColumns[{j}]")
            if (call := _CALL.fullmatch(m.get("expression") or "")) and functions is not None:
                known = (call[1].upper(), len(_arguments(call[2]))) in functions
                need(not known, "expression.function.unknown", f"{path}.derivedColumns[{j}].expression")
        need(kind == "deduplicate" and not t.get("deduplicateKeys"), "transform.deduplicate.keys.required", f"{path}.deduplicateKeys")
    for i, h in enumerate(package.get("hooks") or []):
        need(h.get("event") not in EVENTS, "hook.event.unsupported", f"hooks[{i}].event")
        need(blank(h, "commandName"), "hook.command.required", f"hooks[{i}].commandName")
        need(any(not k.strip() for k in h.get("arguments") or {}), "hook.argument.name.required", f"hooks[{i}].arguments")
    return out


def _arguments(text: str) -> list[str]:
    """The comma-separated arguments of a call; commas in quotes or brackets don't count."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [a.strip() for a in (*out, text[start:])] if text.strip() else []


@dataclass
class Result:
    run_id: str
    package: str
    mode: str
    status: str = "running"
    rows_read: int = 0
    rows_written: int = 0
    rows_rejected: int = 0
    batches_completed: int = 0
    error: str | None = None
    started: str = ""
    completed: str = ""
    rejects: DataFrame | None = field(default=None, repr=False)
    preview: DataFrame | None = field(default=None, repr=False)


_LOG = "run_id string, package string, mode string, status string, rows_read long, rows_written long, rows_rejected long, batches_completed long, error string, started string, completed string"


class Runner:
    """Runs packages. engine: its tables, queries and functions; state: a folder for the log and rejects.

    commands: host functions that hooks name; they get the event, the Result so
    far and the hook's arguments.
    """

    def __init__(self, spark: SparkSession, engine: object, state: str, commands: dict[str, Callable] | None = None) -> None:
        self.spark, self.engine, self.state = spark, engine, state
        self.commands = {k.lower(): v for k, v in (commands or {}).items()}

    # --- the parts of a package
    def source(self, s: dict) -> DataFrame:
        if s["kind"] == "csvFile":
            return files.read_csv(self.spark, s["path"], s.get("hasHeaderRow", True))
        if s["kind"] == "jsonFile":
            return files.read_json(self.spark, s["path"])
        return self.engine.frame(s["tableName"]) if s["kind"] == "table" else self.engine.execute(s["queryText"])

    def expression(self, df: DataFrame, text: str) -> Column:
        """A derived column: a column, a literal, or a call of one of the engine's functions."""
        if call := _CALL.fullmatch(text):
            args = _arguments(call[2])
            own = self.engine.functions.get((call[1].upper(), len(args)))
            if own is None:
                raise ValueError(f"unknown function {call[1]} of {len(args)} arguments")
            return F.call_function(own.spark_name, *(self.expression(df, a) for a in args))
        return P._literal(text, df)[0]

    def transform(self, df: DataFrame, t: dict) -> tuple[DataFrame, DataFrame | None]:
        """df after a transform, and the rows that it can't be done for."""
        kind = t["kind"]
        if kind == "select":
            return P.select(df, [*t["selectColumns"], _POSITION]), None
        if kind == "rename":
            return P.rename(df, {m["source"]: m["target"] for m in t["renameMappings"]}), None
        if kind == "filter":
            return P.filter_rows(df, t["filterExpression"]), None
        if kind == "deduplicate":
            return P.deduplicate(df, {"keys": t["deduplicateKeys"], "by": _POSITION}), None
        if kind == "derive":
            for m in t["derivedColumns"]:
                df = df.withColumn(m["name"], self.expression(df, m["expression"]))
            return df, None
        kinds = {m["column"]: m["targetType"] for m in t["castMappings"]}
        failed = F.lit(False)
        for c, k in kinds.items():
            failed = failed | (F.col(c).isNotNull() & F.col(c).try_cast(P.TYPES.get(k.lower(), k)).isNull())
        shown = F.to_json(F.struct(*(c for c in df.columns if c != _POSITION)))
        bad = df.filter(failed).select(F.col(_POSITION).alias("row_number"), shown.alias("row"), F.lit(f"cast of {', '.join(kinds)}").alias("reason"))
        return P.cast(df.filter(~failed), kinds), bad

    # --- runs
    def run(self, package: dict | str, mode: str = "run", run_id: str | None = None) -> Result:
        package = load(package) if isinstance(package, str) else _cased(package)
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        if mode == "resume" and run_id is None:
            raise ValueError("resume needs the run's id")
        faults = validate(package, self.engine.functions)
        if faults:
            raise ValueError("; ".join(f"{code} ({path})" for code, path in faults))
        out = Result(run_id or uuid.uuid4().hex, package["name"], mode, started=_now())
        if mode == "resume":
            before = self.log().filter((F.col("run_id") == out.run_id) & (F.col("status") == "succeeded") & F.col("mode").isin("run", "resume"))
            if before.limit(1).count():
                out.status, out.completed = "succeeded", _now()
                return out
        try:
            if mode != "validate":
                self._hooks(package, "onRunStarted", out)
                self._carry_out(package, mode, out)
                self._hooks(package, "onBatchCompleted", out)
            out.status = "succeeded"
            if mode != "validate":
                self._hooks(package, "onRunSucceeded", out)
        except Exception as fault:
            out.status, out.error = "failed", str(fault)[:2000]
            self._hooks(package, "onRunFailed", out)
            raise
        finally:
            out.completed = _now()
            row = (out.run_id, out.package, out.mode, out.status, out.rows_read, out.rows_written, out.rows_rejected, out.batches_completed, out.error, out.started, out.completed)
            self.spark.createDataFrame([row], _LOG).coalesce(1).write.mode("append").parquet(f"{self.state}/runs")
        return out

    def log(self) -> DataFrame:
        """A row for each run."""
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.state}/runs")
        except Exception as fault:
            if "PATH_NOT_FOUND" not in str(fault):
                raise
            return self.spark.createDataFrame([], _LOG)

    def _hooks(self, package: dict, event: str, out: Result) -> None:
        for h in package.get("hooks") or []:
            if h["event"] != event:
                continue
            try:
                if h["commandName"].lower() not in self.commands:
                    raise ValueError(f"unknown command {h['commandName']}")
                self.commands[h["commandName"].lower()](event, out, h.get("arguments") or {})
            except Exception:
                if h.get("stopOnFailure", True) and event != "onRunFailed":
                    raise

    def _carry_out(self, package: dict, mode: str, out: Result) -> None:
        options, target = package.get("options") or {}, package["destination"]
        df = self.source(package["source"])
        if step := package.get("incremental"):
            df = since(df, step["watermarkColumn"], step.get("lastProcessedValue"))
        df = df.withColumn(_POSITION, F.monotonically_increasing_id())
        # stored once, so that rows, rejects and counts are of the same reading
        place = f"{self.state}/work/{out.run_id}-{uuid.uuid4().hex}"
        df.write.parquet(f"{place}/source")
        source = self.spark.read.schema(df.schema).parquet(f"{place}/source")
        good, bad = source, []
        for t in package.get("transforms") or []:
            good, lost = self.transform(good, t)
            bad += [lost] if lost is not None else []
        rejects = bad[0] if bad else self.spark.createDataFrame([], "row_number long, row string, reason string")
        for more in bad[1:]:
            rejects = rejects.union(more)
        size = options.get("batchSize", 1000)
        out.rows_read = source.count()
        out.batches_completed = -(-out.rows_read // size)
        if options.get("errorMode", "failFast") != "skipBadRows":
            if first := rejects.orderBy("row_number").first():
                nth = source.filter(F.col(_POSITION) < first["row_number"]).count()
                raise ValueError(f"row {nth + 1} of batch {nth // size + 1}: {first['reason']}")
        rejects.write.parquet(f"{place}/rejects")
        out.rejects = self.spark.read.schema(rejects.schema).parquet(f"{place}/rejects")
        out.rows_rejected = out.rejects.count()
        if 0 < options.get("maxRejects", 0) < out.rows_rejected:
            raise ValueError(f"{out.rows_rejected} rows were rejected, more than {options['maxRejects']}")
        good = good.drop(_POSITION)
        if mode == "dryRun":
            out.preview = good
            return
        good.write.parquet(f"{place}/good")
        good = self.spark.read.schema(good.schema).parquet(f"{place}/good")
        out.rows_written = good.count()
        if target["kind"] == "csvFile":
            files.write_csv(good, target["path"])
        elif target["kind"] == "jsonFile":
            files.write_json(good, target["path"])
        else:
            self.engine.append(target["tableName"], good, target.get("overwrite", False))


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
