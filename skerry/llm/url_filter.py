"""URL filter rules: a trie over reversed host labels and path segments."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm._store import materialise, small

_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_URL = re.compile(r"://([^/?#]*)([^?#]*)")
#: Rules that a trie may hold; more are matched by a join.
TRIE_RULES = 100_000


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without '://'."""
    m = _URL.search(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def split_rule(rule: str) -> tuple[str, str]:
    """A rule is a host and the path that begins at its first '/'."""
    host, slash, path = rule.partition("/")
    return host.translate(_UPPER), slash + path


class Trie:
    """Longest-match rules: the deepest host first, then the longest path.

    Each host node has a second trie, of path segments. A rule's last segment
    may be the beginning of a url's ('/en' fits '/english'), so the rules that
    end below a segment node are kept there by what they ask of the next, with
    the lengths that occur: a segment's prefixes of those lengths are looked up.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]) -> None:
        self.root: dict = {}
        for verdict, rule in rules:
            host, path = split_rule(rule)
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(("label", label), {})
            *whole, last = path.split("/")
            node = node.setdefault(("paths",), {})
            for segment in whole:
                node = node.setdefault(("segment", segment), {})
            lengths, ends = node.setdefault(("ends",), (set(), {}))
            lengths.add(len(last))
            # of equal rules block holds, then the greater text
            ends[last] = max(ends.get(last, (rule, verdict)), (rule, verdict), key=lambda e: (e[1] == "block", e[0]))

    @staticmethod
    def _path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        found = None
        for segment in segments:
            lengths, ends = node.get(("ends",), ((), {}))
            n = max((n for n in lengths if n <= len(segment) and segment[:n] in ends), default=-1)
            if n >= 0:
                found = ends[segment[:n]]
            node = node.get(("segment", segment))
            if node is None:
                break
        return found

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, or None."""
        segments, node, found = path.split("/"), self.root, None
        for label in [None, *reversed(host.split("."))]:
            node = node if label is None else node.get(("label", label))
            if node is None:
                break
            if ("paths",) in node:
                found = self._path(node[("paths",)], segments) or found
        return found


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict by equi-joins, for rule sets past the trie's bound.

    A url asks for each of its host's suffixes and, under those that have rules,
    for its path's prefixes of the lengths that these rules have.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("host", "path", F.explode(F.array_distinct(F.concat(suffixes, F.array(F.lit(""))))).alias("rule_host"))
    lengths = materialise(rules.select("rule_host", F.length("rule_path").alias("n")).distinct())
    prefixes = asked.join(small(lengths), "rule_host").filter(F.length("path") >= F.col("n"))
    prefixes = prefixes.withColumn("rule_path", F.substring("path", F.lit(1), F.col("n")))
    fits = prefixes.join(small(rules), ["rule_host", "rule_path"])
    order = F.struct(F.length("rule_host"), F.length("rule_path"), F.col("verdict") == "block", "rule", "verdict")
    return fits.groupBy("host", "path").agg(F.max(order).alias("o")).select("host", "path", "o.rule", "o.verdict")


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    trie_rules: int = TRIE_RULES,
) -> DataFrame:
    """id, host, path, rule, verdict of every row.

    rules: (verdict, 'host/path') with verdict 'allow' or 'block'. A rule fits
    its host and all subdomains if the url's path starts with the rule's. The
    rule with the longest host wins, then that with the longest path, then
    block. Without a rule the verdict is `default` and rule is null.

    Null urls and those without '://' have an empty host and path, which only a
    rule without host and path fits. Repeated rows are judged each; null ids are
    kept; other columns are ignored; urls may be of any length. An empty table
    gives an empty result.

    The trie is broadcast as long as there are at most `trie_rules` rules (some
    100 MB in a Python worker); beyond that rules are joined on host suffixes and
    path prefixes, with the same result.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    id_type = rows.schema["id"].dataType.simpleString()
    if len(rules) > trie_rules:
        table = pages.sparkSession.createDataFrame(
            [(*split_rule(r), r, v) for v, r in rules], "rule_host string, rule_path string, rule string, verdict string"
        )
        split = materialise(_split(rows, id_type))
        best = materialise(_by_join(split.select("host", "path").distinct(), materialise(table)))
        out = split.join(small(best), ["host", "path"], "left")
        return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    shared = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            found = [trie.match(*p) or (None, default) for p in parts]
            columns = [batch.column("id"), *(pa.array(list(c), pa.string()) for c in zip(*parts, strict=True))] if parts else []
            if columns:
                columns += [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "host", "path", "rule", "verdict"])

    out = rows.mapInArrow(run, f"id {id_type}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


def _split(rows: DataFrame, id_type: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [split_url(u) for u in pdf["url"]]
            yield pd.DataFrame({"id": pdf["id"], "host": [p[0] for p in parts], "path": [p[1] for p in parts]})

    return rows.mapInPandas(run, f"id {id_type}, host string, path string")
