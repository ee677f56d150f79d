"""URL filtering with a trie over reversed host labels and path segments.

A rule (host, path, verdict) fits a url of its host or a subdomain whose path starts with the rule's path. Of all rules that fit,
the longest (host and path together) wins; on equal length the longer host, then block before allow. Urls that no rule
fits get the default verdict.

The trie is broadcast while the rules are within ``MAX_RULE_BYTES``, which is measured first. Larger rule sets are joined:
distinct hosts and paths are expanded to their suffixes and prefixes, a few rows each, which meet the rules by key.

Defined results: a null url, or one without ``://``, has an empty host and path; an empty table gives no rows; repeated rows are
judged alike; extra columns are ignored; rules with a null host, path or verdict fit nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of hosts and paths up to which the trie is broadcast.
MAX_RULE_BYTES = 8_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


class Trie:
    """Nodes are dicts: by label below the root, then ``None`` leads to the paths, by segment. The last piece of a rule's
    path need not be a whole segment; it stands in a tuple key's place: ``ends`` maps such pieces to rules."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            if host is None or path is None or verdict is None:
                continue
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *segments, last = path.split("/")
            node = node.setdefault(None, {})
            for segment in segments:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})
            found = (len(host) + len(path), len(host), verdict == "block", host + path, verdict)
            ends[last] = max(found, ends.get(last, found))

    def match(self, host: str, path: str) -> tuple | None:
        """The rule that wins, as (length, host length, is block, rule, verdict)."""
        best, node, pieces = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            below = node.get(None)
            for piece in pieces:
                if below is None:
                    break
                for end, rule in self._ends(below, piece):
                    if best is None or rule[:3] > best[:3]:
                        best = rule
                below = below.get(piece)
        return best

    @staticmethod
    def _ends(node: dict, piece: str) -> Iterator[tuple[str, tuple]]:
        ends = node.get(None)
        if ends:
            if len(ends) < len(piece):
                yield from ((e, r) for e, r in ends.items() if piece.startswith(e))
            else:
                yield from ((piece[:k], ends[piece[:k]]) for k in range(len(piece) + 1) if piece[:k] in ends)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", max_rule_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict."""
    spark = pages.sparkSession
    parts = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    rules = rules.select("host", "path", "verdict").where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 16)).first()[0] or 0
    if size <= max_rule_bytes:
        return _by_trie(spark, parts, [tuple(r) for r in rules.collect()], default)
    return _by_join(parts, rules, default)


def _by_trie(spark: SparkSession, parts: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    trie = spark.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_pylist()
            found = [match(h, p) for h, p in zip(column("host"), column("path"))]
            more = [pa.array([f and f[3] for f in found], pa.string()), pa.array([f[4] if f else default for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "rule", "verdict"])

    page_id = dict(parts.dtypes)["page_id"]
    return parts.mapInArrow(run, f"page_id {page_id}, host string, path string, rule string, verdict string")


def _by_join(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    whole = lambda path: F.regexp_extract(path, r"(?s)^(.*/)?", 0)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    pieces = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(
        F.concat(F.array_join(F.slice(pieces, 1, k), "/"), F.lit("/"))))
    distinct = parts.select("host", "path").distinct()
    expanded = distinct.select("host", "path", F.explode(suffixes).alias("h"), prefixes.alias("ps")).select("host", "path", "h", F.explode("ps").alias("p"))
    ruled = rules.select(F.col("host").alias("h"), whole(F.col("path")).alias("p"), F.col("path").alias("rule_path"), "verdict")
    rank = F.struct(
        F.length("h") + F.length("rule_path"), F.length("h"), F.col("verdict") == "block",
        F.concat("h", "rule_path").alias("rule"), F.col("verdict").alias("verdict"))
    found = expanded.join(ruled, ["h", "p"]).where(F.expr("startswith(path, rule_path)")).groupBy("host", "path").agg(F.max(rank).alias("best"))
    return parts.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The rules of the registered query.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
"""
