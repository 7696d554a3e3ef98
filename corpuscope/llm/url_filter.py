"""URL filters: a trie over reversed host labels and path segments with longest-match precedence.

A rule is (verdict, host, path). It fits a url if its host is the url's host or a parent domain of it and the
url's path starts with the rule's path. Of the fitting rules the one with the longest text (host and path) wins;
of equal ones "block" wins. The trie goes to the executors only while the rules are small (`max_broadcast_bytes`);
a larger rule set is joined on host suffixes instead.

Null or malformed urls (no `://`) have an empty host and path and fit no rule. Ties, repeated rows, empty tables and urls of
any length need no care: every url is judged by itself. Columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]
RESULTS = ("host", "path", "rule", "verdict")

#: Keys that a domain's or a url's rows are dealt over where rules are joined.
SALTS = 16


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Trie:
    """Nodes are dicts; host labels from the last to the first, then path segments.

    A node's `None` entry holds the rules that end there: at a host node those without a path, at a path node those
    whose path ends with `/` behind it. Rules whose last segment isn't closed by `/` are kept by that beginning.
    """

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"no such verdict: {verdict}")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("h", label), {})
            *closed, tail = path.split("/")
            for segment in closed:
                node = node.setdefault(("p", segment), {})
            node.setdefault(None, []).append((len(host) + len(path), verdict == "block", tail, host + path, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best = None
        node: dict | None = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            below: dict | None = node
            for k, segment in enumerate(segments):
                for rule in below.get(None, ()):
                    if "/".join(segments[k:]).startswith(rule[2]) and (best is None or rule[:2] > best[:2]):
                        best = rule
                below = below.get(("p", segment))
                if below is None:
                    break
        return best and (best[3], best[4])


def filter_urls(df: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow", max_broadcast_bytes: int = 8 << 20) -> DataFrame:
    """df with host, path, rule and verdict; `default` is the verdict where no rule fits."""
    rules = list(dict.fromkeys(rules))
    df = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).drop("rule", "verdict")
    if sum(len(h) + len(p) + 64 for _, h, p in rules) > max_broadcast_bytes:
        return joined_rules(df, rules, default)
    fields = [(f.name, f.dataType) for f in df.schema.fields]
    trie = df.sparkSession.sparkContext.broadcast(Trie(rules))
    host_at, path_at = (next(k for k, f in enumerate(fields) if f[0] == c) for c in ("host", "path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            urls = list(zip(batch.column(host_at).to_pylist(), batch.column(path_at).to_pylist(), strict=True))
            known = {u: match(*u) for u in set(urls)}  # each host and path of a batch is judged once
            found = [known[u] for u in urls]
            more = [pa.array([x and x[0] for x in found], pa.string()), pa.array([x[1] if x else default for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "rule", "verdict"])

    return df.mapInArrow(judge, ", ".join(f"`{n}` {t.simpleString()}" for n, t in fields) + ", rule string, verdict string")


def joined_rules(df: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same without a broadcast: rows meet rules on host suffixes, and the longest fitting rule is kept."""
    spark = df.sparkSession
    table = spark.createDataFrame([(h, p, v, len(h) + len(p)) for v, h, p in rules], "rule_host string, rule_path string, rule_verdict string, rule_size int")
    keys = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    # A domain that very many urls share, and urls that repeat very often, are dealt over SALTS keys.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    best = (
        keys.select("host", "path", F.explode(suffixes).alias("rule_host"), F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int").alias("salt"))
        .join(table.select("*", salts.alias("salt")), ["rule_host", "salt"])
        .where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct("rule_size", (F.col("rule_verdict") == "block").alias("blocks"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("verdict"))
    )
    salt = "salt"
    while salt in df.columns:
        salt += "_"
    dealt = df.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(best.select("*", salts.alias(salt)), ["host", "path", salt], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default))).select(*df.columns, "rule", "verdict")
