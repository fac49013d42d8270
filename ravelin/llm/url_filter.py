"""URL filters: allow and block rules for hosts and path prefixes, the longest fitting rule decides.

Rules live in a trie: host labels from the right (``org``, ``example``), then path segments; the last segment of a rule's path may be
the beginning of a url's segment (``/en/1`` fits ``/en/12``). A small rule set is broadcast as that trie. A set whose text exceeds
``broadcast_bytes`` is not broadcast: hosts and rules then meet in a join on the host suffix, with the same result.

Longest: more host labels first, then the longer path. One (host, path) with both verdicts blocks.

Defined results: a null url or one without ``://`` has empty host and path; an empty host fits no rule and is blocked (it names no
source); other urls without a rule get ``default``. Repeated rows are judged one by one. Rules with a null host, path or verdict are
ignored. Input columns stay; ``host, path, rule, verdict`` replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.registry import query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule text that may be broadcast; beyond it rules and hosts are joined.
BROADCAST_BYTES = 8 << 20
RULE = "string"
HERE = ""


def host_of(url):
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nested dicts. ``hosts``: label -> node; node[HERE]: path trie. Path node: segment -> node; node[None]: segment prefix -> rule."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.hosts: dict = {}
        for host, path, verdict in sorted(rules, key=lambda r: r[2] != "allow"):
            node = self.hosts
            for label in reversed(host.split(".")):
                node = node.setdefault(label + ".", {})
            node = node.setdefault(HERE, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(None, {})[last] = (host + path, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        found, node = None, self.hosts
        for label in reversed(host.split(".")):
            node = node.get(label + ".")
            if node is None:
                break
            if HERE in node:
                found = self._path(node[HERE], path) or found
        return found

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        found = None
        for segment in path.split("/"):
            ends = node.get(None)
            if ends:
                fits = [p for p in ends if segment.startswith(p)]
                if fits:
                    found = ends[max(fits, key=len)]
            node = node.get(segment)
            if node is None:
                break
        return found


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules``: host, path, verdict ('allow' or 'block')."""
    rules = rules.select("host", "path", "verdict").na.drop().distinct()
    size = rules.select(F.sum(F.octet_length(F.concat("host", "path"))).alias("s")).first()["s"] or 0
    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    found = _by_trie(parts, rules) if size <= broadcast_bytes else _by_join(parts, rules)
    verdict = F.coalesce(F.col("verdict"), F.when(F.col("host") == "", F.lit("block")).otherwise(F.lit(default)))
    return found.withColumn("verdict", verdict)


def _by_trie(parts: DataFrame, rules: DataFrame) -> DataFrame:
    trie = parts.sparkSession.sparkContext.broadcast(Trie([tuple(r) for r in rules.collect()]))

    @F.pandas_udf("rule string, verdict string")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        match = trie.value.match
        for hosts, paths in batches:
            yield pd.DataFrame([match(h, p) or (None, None) for h, p in zip(hosts, paths)], columns=["rule", "verdict"])

    found = parts.withColumn("_found", find("host", "path"))
    return found.withColumns({"rule": F.col("_found.rule"), "verdict": F.col("_found.verdict")}).drop("_found")


def _by_join(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) pairs spread over their host suffixes, joined with the rules of that suffix."""
    pairs = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("host").alias("_at"), F.col("path").alias("_start"), F.col("verdict").alias("_verdict"))
    fits = pairs.withColumn("_at", F.explode(suffixes)).join(r, "_at").where(F.startswith("path", "_start"))
    rank = F.struct(F.size(F.split("_at", r"\.")), F.length("_start"), (F.col("_verdict") == "block").cast("int"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_at", "_start").alias("rule"), F.col("_verdict").alias("verdict")), rank).alias("_b"))
    return parts.drop("rule", "verdict").join(best, ["host", "path"], "left").withColumns({"rule": F.col("_b.rule"), "verdict": F.col("_b.verdict")}).drop("_b")


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

SQL = """
    with p as (
        select page_id, coalesce(url, '') as u, contains(coalesce(url, ''), '://') as ok from pages
    ), q as (
        select page_id,
            translate(case when ok then regexp_extract(substr(u, instr(u, '://') + 3), '^([^/?#]*)', 1) else '' end,
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            case when ok then regexp_extract(substr(u, instr(u, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
        from p
    ), r as (
        select *, case
            when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
            when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
            when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/'
            when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
            when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
        end as rule from q
    )
    select page_id, host, path, rule,
        case when rule in ('example.org/es/', 'example.org/en/1', 'com/de/') then 'block'
            when rule is null and host = '' then 'block' else 'allow' end as verdict
    from r
"""


@query("op3_url_filter", SQL)
def op3_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")
