"""URL filters: sort-merge range join of reversed-host keys with rule intervals.

A host is keyed by its labels from the last to the first, each closed by ``\\x00``: the hosts under a rule's host are
then the keys with one prefix, an interval, and the intervals of rules are nested or disjoint. Urls are dealt
by ranges of (key, path, id); each range also gets the rule intervals that overlap it. In a range, a sweep in key
order keeps the stack of open intervals, and each open interval looks up the url's path among its rule paths.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule and gets the default verdict. Of the
rules that fit, the longest (host and path together, then host) wins; of a rule given with both verdicts, block
holds. A hot host, or one url repeated, is split among ranges by path and id. An empty table gives an empty
result; an empty rule list gives the default everywhere. Only the id and the url are read from ``pages``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyspark.llm.common import partitions_for


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
DEFAULT = "allow"
URLS_PER_RANGE = 200_000
SAMPLE_PER_RANGE = 40
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"

_EVENT = "part int, key string, kind int, path string, id long, host string, verdict string"
_OUT = "id long, host string, path string, rule string, verdict string"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def host_key(host: Column) -> Column:
    """``b.a`` becomes ``a\\x00b\\x00``."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "\0"), F.lit("\0"))


def _deal_urls(splits: Sequence[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, path, ids = (b.column(n).to_pylist() for n in ("key", "path", "id"))
            part = [bisect_right(splits, (k, p, -1 if i is None else i)) for k, p, i in zip(key, path, ids)]
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), b.column("key"), pa.array([1] * n, pa.int32()), b.column("path"), b.column("id"), b.column("host"), pa.nulls(n, pa.string())],
                ["part", "key", "kind", "path", "id", "host", "verdict"],
            )

    return run


def _deal_rules(splits: Sequence[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, host, path, verdict in zip(*(b.column(n).to_pylist() for n in ("key", "host", "path", "verdict"))):
                first, last = bisect_right(splits, (key, "", -1)), bisect_right(splits, (key[:-1] + "\1", "", -1))
                rows += [(p, key, 0, path, None, host, verdict) for p in range(first, last + 1)]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("part", "key", "kind", "path", "id", "host", "verdict"), r)) for r in rows],
                pa.schema([("part", pa.int32()), ("key", pa.string()), ("kind", pa.int32()), ("path", pa.string()), ("id", pa.int64()), ("host", pa.string()), ("verdict", pa.string())]),
            )

    return run


class _Open:
    """Rules of one host whose interval is open."""

    def __init__(self, part: int, key: str, host: str):
        self.part, self.key, self.host, self.paths, self.lengths = part, key, host, {}, []

    def add(self, path: str, verdict: str) -> None:
        if self.paths.get(path) != "block":
            self.paths[path] = verdict
        self.lengths = sorted({len(p) for p in self.paths}, reverse=True)

    def longest(self, path: str) -> str | None:
        return next((path[:n] for n in self.lengths if path[:n] in self.paths), None)


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Open] = []
        for b in batches:
            ids, hosts, paths, rules, verdicts = [], [], [], [], []
            for part, key, kind, path, i, host, verdict in zip(*(c.to_pylist() for c in b.columns)):
                while stack and not (stack[-1].part == part and key.startswith(stack[-1].key)):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(_Open(part, key, host))
                    stack[-1].add(path, verdict)
                    continue
                found = [(len(o.host) + len(p), len(o.host), o, p) for o in stack if (p := o.longest(path)) is not None]
                _, _, o, p = max(found, key=lambda x: x[:2], default=(0, 0, None, None))
                ids.append(i)
                hosts.append(host)
                paths.append(path)
                rules.append(o.host + p if o else None)
                verdicts.append(o.paths[p] if o else default)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts))], ["id", "host", "path", "rule", "verdict"]
            )

    return run


def judge(pages: DataFrame, rules: DataFrame | Sequence[Rule] = RULES, default: str = DEFAULT, key: str = "page_id", url: str = "url") -> DataFrame:
    """Returns ``key, host, path, rule, verdict`` for each row of ``pages``. ``rules`` is a sequence, or a table ``host, path, verdict``."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    urls = pages.select(F.col(key).cast("long").alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    rules = rules.select("host", "path", "verdict").withColumn("key", host_key(F.col("host")))
    rows = pages.count()
    ranges = partitions_for(rows, URLS_PER_RANGE, spark)
    # a sample that only places the borders of the ranges: some 40 keys for each range
    part = min(1.0, SAMPLE_PER_RANGE * ranges / max(1, rows))
    sample = sorted((r.key, r.path, -1 if r.id is None else r.id) for r in urls.sample(part, 11).select("key", "path", "id").collect())
    splits = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    events = urls.mapInArrow(_deal_urls(splits), _EVENT).unionByName(rules.mapInArrow(_deal_rules(splits), _EVENT))
    events = events.repartition(ranges, "part").sortWithinPartitions("part", "key", "kind")
    return events.mapInArrow(_sweep(default), _OUT).withColumnRenamed("id", key)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


SQL = f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages
), rules(h, q, v) AS (VALUES {', '.join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)}
), hit AS (
  SELECT r, arg_max(h || q, length(h || q) * 1000 + length(h)) AS rule, arg_max(v, length(h || q) * 1000 + length(h)) AS verdict
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM p LEFT JOIN hit USING (r)
"""
