"""URL filters by a sort-merge range join of URLs and host/path rules.

A host's canonical key is its labels in reverse, each followed by U+0001; all hosts under a rule's host begin with the
rule's key, so a rule is an interval of keys. URLs and rules are dealt out together by ranges of (key, spread), a rule to
every range that its interval meets, and sorted. A sweep over each range keeps the stack of the hosts whose intervals
hold the current key: an interval is left when a key no longer begins with it. The rules of one host are intervals of paths in turn:
sorted, each linked to the rule that it is nested in, so that a path's longest rule is found by bisection and a walk outwards, however
many rules the host has. On the stack the host itself is verified, and of the rules that fit the longest wins (host and
path together; of equals, the longer host).

Range borders come from about `sample_rows` URLs, those whose hash is below a limit that follows from the number of rows, so that all tasks
together give so many; they decide the balance of the tasks only, never the result. A host with very many URLs is split between ranges by
`spread`, a hash of id, path and source partition, also where ids are null or equal. Number of borders: `ranges`, at most a few thousand.

Defined cases: a null URL, or one without ://, has empty host and path and fits no rule; a null rule host or path is
ignored; of rules that are equal, the one with the smallest verdict counts; null ids and repeated rows are judged like all others; without rules
every URL gets the default verdict; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import read, rows_of, ship

_LAST = "\U0010ffff"
_TURNED = "range_id int, key string, is_url boolean, id string, host string, path string, verdict string"


def host_and_path(url):
    """Columns: host (A-Z lower-cased) and path of a URL column, both empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def host_key(host):
    """Column: com, example, www, each followed by U+0001, for www.example.com; empty for the empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01")))


class HostRules:
    """The rules of one host as nested intervals of paths."""

    def __init__(self, host: str):
        self.host, self.rules = host, []  # (path, verdict), in the order of paths
        self.outer: list[int] = []  # of each rule the one that it is nested in, or -1

    def add(self, path: str, verdict: str) -> None:
        k = len(self.rules) - 1
        while k >= 0 and not path.startswith(self.rules[k][0]):
            k = self.outer[k]
        self.rules.append((path, verdict))
        self.outer.append(k)

    def longest(self, host: str, path: str) -> tuple[str, str, str] | None:
        """(host, path, verdict) of the longest rule that fits."""
        if host != self.host and not host.endswith("." + self.host):
            return None
        k = bisect_right(self.rules, path, key=lambda r: r[0]) - 1
        while k >= 0 and not path.startswith(self.rules[k][0]):
            k = self.outer[k]
        return (self.host, *self.rules[k]) if k >= 0 else None


def _sweep(batches):
    """Rows in the order of (range, key, rules first, host, path); yields URLs with their rule and verdict."""
    here, stack = None, []  # of (key, rules of a host with that key)

    def batch_of(rows):
        ids, hosts, paths, rules, verdicts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (ids, hosts, paths, rules, verdicts)], ["id", "host", "path", "rule", "verdict"])

    out = []
    for place, key, is_url, row, host, path, verdict in rows_of(batches, "range_id", "key", "is_url", "id", "host", "path", "verdict"):
        if place != here:
            here, stack = place, []
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if not is_url:
            if not stack or stack[-1][1].host != host:
                stack.append((key, HostRules(host)))
            stack[-1][1].add(path, verdict)
            continue
        best = max((r for _, rules in stack if host and (r := rules.longest(host, path))), key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)
        out.append((row, host, path, best and best[0] + best[1], best and best[2]))
        if len(out) >= 20_000:
            yield batch_of(out)
            out = []
    if out:
        yield batch_of(out)


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col="page_id", url_col="url", default: str = "allow", ranges: int | None = None, sample_rows: int = 20_000) -> DataFrame:
    """rules: host, path, verdict. A row for each URL: id_col, host, path, rule (host and path joined, or null), verdict."""
    spark = pages.sparkSession
    ship(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).cast("string").alias("id"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    urls = urls.withColumn("spread", F.hex(F.xxhash64("id", "path", F.spark_partition_id())))
    n_rows = pages.count()
    limit = (1 << 32) if n_rows <= sample_rows else (sample_rows << 32) // n_rows
    sampled = urls.where(F.pmod(F.xxhash64("spread", "key"), F.lit(1 << 32)) < limit)
    sample = sorted((r[0], r[1]) for r in sampled.select("key", "spread").collect())
    borders = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []
    shared = spark.sparkContext.broadcast(borders)

    def deal(batches):
        """URLs to the range that holds (key, spread); rules to all ranges that their interval meets."""
        for batch in batches:
            rows = []
            for key, is_url, row, h, p, verdict, spread in rows_of([batch], "key", "is_url", "id", "host", "path", "verdict", "spread"):
                first = bisect_right(shared.value, (key, spread if is_url else ""))
                last = first if is_url else bisect_right(shared.value, (key + _LAST, _LAST))
                rows += [(k, key, is_url, row, h, p, verdict) for k in range(first, last + 1)]
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 7
            kinds = [pa.int32(), pa.string(), pa.bool_(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds)], ["range_id", "key", "is_url", "id", "host", "path", "verdict"])

    one = rules.where("host is not null and path is not null and host != ''").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    both = urls.select("key", F.lit(True).alias("is_url"), "id", "host", "path", F.lit(None).cast("string").alias("verdict"), "spread").union(
        one.select(host_key(F.col("host")).alias("key"), F.lit(False).alias("is_url"), F.lit(None).cast("string").alias("id"), "host", "path", "verdict", F.lit("").alias("spread"))
    )
    swept = both.mapInArrow(deal, _TURNED).repartition(ranges, "range_id").sortWithinPartitions("range_id", "key", "is_url", F.when(~F.col("is_url"), F.col("host")), F.when(~F.col("is_url"), F.col("path"))).mapInArrow(_sweep, "id string, host string, path string, rule string, verdict string")
    return swept.select(F.col("id").cast(pages.schema[id_col].dataType).alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: Fixed values of the contract: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(read(spark, sf_dir, "pages"), rules)


SQL = """
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT h.n, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY h.n ORDER BY length(r.host || r.path) DESC) AS k FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (n)
"""
