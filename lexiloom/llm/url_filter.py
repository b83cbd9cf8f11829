"""URL filters: a sort-merge range join of pages with host and path rules."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bounded_batches, written

#: Ranges of keys for each shuffle partition, keys sampled for each range to find its border, and characters kept of a border.
RANGES, SAMPLED, BORDER = 4, 16, 256
RULES = "host string, path string, verdict string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: the host stands behind the first :// up to /, ? or #, A-Z lower-cased; the path from there up to ? or #.
    Both are empty where the URL is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_rules(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """Rules (host, path, verdict) from lines such as `block example.com/ads/`."""
    rows = []
    for line in lines:
        verdict, _, where = line.strip().partition(" ")
        host, slash, path = where.strip().partition("/")
        rows.append((host.translate(str.maketrans(UPPER, LOWER)), slash + path, verdict))
    return spark.createDataFrame(rows, RULES)


def _behind(prefix: str) -> str:
    """The least string that is greater than every string which starts with prefix."""
    while prefix:
        last = ord(prefix[-1])
        if last < 0x10FFFF:
            return prefix[:-1] + chr(0xE000 if last == 0xD7FF else last + 1)
        prefix = prefix[:-1]
    return "\U0010ffff" * 8


def rule_ranges(borders: list[str], host_key: str, path: str) -> set[int]:
    """Ranges of keys that hold a page which a rule may fit. A page of key k is in a range from bisect_left to bisect_right of k.

    A rule's own host is one interval, host key and path. Its subdomains, at whose paths the rule may fit anywhere, are the keys
    below the host key that go on with another character than the path's slash.
    """
    behind = _behind(host_key)
    if path in ("", "/"):
        spans = [(host_key, behind)]
    else:
        spans = [(host_key + path, _behind(host_key + path)), (host_key, host_key + "/"), (host_key + "0", behind)]
    return {k for a, b in spans for k in range(bisect_left(borders, a), bisect_left(borders, b) + 1)}


class Sweep:
    """Active rules of a sweep over sorted keys: a stack of hosts, each nested in the one below, with nested paths."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, list[str], list[int], list[tuple[str, str]]]] = []

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, host: str, path: str, verdict: str) -> None:
        """Opens a rule; rules of one host come sorted by path."""
        self._close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, [], [], []))
        _, paths, outer, found = self.stack[-1]
        k = len(paths) - 1
        while k >= 0 and not path.startswith(paths[k]):
            k = outer[k]
        paths.append(path)
        outer.append(k)
        found.append((host + path, verdict))

    def page(self, key: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits; of equally long ones that of the longer host."""
        self._close(key)
        best, size = None, -1
        for _, paths, outer, found in reversed(self.stack):
            k = bisect_right(paths, path) - 1
            while k >= 0 and not path.startswith(paths[k]):
                k = outer[k]
            if k >= 0 and len(found[k][0]) > size:
                best, size = found[k], len(found[k][0])
        return best


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """One row per row of pages: (id, host, path, rule, verdict). rules has RULES.

    A rule fits its host and all subdomains where the path of the URL starts with the rule's. The longest fitting rule (host and
    path together; of equally long ones that of the longer host) gives rule and verdict; without one the rule is null and the
    verdict is `default`. Of rules with the same host and path the greatest verdict counts (block before allow). A rule with a null
    host, path or verdict fits nothing. A null URL, or one without ://, has an empty host and path. Null and repeated ids are kept;
    rows that are wholly alike get the same answers; an empty table gives no rows; other columns are ignored, so their names may
    clash with any here.

    The key of a page is its host reversed, a full stop and the path, so that a host and all below it are one interval of keys. Keys
    are dealt into ranges of about equal numbers of pages, whose borders come from a sample that grows with the number of ranges
    only; a key that fills several ranges is dealt over them in turn. A rule goes to the ranges its intervals meet. Each range is
    sorted and swept once: a task holds the rules that are open where it stands, never a range.
    """
    spark = pages.sparkSession
    bounded_batches(pages)
    n = ranges or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = url_parts(F.col(url_col))
    keyed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    kind = keyed.schema["id"].dataType.simpleString()
    rows = pages.count()
    key = F.concat(F.reverse(F.col("host")), F.lit("."), F.col("path"))
    share = min(1.0, n * SAMPLED / max(1, rows))
    some = sorted(r[0] for r in keyed.sample(share, 7).select(F.substring(key, 1, BORDER)).collect())
    borders = [some[k * len(some) // n] for k in range(1, n)] if some else []
    held = spark.sparkContext.broadcast(borders)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, borders = 0, held.value
        for batch in batches:
            parts = []
            for k in batch.column("key").to_pylist():
                low = bisect_left(borders, k)
                high = bisect_right(borders, k, low)
                parts.append(low + turn % (high - low + 1))
                turn += 1
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *batch.columns], ["part", *batch.schema.names])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = held.value
        for batch in batches:
            for row in batch.to_pylist():
                parts = sorted(rule_ranges(borders, row["key"], row["path"]))
                out = [pa.array(parts, pa.int32()), *(pa.array([row[c]] * len(parts), pa.string()) for c in ("key", "host", "path", "verdict"))]
                yield pa.RecordBatch.from_arrays(out, ["part", "key", "host", "path", "verdict"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_rules = None, Sweep()
        for batch in batches:
            pages_at, answers = [], []
            columns = [batch.column(c).to_pylist() for c in ("part", "key", "verdict", "host", "path")]
            for at, (where, key, verdict, host, path) in enumerate(zip(*columns, strict=True)):
                if where != part:
                    part, open_rules = where, Sweep()
                if verdict is not None:
                    open_rules.rule(key, host, path, verdict)
                else:
                    pages_at.append(at)
                    answers.append(open_rules.page(key, path) or (None, default))
            if pages_at:
                kept = batch.take(pa.array(pages_at, pa.int64()))
                found = [pa.array([a[k] for a in answers], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("host"), kept.column("path"), *found], ["id", "host", "path", "rule", "verdict"])

    # written, so that a page keeps its range when a task is repeated
    dealt = written(keyed.withColumn("key", key).mapInArrow(deal, f"part int, id {kind}, host string, path string, key string"), "url-pages")
    clean = rules.select(*(F.col(c.split()[0]).cast("string") for c in RULES.split(", "))).dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    laid = clean.withColumn("key", F.concat(F.reverse("host"), F.lit("."))).mapInArrow(spread, "part int, key string, host string, path string, verdict string")
    both = dealt.withColumn("verdict", F.lit(None).cast("string")).unionByName(laid, allowMissingColumns=True)
    # a host's rules stand before its pages, sorted by path: a rule's key ends where a page's path begins
    ordered = both.repartition("part").sortWithinPartitions("part", "key", F.col("verdict").isNull(), "path")
    out = ordered.select("part", "key", "verdict", "id", "host", "path").mapInArrow(sweep, f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


#: The rules of the registered query.
PAGE_RULES = ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")

#: DuckDB: the same answers.
URL_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, q, v))
SELECT page_id, host, path,
       (SELECT arg_max(h || q, length(h || q)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS rule,
       coalesce((SELECT arg_max(v, length(h || q)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)), 'allow') AS verdict
FROM p
"""
