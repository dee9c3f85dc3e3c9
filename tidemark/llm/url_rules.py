"""URL filters as a sort-merge range join.

A host is written with its labels reversed and a dot after each
(``www.example.com`` -> ``com.example.www.``), its path behind.  A rule's host
and all subdomains are then one interval of keys, those that begin with its
reversed host, and the intervals nest.  Keys and rules are dealt to ranges of
keys (a rule to every range that it overlaps), sorted, and swept once with a
stack of the rules that are open; each level of the stack finds its longest
path prefix by hashing, so many rules on one host cost no more than a few.

Ranges come from a bounded sample of keys, cut to ``KEY_BYTES``; their number
grows with the input.  Urls whose cut key fills several ranges, as a hot URL or
host does, are dealt over all of them, and rules that begin alike go to each of
these, so cutting changes neither order nor result.

Defined results: a null url, or one without ``://``, has empty host and path;
no rule fits it and its verdict is the default; a rule given twice blocks if
either row blocks; repeated rows are judged each; an empty rule table leaves
the default; an empty url table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drawn_rows, lower_ascii

SAMPLE_PER_RANGE = 64
#: Bytes of a key that decide its range, urls for each range, and the most ranges (the sample is at most 64 keys for each).
KEY_BYTES, RANGE_ROWS, MOST_RANGES = 64, 200_000, 20_000


def host_and_path(url):
    host = lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a DataFrame."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def sweep(batches, default: str):
    """Sorted rows (key, kind, id, host, path, verdict), rules (kind 0) before urls -> verdicts."""
    stack: list[tuple[str, str, dict[int, dict[str, str]]]] = []
    for batch in batches:
        ids, rules, verdicts, hosts, paths = [], [], [], [], []
        for key, kind, page, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, host, {}))
                own = stack[-1][2].setdefault(len(path), {})
                own[path] = "block" if "block" in (verdict, own.get(path)) else verdict
                continue
            best = (-1, None, default)
            for _, rule_host, levels in stack:
                for n in sorted(levels, reverse=True):
                    found = levels[n].get(path[:n]) if n <= len(path) else None
                    if found is not None:
                        best = max(best, (len(rule_host) + n, rule_host + path[:n], found), key=lambda x: x[0])
                        break
            ids.append(page)
            hosts.append(host)
            paths.append(path)
            rules.append(best[1])
            verdicts.append(best[2])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts))], names=["page_id", "host", "path", "rule", "verdict"])


def judged_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    urls = pages.select(F.col(page_id).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.select(F.concat(reversed_host(F.col("host")), F.col("path")).alias("key"), F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    count = urls.count()
    ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // RANGE_ROWS)))
    drawn = drawn_rows(urls, F.xxhash64("key", "id"), count, SAMPLE_PER_RANGE * ranges).select(F.substring(F.encode("key", "utf-8"), 1, KEY_BYTES).alias("key")).limit(2 * SAMPLE_PER_RANGE * ranges)
    keys = sorted(bytes(r["key"]) for r in drawn.collect())
    step = max(1, -(-len(keys) // ranges))
    splits = keys[step // 2 :: step][: ranges - 1]

    @F.pandas_udf("int")
    def url_range(key: pd.Series, salt: pd.Series) -> pd.Series:
        out = []
        for k, s in zip(key.str.encode("utf-8"), salt, strict=True):
            low, high = bisect_left(splits, k[:KEY_BYTES]), bisect_right(splits, k[:KEY_BYTES])
            out.append(low + s % (high - low + 1))
        return pd.Series(out, dtype="int32")

    @F.pandas_udf("array<int>")
    def rule_ranges(key: pd.Series) -> pd.Series:
        ends = lambda k: bisect_left(splits, k + b"\xff") if len(k) < KEY_BYTES else bisect_right(splits, k[:KEY_BYTES])
        return pd.Series([list(range(bisect_left(splits, k[:KEY_BYTES]), ends(k) + 1)) for k in key.str.encode("utf-8")])

    urls = urls.withColumn("range", url_range("key", F.xxhash64("id", "key")))
    asked = rules.select(lower_ascii(F.col("host")).alias("host"), F.coalesce(F.col("path"), F.lit("")).alias("path"), "verdict")
    asked = asked.select(reversed_host(F.col("host")).alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "host", "path", "verdict")
    asked = asked.withColumn("range", F.explode(rule_ranges("key")))
    dealt = asked.unionByName(urls).repartitionById(ranges, F.col("range")).sortWithinPartitions("key", "kind").drop("range")
    return dealt.mapInArrow(lambda batches: sweep(batches, default), "page_id long, host string, path string, rule string, verdict string")
