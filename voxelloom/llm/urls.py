"""URL verdicts: a blocked Bloom filter passes possible hits to an exact join with the list."""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .bitfilter import build_filter, key_hashes, may_hold

# A list of at most so many entries of bounded length is sent to all executors.
BROADCAST_ROWS = 50_000
BROADCAST_CHARS = 20_000_000
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and canonical form of a URL; all empty without ``://``.

    The canonical form is the host, the path without trailing slashes, and the
    query's parameters in order without those that only track.
    """
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(tail, "^[^?#]*", 0)
    query = F.regexp_extract(tail, "^[^?#]*\\?([^#]*)", 1)
    kept = F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    canonical = F.concat(
        lowered, F.regexp_replace(path, "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    )
    return lowered, path, canonical


def candidates(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Keys of every rule that could fit: host suffixes of whole labels with path starts.

    Only as many labels, and only path lengths, as the list itself has.
    """
    parts = F.split(host, "\\.")
    n = F.size(parts)
    starts = F.transform(
        F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.length(path)),
        lambda x: F.substring(path, F.lit(1), x),
    )
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda i: F.array_join(F.slice(parts, n - i + 1, i), ".")
    )
    return F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda p: F.concat(F.lit("r "), h, p))))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    listed_urls: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict, canonical_url).

    ``rules`` (host, path, verdict) fit their host and its subdomains where the
    page's path starts with theirs; the longest wins, of equal length the
    longer host, and of the same rule given twice ``block``.  Where no rule
    fits, a page whose canonical URL is in ``listed_urls`` (url) is blocked and
    any other allowed.  Rules and URLs share one filter; only what it passes
    meets the list in an exact join.

    A null URL has empty parts and is allowed, as is one without ``://``.
    Repeated rows stay repeated; other columns are ignored; empty tables give
    empty results.  Rules and URLs that are null are ignored.
    """
    spark: SparkSession = pages.sparkSession
    host, path, canonical = url_parts(F.coalesce(F.col(url_col), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), canonical.alias("canonical_url"))
    entries = rules.where("host is not null and path is not null and verdict is not null").select(
        F.concat(F.lit("r "), F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_chars"), "verdict", F.length("path").alias("path_chars"),
        F.size(F.split("host", "\\.")).alias("labels"),
    )
    if listed_urls is not None:
        own = url_parts(F.col("url"))[2]
        entries = entries.unionByName(
            listed_urls.where("url is not null").select(F.concat(F.lit("u "), own).alias("key"), F.lit("block").alias("verdict")),
            allowMissingColumns=True,
        )
    entries = materialize(
        entries.groupBy("key", "rule", "host_chars", "path_chars", "labels").agg(F.max("verdict").alias("verdict"))
    )
    n, chars, labels = entries.agg(F.count("*"), F.sum(F.length("key")), F.max("labels")).first()
    lengths = [r[0] for r in entries.where("path_chars is not null").select("path_chars").distinct().collect()]
    bits = spark.sparkContext.broadcast(build_filter(entries, "key", n))

    @F.pandas_udf("boolean")
    def passed(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bits.value, h.to_numpy(np.int64), b.to_numpy(np.int64)))

    # Equal URLs are judged once.
    urls = rows.select("host", "path", "canonical_url").distinct()
    keys = F.array(F.concat(F.lit("u "), F.col("canonical_url")))
    if labels:
        keys = F.concat(keys, candidates(F.col("host"), F.col("path"), labels, sorted(lengths)))
    h, b = key_hashes(F.col("key"))
    hits = urls.withColumn("key", F.explode(keys)).where(passed(h, b))
    known = entries.drop("path_chars", "labels")
    if n <= BROADCAST_ROWS and (chars or 0) <= BROADCAST_CHARS:
        known = F.broadcast(known)
    found = hits.join(known, "key").groupBy("host", "path", "canonical_url").agg(
        # Nulls are below all values, so any rule beats a listed URL.
        F.max(F.struct(F.length("rule").alias("n"), "host_chars", "rule", "verdict")).alias("best")
    )
    found = found.select(
        F.col("host").alias("h"), F.col("path").alias("p"), F.col("canonical_url").alias("c"), "best"
    )
    return rows.join(
        found, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")) & (F.col("canonical_url") == F.col("c")), "left"
    ).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        "canonical_url",
    )


ORACLE = r"""
with t as (select page_id, coalesce(url,'') url from pages),
r as (select page_id, case when instr(url,'://')>0 then substr(url, instr(url,'://')+3) else '' end rest from t),
h as (select page_id, regexp_extract(rest,'^[^/?#]*') host0, rest from r),
p as (select page_id, translate(host0,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') host, substr(rest, length(host0)+1) tail from h),
q as (select page_id, host, regexp_extract(tail,'^[^?#]*') path, list_sort(list_filter(string_split(regexp_extract(tail,'^[^?#]*\?([^#]*)',1),'&'), lambda x: x<>'' and not regexp_matches(x,'^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) ps from p),
c as (select page_id, host, path, host||regexp_replace(path,'/+$','')||case when len(ps)>0 then '?'||array_to_string(ps,'&') else '' end canonical_url from q),
rules(rh, rp, v) as (values ('net','/','block'),('example.net','/en/','allow'),('example.com','/de/','block'),('org','/fr/','allow')),
m as (select c.*, rh||rp rule, v, row_number() over (partition by page_id order by length(rh||rp) desc nulls last) k from c left join rules on (host=rh or ends_with(host, '.'||rh)) and starts_with(path, rp)),
bad as (select distinct canonical_url from c where starts_with(host, 'spam'))
select page_id, host, path, rule, coalesce(v, case when canonical_url in (select canonical_url from bad) then 'block' else 'allow' end) verdict, canonical_url from m where k=1
"""
