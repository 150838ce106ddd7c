"""Quality rules with host verdicts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import let, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# A host whose shrunk failure rate of a rule lies above this is rejected.
HOST_LIMIT = 0.5
SYMBOLS = "#*$%&|<>"


def repeated_window_words(w: Column, size: int = 3) -> Column:
    """Words inside runs of ``size`` words that the text has twice or more.

    The runs are hashed, sorted with their places, and those beside an equal
    one kept; each kept run then adds the words up to the next kept one.
    """
    hashed = F.transform(
        F.sequence(F.lit(0), F.size(w) - size),
        lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(size)]).alias("h"), i.alias("i")),
    )

    def repeated(s: Column) -> Column:
        kept = F.filter(
            s,
            lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]),
        )
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1) - i, F.lit(size))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    found = let(let(F.sort_array(hashed), repeated), covered)
    return F.when(F.size(w) <= size, F.lit(0).cast("long")).otherwise(found)


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Row-local counts of each text: (id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("body")
    ).withColumn("w", words(F.col("body")))
    body = F.col("body")
    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    return base.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("w")).alias("n_repeat_words"),
    )


def beta_prior(rates: DataFrame, rule: str) -> tuple[float, float]:
    """Mean and strength of the beta distribution with the moments of the hosts' rates.

    Without spread between hosts the prior is as strong as all documents
    together; with more spread than any beta has, it is void.
    """
    rate = F.col(f"f_{rule}") / F.col("n")
    m, v, n = rates.agg(F.avg(rate), F.var_pop(rate), F.sum("n")).first()
    if m is None:
        return 0.0, 0.0
    # Rates of one value leave rounding errors in the variance.
    strength = float(n) if v < 1e-12 else min(float(n), max(0.0, m * (1 - m) / v - 1))
    return float(m), strength


def judge(docs: DataFrame, host_limit: float = HOST_LIMIT, **columns: str) -> DataFrame:
    """One row per row of ``docs`` with its counts, its own verdict and its host's.

    A document fails by itself with under ``MIN_WORDS`` words or with more than
    half of its words in repeated three-word runs.  For each of the two rules a
    host's failure rate is shrunk towards a beta prior fitted to all hosts, so
    that a host of few documents needs more than one bad one; a host above
    ``host_limit`` loses all its documents.

    Null and empty texts have no words and fail.  Rows without a host form one
    host of their own.  Repeated rows count as often as they occur.  Other
    columns of ``docs`` are ignored, so none can clash.  An empty table gives
    an empty result.
    """
    short = F.col("n_words") < MIN_WORDS
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    counts = materialize(
        text_counts(docs, **columns).withColumns({"fail_short": short, "fail_repeat": repeats})
    )
    hosts = counts.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("fail_short").alias("f_short"),
        F.count_if("fail_repeat").alias("f_repeat"),
    )
    shrunk = {}
    for rule in ("short", "repeat"):
        m, strength = beta_prior(hosts, rule)
        shrunk[f"{rule}_rate"] = (F.col(f"f_{rule}") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    verdicts = hosts.select(F.col("host").alias("of_host"), *[v.alias(k) for k, v in shrunk.items()]).withColumn(
        "host_rejected", (F.col("short_rate") > host_limit) | (F.col("repeat_rate") > host_limit)
    )
    failed = F.col("fail_short") | F.col("fail_repeat")
    return (
        counts.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")), "left")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            failed.alias("base_failed"), (~failed & ~F.col("host_rejected")).alias("kept"),
        )
    )


ORACLE = r"""
with t as (select row_number() over () r, doc_id, source, coalesce(text,'') body from documents),
w as (select r, list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda x: x<>'') w from t),
tri as (select r, i, w[i]||' '||w[i+1]||' '||w[i+2] g from (select r, w, unnest(range(1, len(w)-1)) i from w)),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) c from tri) where c>1),
hit as (select r, count(distinct i+k) n from rep, range(3) q(k) group by r),
ln as (select r, string_split(body, chr(10)) l from t),
dup as (select r, len(x)-len(list_distinct(x)) n from (select r, list_filter(l, lambda x: regexp_matches(x,'[^\x20\x09-\x0D]')) x from ln)),
c as (select t.r, doc_id, source, len(w)::bigint n_words, length(regexp_replace(body,'[\x20\x09-\x0D]+','','g'))::bigint word_chars,
 (length(body)-length(regexp_replace(body,'[#*$%&|<>]','','g')))::bigint n_symbols, dup.n::bigint n_dup_lines, coalesce(hit.n,0)::bigint n_repeat_words
 from t join w using (r) join dup using (r) left join hit using (r)),
f as (select *, n_words<50 fs, 100*n_repeat_words>50*n_words fr from c),
h as (select source, count(*) n, count(*) filter (fs) s, count(*) filter (fr) p from f group by 1),
m as (select avg(s/n) ms, var_pop(s/n) vs, avg(p/n) mp, var_pop(p/n) vp, sum(n)::double a from h),
k as (select *, case when vs<1e-12 then a else least(a, greatest(0, ms*(1-ms)/vs-1)) end ks,
 case when vp<1e-12 then a else least(a, greatest(0, mp*(1-mp)/vp-1)) end kp from m),
v as (select source, (s+ms*ks)/(n+ks)>0.5 or (p+mp*kp)/(n+kp)>0.5 bad from h, k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fs or fr base_failed, not (fs or fr) and not bad kept
from f join v on f.source is not distinct from v.source
"""
