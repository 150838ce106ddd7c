"""Threshold-scaled document fingerprints, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, shingles, words

SHINGLE_WORDS = 5
FRACTION = 1 / 8
# Rows that share one sorted bucket, and buckets that share one block of buckets.
BUCKET_ROWS = 64
BLOCK_BUCKETS = 1024
RANGES = 256
NULL_BUCKETS = 4096


def sketch(text: Column, fraction: float = FRACTION, size: int = SHINGLE_WORDS) -> Column:
    """All shingle hashes (64 bits in hex) below ``fraction`` of their range, ascending.

    Whether a hash stays depends on nothing but its shingle, so the sketches of
    two texts merge by union and their overlap estimates both containment and
    likeness, however unequal the texts are.
    """
    below = f"{min(int(fraction * 2**64), 2**64 - 1):016x}"
    hashed = let(
        words(text), lambda w: F.transform(shingles(w, size), lambda s: F.substring(F.md5(s), 1, 16))
    )
    return F.sort_array(F.array_distinct(F.filter(hashed, lambda h: h < below)))


def merge(a: Column, b: Column) -> Column:
    """The sketch of both documents together."""
    return F.sort_array(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first document's shingles that the second has (0 for an empty sketch)."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity (0 if either sketch is empty)."""

    def ratio(both: Column) -> Column:
        return both / (F.size(a) + F.size(b) - both)

    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        let(F.size(F.array_intersect(a, b)), ratio)
    )


def _buckets(rows: DataFrame) -> Column:
    """A bucket number that never falls along the order key ``k``, with few rows each.

    The key range is cut at approximate quantiles, and each part evenly, so
    uneven ids still spread.  Rows without a key follow in hashed buckets.
    """
    n, cuts = rows.agg(
        F.count("k"), F.percentile_approx("k", [i / RANGES for i in range(RANGES + 1)], 10_000)
    ).first()
    cuts = sorted(set(cuts or []))
    last = max(1, len(cuts) - 1)
    per = max(1, -(-n // (last * BUCKET_ROWS)))
    none = F.lit(1 << 50) + F.pmod(F.xxhash64("body"), F.lit(NULL_BUCKETS))
    if len(cuts) < 2:
        return F.when(F.col("k").isNull(), none).otherwise(F.lit(0).cast("long"))
    edges = F.array(*[F.lit(c) for c in cuts])
    part = F.least(F.greatest(F.size(F.filter(edges, lambda c: c <= F.col("k"))), F.lit(1)), F.lit(last))

    def within(p: Column) -> Column:
        low, high = (F.get(edges, p - 1 + i).cast("double") for i in (0, 1))
        step = F.floor((F.col("k").cast("double") - low) / (high - low) * per)
        return (p - 1).cast("long") * per + F.least(F.greatest(step, F.lit(0)), F.lit(per - 1))

    return F.when(F.col("k").isNull(), none).otherwise(let(part, within))


def _following(buckets: DataFrame) -> DataFrame:
    """Each bucket with the next one in use; the last is followed by the first.

    Buckets are ordered inside blocks, and only the edge of each block meets
    the others in one task.
    """
    block = F.expr(f"bucket div {BLOCK_BUCKETS}")
    inside = Window.partitionBy("block").orderBy("bucket")
    linked = buckets.select("bucket").distinct().withColumn("block", block).withColumn(
        "next_bucket", F.lead("bucket").over(inside)
    )
    edges = linked.groupBy("block").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    order = Window.orderBy("block")
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(
        F.col("hi").alias("bucket"),
        F.coalesce(F.lead("lo").over(order), F.first("lo").over(whole)).alias("after"),
    )
    return linked.join(edges, "bucket", "left").select("bucket", F.coalesce("next_bucket", "after").alias("next_bucket"))


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION
) -> DataFrame:
    """Sketches of every text and of its edited form, with their likeness.

    The edited text takes its second half from the start of the next document,
    by descending id; the last document is followed by the first.  Documents
    are put in order bucket by bucket, never in one task, and a bucket's last
    document takes the first of the next bucket in use.

    Null texts are empty; an empty text has an empty fingerprint and is like
    none.  So is a text of n distinct shingles none of which is below
    ``fraction``, with chance (1 - fraction)^n, even to an equal text.  Rows of equal id follow each other by text; rows without id come
    last, in a fixed order of their texts.  A single row follows itself.
    Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).withColumn(
        # Ascending over all bits of the id, without overflow, from the greatest id on.
        "k", F.bitwise_not(F.col("doc_id"))
    )
    rows = rows.withColumn("bucket", _buckets(rows))
    order = Window.partitionBy("bucket").orderBy(F.col("k").asc_nulls_last(), "body")
    placed = rows.withColumns({"next_body": F.lead("body").over(order), "place": F.row_number().over(order)})
    first = placed.where("place = 1").select(F.col("bucket").alias("of"), F.col("body").alias("first_body"))
    after = _following(rows).join(first, F.col("next_bucket") == F.col("of")).select("bucket", "first_body")

    half = F.floor(F.length("body") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("body"), F.lit(1), F.length("body") - half), F.substring(F.col("following"), F.lit(1), half)
    )
    whole = (
        placed.join(after, "bucket")
        .select("doc_id", "bucket", "place", "body", "next_body", "first_body",
                F.coalesce("next_body", "first_body").alias("following"))
        .withColumn("edited", edited)
        .select(
            "doc_id", "bucket", "place", F.length("body").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            sketch(F.col("body"), fraction).alias("own"), sketch(F.col("edited"), fraction).alias("changed"),
            F.when(F.col("next_body").isNull(), sketch(F.col("first_body"), fraction)).alias("edge"),
        )
    )
    by_place = Window.partitionBy("bucket").orderBy("place")
    whole = whole.withColumn("after", F.coalesce(F.lead("own").over(by_place), F.col("edge")))
    return whole.select(
        "doc_id", "n_chars", "edited_sha256",
        F.array_join("own", "").alias("fingerprint"), F.array_join("changed", "").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
        containment(F.col("changed"), F.col("own")).alias("edited_in_own"),
        containment(F.col("own"), F.col("after")).alias("own_in_next"),
    )


ORACLE = r"""
with t as (select doc_id, coalesce(text,'') body from documents),
n as (select *, coalesce(lead(body) over (order by doc_id desc, body), first_value(body) over (order by doc_id desc, body)) nxt from t),
e as (select doc_id, body, nxt, substr(body,1,length(body)-length(body)//2)||substr(nxt,1,length(body)//2) edited from n),
a as (select doc_id, 0 kind, body x from e union all select doc_id, 1, edited from e union all select doc_id, 2, nxt from e),
w as (select doc_id, kind, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y<>'') w from a),
g as (select doc_id, kind, unnest(case when len(w)=0 then [] when len(w)<5 then [array_to_string(w,' ')]
 else list_transform(range(1,len(w)-3), lambda i: array_to_string(w[i:i+4],' ')) end) s from w),
k as (select doc_id, kind, list_sort(list_distinct(list(substr(md5(s),1,16)))) f from g where substr(md5(s),1,16) < '2000000000000000' group by 1,2),
j as (select e.doc_id, length(body)::bigint n_chars, sha256(edited) edited_sha256, coalesce(o.f,[]) o, coalesce(c.f,[]) c, coalesce(x.f,[]) x
 from e left join k o on o.doc_id=e.doc_id and o.kind=0 left join k c on c.doc_id=e.doc_id and c.kind=1 left join k x on x.doc_id=e.doc_id and x.kind=2)
select doc_id, n_chars, edited_sha256, array_to_string(o,'') fingerprint, array_to_string(c,'') edited_fingerprint,
 case when len(o)=0 or len(c)=0 then 0.0::double else len(list_intersect(o,c))::double/(len(o)+len(c)-len(list_intersect(o,c))) end near_edited,
 case when len(o)=0 or len(x)=0 then 0.0::double else len(list_intersect(o,x))::double/(len(o)+len(x)-len(list_intersect(o,x))) end near_next,
 case when len(c)=0 then 0.0::double else len(list_intersect(c,o))::double/len(c) end edited_in_own,
 case when len(o)=0 then 0.0::double else len(list_intersect(o,x))::double/len(o) end own_in_next from j
"""
