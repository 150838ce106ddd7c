"""The training-data pipeline: stages over documents, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm import jaccard, mixing, packing, quality, suffixes
from voxelloom.llm.bitfilter import drop_ids
from voxelloom.llm.common import stored
from voxelloom.llm.queries import tokenizer_path

# Near copies share four fifths of their distinct five-word shingles.
NEAR_WORDS = 5
NEAR_PERCENT = 80
# Bytes of rows that go to a Python worker at once.  An executor has each batch several times outside its heap, and
# keeps much of that memory when large batches are freed.
BATCH_BYTES = 1 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """A stage with Arrow batches of bounded size; they stay so, since its rows are made when they are written."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects; it learns from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.with_scores(docs, quality.train(docs, labels)).where("score >= 0.5").select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies only the document of least id stays.

    Documents without words or without id stay.
    """
    groups = jaccard.jaccard_components(docs, NEAR_PERCENT, NEAR_WORDS)
    gone = stored(groups.where("component_id <> doc_id").select("doc_id"), "near-copies")
    return drop_ids(docs, gone, "doc_id")


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut 100-byte strings that start earlier too; a document of which nothing is left goes."""
    cut = suffixes.remove_repeats(docs)

    def left(row: Column) -> Column:
        return ~F.coalesce((F.length(row["text"]) == 0) & (F.coalesce(row["n_chars"], F.lit(0)) > 0), F.lit(False))

    # A plain filter would go below the cutting and have every text cut twice, in two Python workers of a task.
    rows = cut.select(F.explode(F.filter(F.array(F.struct("*")), left)).alias("row")).select("row.*")
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix; sources below their share come more than once."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids, one row per piece."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", in_small_batches(keep_good)),
    ("near_copies", in_small_batches(keep_one_of_near_copies)),
    ("repeats", in_small_batches(cut_repeated_strings)),
    ("mix", in_small_batches(mix_sources)),
    ("pack", in_small_batches(pack_sequences)),
]
# Learned scores, components and packings have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to ``documents`` and return the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
