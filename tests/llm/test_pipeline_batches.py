"""What the pipeline's stages hand to Python workers."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_stages_hand_small_batches_to_python(spark, tmp_path, monkeypatch):
    before = spark.conf.get(LIMIT)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda docs, tokenizer: docs.select("text").mapInArrow(sizes, "n long"))
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), 4000).alias("text"))
    try:
        spark.conf.unset(LIMIT)
        seen = [r[0] for r in dict(corpus_pipeline.STAGES)["pack"](spark, docs, str(tmp_path)).collect()]
    finally:
        spark.conf.set(LIMIT, before)
    # Twelve MB of text came in one batch before.
    assert sum(seen) > 12_000_000 and max(seen) < 1_200_000


def test_repeats_stage_cuts_each_text_once(spark, tmp_path):
    long = "x".join(str(i * i) for i in range(100))
    rows = [(1, long, 5), (2, "new " + long, 5), (3, long, 5), (4, "", 0), (5, None, None), (6, "", 3), (7, "é" * 80, 80), (8, "é" * 80, 80)]
    docs = spark.createDataFrame([(i, t, "en", "a", n) for i, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = dict(corpus_pipeline.STAGES)["repeats"](spark, docs, str(tmp_path))
    plan = left._jdf.queryExecution().executedPlan().toString()
    # A second node is a second worker for each running task, and cuts the texts again.
    assert plan.count("ArrowEvalPython") == 1, plan
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in left.collect()}
    # Of 7 only the first letter starts no earlier string; 3, 6 and 8 have nothing left, and 6 had nothing.
    assert kept == {1: (long, len(long)), 2: ("new ", 4), 4: ("", 0), 5: (None, None), 7: ("é", 1)} and left.columns == docs.columns
