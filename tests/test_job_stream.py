"""Job events go through the stream's state as text; values must come out as they went in."""

from test_logs import event, follow

from voxelloom.schema import JOB_EVENTS
from voxelloom.streaming import jobs


def test_progress_stream_keeps_whole_numbers(spark, tmp_path):
    """Counts beyond 2^53 beside events without counts, and text with quotes and line ends."""
    rows = [event("progress", 5, 2**53 + 1, 2**53 + 3), event("status", 4, message='a "quoted"\nline'), event("artifact", 3, path="p")]
    got, want, _ = follow(spark, tmp_path, rows, "1 hour", len(rows))
    assert got == want
    assert got[1].completed_windows == 2**53 + 1 and got[1].total_windows == 2**53 + 3
    assert got[1].last_status == 'a "quoted"\nline' and got[1].artifact_path == "p"


def test_progress_stream_hands_python_one_text_per_event(spark, tmp_path):
    """Per job Python is paid by the column: besides key and time there is one in, and one out."""
    spark.createDataFrame([event("status", 1)], JOB_EVENTS).write.parquet(str(tmp_path / "events"))
    stream = jobs.stream_job_progress(spark.readStream.schema(JOB_EVENTS).parquet(str(tmp_path / "events")))
    step = next(line for line in stream._jdf.queryExecution().analyzed().toString().split("\n") if "WithState" in line)
    assert "follow(job_id" in step and "event" in step and "[row#" in step and "kind" not in step
