"""Tables kept up to date by streaming aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch_path


def keep_latest(stream: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """Writer that stores the changed rows of each batch in the batch's own folder.

    A replayed batch replaces its folder, so the table has no duplicates.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest row per key of a table written by ``keep_latest``."""
    rows = spark.read.option("mergeSchema", "false").parquet(path)
    body = [c for c in rows.columns if c != "batch_id"]
    return (
        rows.groupBy(*keys).agg(F.max_by(F.struct(*body), "batch_id").alias("row")).select("row.*")
    )


def run_available(writer) -> StreamingQuery:
    """Process what is there now, then stop; the ended query tells what was done."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def state_rows(query: StreamingQuery) -> int:
    """Rows of state that a query holds after its last batch."""
    return sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    return scratch_path(spark, name), scratch_path(spark, f"{name}-ckpt")
