"""An extension: judge results as they arrive, with the batch operators on every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strataline.operators import documents


def judge_stream(spark: SparkSession, source: str, schema: str, truth: DataFrame, keys: list[str], sink: str, checkpoint: str) -> StreamingQuery:
    """Read parquet files of results as they come into ``source`` and write their judged leaves to ``sink``.

    Each micro-batch replaces its own folder, so a batch that runs twice leaves one copy.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def each(batch: DataFrame, number: int) -> None:
        pairs = batch.join(truth.select("file", "record"), "file")
        documents.judge_documents(pairs, keys, "record", "data").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
