"""Incremental chunking: documents that arrive as files become chunks, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_documents


def arriving_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string", most_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def chunk_stream(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Chunks are written a batch to its own partition, so a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        chunk_documents(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
