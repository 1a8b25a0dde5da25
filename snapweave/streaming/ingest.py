"""Continuous ingest: files that land are cut into chunks, new chunks are appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.operators.chunking import content_chunks
from snapweave.operators.dedup import new_blobs


def chunk_stream(spark: SparkSession, folder: str, schema: str, id_col: str, content_col: str, sizes: tuple[int, int, int]) -> DataFrame:
    """The chunks of the rows of Parquet files that land in ``folder``."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return content_chunks(rows, id_col, F.col(content_col), *sizes)


def distinct_within(stream: DataFrame, id_col: str, time_col: str, delay: str) -> DataFrame:
    """One row per id among rows at most ``delay`` apart: state is dropped as the watermark passes."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def ingest(chunks: DataFrame, target: str, checkpoint: str):
    """Starts the stream that appends chunks not yet in ``target``. A batch that runs again after a failure overwrites its
    own folder, so nothing is doubled."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        others = spark.read.schema("chunk_id string, len long, batch long").option("basePath", target).parquet(target).where(F.col("batch") < number) if number else spark.createDataFrame([], "chunk_id string, len long, batch long")
        new_blobs(df.select("chunk_id", "len"), others).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
