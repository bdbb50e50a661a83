"""Streams over the engine's tables.

Every sink is safe to run again: a batch that is repeated after a failure replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeline.operators import chunking, search


def source(spark: SparkSession, path: str, schema, most_files: int = 100) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def once(df: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key once; the state of keys older than the watermark is dropped."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(df: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, end, key, n): events of each key in tumbling windows; closed windows are final."""
    g = df.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select("w.start", "w.end", key, "n")


def session_counts(df: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    g = df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select("w.start", "w.end", key, "n")


def index_documents(stream: DataFrame, out: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", every: str | None = None) -> StreamingQuery:
    """Chunks and postings of arriving documents, in folders by batch, so that a repeated batch replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.dropDuplicates([id_col])
        chunking.window_chunks(batch, id_col, text_col, least=1).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        search.postings(batch, id_col, text_col).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows of the last batch that wrote each key."""
    t = spark.read.parquet(path)
    last = t.groupBy(key).agg(F.max("batch").alias("batch"))
    return t.join(last, [key, "batch"], "left_semi").drop("batch")
