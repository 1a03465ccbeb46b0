"""The batch operators on a stream of articles: stream-static session joins and watermarked counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import pit


def read_articles(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def aligned(articles: DataFrame, schedule: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """Each article with its session and next open; the calendar is a static table."""
    return pit.align_next_open(pit.session_bucket(articles, schedule, ts), schedule, ts, strict=False)


def session_counts(articles: DataFrame, schedule: DataFrame, late: str = "3 days", ts: str = "timestamp_utc") -> DataFrame:
    """Articles of each (session_open, ticker) and their mean score; a session closes once the watermark has passed its open."""
    marked = aligned(articles, schedule, ts).withWatermark("session_open", late)
    return marked.groupBy("session_open", "ticker").agg(F.count("*").alias("n_articles"), F.avg("score").alias("mean_score"))


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes everything there is, each batch exactly once, and ends."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
