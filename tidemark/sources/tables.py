"""Readers and writers: pruned Parquet scans, CSV, idempotent chunks, caches, Markdown tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import fixed


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_columns(spark: SparkSession, path: str, wanted: list[str], strict: bool = True) -> DataFrame:
    """The wanted columns of a Parquet table; with `strict` off, those that it has."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no table at {path}; run the pipeline that writes it first")
    df = spark.read.parquet(path)
    lacking = [c for c in wanted if c not in df.columns]
    if lacking and strict:
        raise ValueError(f"{path} lacks {lacking}")
    return df.select(*[c for c in wanted if c in df.columns])


def read_corpus(spark: SparkSession, path: str, columns: tuple[str, ...] = ("article_id", "timestamp_utc")) -> DataFrame:
    """A corpus scan with its times as UTC timestamps."""
    df = read_columns(spark, path, list(columns))
    return df.withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp")) if "timestamp_utc" in columns else df


def read_all(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Several Parquet tables; all that are missing are named at once."""
    lacking = [f"{k}: {p}" for k, p in paths.items() if not exists(spark, p)]
    if lacking:
        raise FileNotFoundError(", ".join(lacking))
    return {k: spark.read.parquet(p) for k, p in paths.items()}


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a table of this application in the folder that spark.checkpoint.dir names, else in the warehouse: both are shared."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tidemark-scratch/{spark.sparkContext.applicationId}/{name}"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def labelling_sample(df: DataFrame, keys: list[str], n: int, seed: int, columns: list[str]) -> DataFrame:
    """A seeded sample with an empty hand_label column to fill in."""
    from tidemark.operators.sentences import sample_rows

    return sample_rows(df, keys, n, seed).select(*columns, F.lit("").alias("hand_label"))


def read_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at `path`, made by build() and written there if it is not yet."""
    if not exists(spark, path):
        write_table(build(), path)
    return spark.read.parquet(path)


def available(spark: SparkSession, path: str, key: str = "ticker") -> list[str]:
    """Registered companies that have a partition under `path`."""
    try:
        found = {r[0] for r in spark.read.parquet(path).select(key).distinct().collect()}
    except AnalysisException:
        return []
    return [t for t in fixed.COMPANIES if t in found]


def read_cache(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A cache table; an empty one where there is none or, unless `strict`, where its columns have changed."""
    wanted = spark.createDataFrame([], schema)
    if not exists(spark, path):
        return wanted
    try:
        found = spark.read.parquet(path)
        lacking = [c for c in wanted.columns if c not in found.columns]
    except AnalysisException:
        if strict:
            raise
        return wanted
    if lacking:
        if strict:
            raise ValueError(f"cache at {path} lacks {lacking}")
        return wanted
    return found.select(*wanted.columns)


def numbered_chunks(df: DataFrame, order: str, size: int = fixed.SCRAPE_CHUNK) -> DataFrame:
    """`df` with chunk: its rows by `order` in runs of `size`, numbered without gathering them in one partition."""
    from tidemark.operators.coverage import distributed_rank

    return distributed_rank(df, order, "_rank").withColumn("chunk", F.floor((F.col("_rank") - 1) / size).cast("long")).drop("_rank")


def process_chunks(chunked: DataFrame, path: str, step) -> DataFrame:
    """Runs step(df) on the chunks not yet under `path`, writes them there by chunk, and reads all back.

    A run that stops loses at most what it had not written; the next one goes on from there.
    """
    spark = chunked.sparkSession
    todo = chunked
    if exists(spark, path):
        done = spark.read.parquet(path).select("chunk").distinct()
        todo = chunked.join(done, "chunk", "left_anti")
    step(todo).write.mode("append").partitionBy("chunk").parquet(path)
    return spark.read.parquet(path)


def markdown(df: DataFrame, header: list[str] | None = None, most: int = 1000) -> str:
    """A report table as Markdown; reports are small, and `most` rows are shown."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(header or df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
