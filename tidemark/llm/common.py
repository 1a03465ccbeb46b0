"""Shared pieces: shared-folder tables, skew-safe lookups and connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A key is hot when it holds more than 1 / HOT_SHARE of the rows, so at most HOT_SHARE keys are hot.
HOT_SHARE = 1000
HOT_LEAST = 1000
_LOCAL: dict[str, str] = {}
#: Paths of the tables made in this process and not yet released.
_MADE: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and all runs in one process (tests), a temporary one.

    On a cluster an executor's own folder is no place for tables: without a shared one this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _LOCAL:
            folder = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _LOCAL[application] = f"file://{folder}"
        named = _LOCAL[application]
    return named.rstrip("/")


def materialise(df: DataFrame, tag: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    _MADE.add(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tidemark_path = path
    return back


def release(df: DataFrame) -> None:
    """Delete a table made by materialise() that no later plan reads."""
    _delete(df.sparkSession, df._tidemark_path)


def release_all(spark: SparkSession, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete all tables made so far but those in `keep`: for when no other result of this process is still to be read."""
    kept = {df._tidemark_path for df in keep}
    for path in sorted(_MADE - kept):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _MADE.discard(path)


def lookup(rows: DataFrame, key: str, table: DataFrame, count: str, total: int, spread: str) -> DataFrame:
    """Left join `rows` to `table` (one row per `key`, `count` = how many rows carry that key).

    A plain shuffle join would put all rows of a frequent key into one task. Keys with more than a
    1/HOT_SHARE share of the `total` rows, of which there are at most HOT_SHARE, are joined by
    broadcast; their rows are then dealt out by `spread` in the shuffle join that serves the rest.
    Rows with a null key get nulls. A table that is not yet in the shared folder is written there first:
    it is read twice, and the partitioning by key that made it would otherwise be taken over for the rows.
    """
    if not hasattr(table, "_tidemark_path"):
        table = materialise(table, "lookup")
    least = max(HOT_LEAST, total // HOT_SHARE)
    values = [c for c in table.columns if c != key]
    packed = table.select(F.col(key).alias("_k"), F.struct(*values).alias("_v"), F.col(count).alias("_n"))
    hot = F.broadcast(packed.where(F.col("_n") >= least).select("_k", F.col("_v").alias("_hot")))
    cold = packed.where(F.col("_n") < least).select("_k", F.col("_v").alias("_cold"), F.lit(0).cast("long").alias("_s"))
    own = rows.columns
    rows = rows.join(hot, rows[key] == hot["_k"], "left").drop("_k")
    aside = F.col("_hot").isNotNull() | F.col(key).isNull()
    rows = rows.withColumn("_s", F.when(aside, F.xxhash64(F.col(spread)).bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long")))
    out = rows.alias("r").join(cold.alias("c"), (F.col(f"r.{key}") == F.col("c._k")) & (F.col("r._s") == F.col("c._s")), "left")
    return out.select(*[F.col(f"r.{c}") for c in own], *[F.coalesce(F.col(f"r._hot.{c}"), F.col(f"c._cold.{c}")).alias(c) for c in values])


def connected_components(edges: DataFrame, tag: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (u, v long); component is the smallest node reachable.

    Alternating large-star and small-star steps, each a group-by and an equi-join, each round written
    to the shared folder. Stars shrink in a logarithmic number of rounds. Hubs, nodes with a large share of
    all edges, meet their least neighbour by broadcast (lookup()), so no task holds a hub's edges. Nothing is
    collected but one row of checksums.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
    mark = _mark(now)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = lookup(both.where("v > u"), "u", low, "n", 2 * mark[0], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = materialise(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), f"{tag}-down")
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = lookup(down, "u", least, "n", mark[0], "v").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = materialise(small, tag)
        new = _mark(after)
        release(now)
        release(down)
        now, old, mark = after, mark, new
        if new == old:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
