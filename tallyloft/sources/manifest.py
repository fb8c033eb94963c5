"""Versioned tables: a generation is written whole, then a manifest names it; readers follow the manifest.

A manifest is one row of Parquet in a folder of its own number, so publishing is one rename by Spark's
committer, and a reader that has read a number keeps its snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def versions(spark: SparkSession, root: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = (s.getPath() for s in fs.listStatus(path))
    return sorted(int(p.getName()) for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def publish(df: DataFrame, root: str, revision: int, keep: int = 2) -> int:
    """Write a generation built at ``revision`` of its source and point to it; older ones but ``keep`` go."""
    spark = df.sparkSession
    seen = versions(spark, root)
    n = (seen[-1] if seen else 0) + 1
    df.write.mode("overwrite").parquet(f"{root}/data/{n}")
    spark.range(1, numPartitions=1).select(F.lit(n).alias("generation"), F.lit(revision).cast("long").alias("revision")).write.parquet(f"{root}/manifest/{n}")
    for old in seen[: max(0, len(seen) + 1 - keep)]:
        for part in ("manifest", "data"):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{part}/{old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def read(spark: SparkSession, root: str, revision: int | None = None, fallback: DataFrame | None = None) -> DataFrame:
    """The newest generation; with ``revision``, only if it was built at it, else ``fallback``."""
    seen = versions(spark, root)
    if seen:
        row = spark.read.parquet(f"{root}/manifest/{seen[-1]}").first()
        if revision is None or row["revision"] == revision:
            return spark.read.parquet(f"{root}/data/{seen[-1]}")
    if fallback is None:
        raise LookupError("no generation of the revision asked for")
    return fallback
