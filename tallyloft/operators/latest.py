"""Latest observation of each key, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The row of each key with the greatest ``at``, then the greatest ``tie``; null times come last.

    Spark keeps one row of each key before the shuffle, so a hot key costs no more than its tasks. Choose
    the latest first and filter after: an old available row must not bring back what was sold since.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc_nulls_last())
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def latest_as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, seen_at: str, tie: str, carry: list[str]) -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` of its keys that is not after it; nulls if there is none.

    One sort of both sides together instead of a range join: no pair of rows is formed.
    """
    facts = right.select(*keys, F.col(seen_at).alias("__t"), F.lit(0).alias("__side"), F.col(tie).cast("string").alias("__tie"), F.struct(*carry).alias("__fact"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("__row"))
    asks = left.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("string").alias("__tie"), F.lit(None).cast(facts.schema["__fact"].dataType).alias("__fact"), F.struct("*").alias("__row"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    both = facts.unionByName(asks).withColumn("__seen", F.last("__fact", ignorenulls=True).over(w))
    return both.filter("__side = 1").select("__row.*", *(F.col(f"__seen.{c}").alias(c) for c in carry))


def change(df: DataFrame, keys: list[str], at: str, tie: str, value: str, least: Column | float = 0.02) -> DataFrame:
    """``previous``, ``delta`` and ``changed`` (first, or moved by ``least`` of the previous value or more) of each row."""
    w = Window.partitionBy(*keys).orderBy(F.col(at), F.col(tie))
    df = df.withColumn("previous", F.lag(value).over(w))
    moved = F.abs(F.col(value) - F.col("previous")) >= F.lit(least) * F.abs(F.col("previous"))
    return df.withColumn("delta", F.col(value) - F.col("previous")).withColumn("changed", F.col("previous").isNull() | F.coalesce(moved, F.lit(False)))


def failure_streaks(df: DataFrame, keys: list[str], at: str, tie: str, failed: Column) -> DataFrame:
    """``streak``: failures in a row up to each row, 0 after a success."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    marked = df.withColumn("__f", F.coalesce(failed, F.lit(False)))
    island = F.sum(F.when(F.col("__f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    run = Window.partitionBy(*keys, "__i").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("__i", island).withColumn("streak", F.sum(F.col("__f").cast("long")).over(run)).drop("__f", "__i")
