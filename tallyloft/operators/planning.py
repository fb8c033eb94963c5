"""Demand, refresh queues, fair interleaving, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloft.functions import timing


def demand(events: DataFrame, at: str, keys: list[str], hits: Column) -> DataFrame:
    """Hourly searches, hits and hit rate of each key."""
    out = events.groupBy(F.date_trunc("hour", at).alias("hour"), *keys).agg(F.count("*").alias("searches"), F.count_if(hits).alias("hits"))
    return out.withColumn("hit_rate", F.round(F.try_divide(F.col("hits").cast("double"), F.col("searches").cast("double")), 4))


def refresh_queue(demands: DataFrame, sources: DataFrame, queue: DataFrame | None, now: Column, key: list[str]) -> DataFrame:
    """Each demand with its source, freshness and priority; jobs that are running are left out."""
    out = demands.join(sources, "source_id")
    state = timing.freshness(F.col("last_verified_at"), now)
    out = out.withColumn("freshness", state).filter("freshness <> 'fresh' OR hits < searches")
    out = out.withColumn("priority", timing.refresh_priority(F.col("searches"), F.col("hits"), F.col("reliability"), F.col("freshness")))
    return out if queue is None else out.join(queue.filter("status = 'running'").select(*key), key, "left_anti")


def fair_slots(df: DataFrame, pool: Column, order: list[Column], every: int = 5) -> DataFrame:
    """``slot`` of each row: one of ``every`` slots goes to pool B (``pool`` true); a pool that is empty lends its slots.

    In closed form: the i-th row of B sorts at every * (i - 1), the j-th of A at j + (j - 1) div (every - 1).
    Rows are ranked within their pool only, so call it on a bounded plan, as a probe budget is.
    """
    rank = F.row_number().over(Window.partitionBy(pool).orderBy(*order))
    key = F.when(pool, every * (rank - 1)).otherwise(rank + F.floor((rank - 1) / (every - 1)))
    return df.withColumn("slot", key.cast("long"))


def within_quota(df: DataFrame, day: Column, order: list[Column], quota: int) -> DataFrame:
    """The first ``quota`` rows of each day."""
    return df.withColumn("call", F.row_number().over(Window.partitionBy(day).orderBy(*order))).filter(F.col("call") <= quota)


def within_budget(df: DataFrame, group: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """Rows of each group while their running size stays within the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).filter(F.col("running") <= budget)


def alternate(df: DataFrame, column: str, turns: tuple[str, str], order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` ``slot`` s (from 1), dealt in turn to the two values of a column; when one runs out, the other has all that follow.

    Each value's rows are cut to ``limit`` by a group limit before they move, so its size does not matter.
    """
    rank = F.row_number().over(Window.partitionBy(column).orderBy(*order))
    kept = df.filter(F.col(column).isin(*turns)).withColumn("__rank", rank).filter(F.col("__rank") <= limit)
    fewer = min(df.agg(*(F.count_if(F.col(column) == t) for t in turns)).first())
    slot = F.when(F.col("__rank") <= fewer, 2 * F.col("__rank") - (F.col(column) == turns[0]).cast("int")).otherwise(fewer + F.col("__rank"))
    return kept.withColumn("slot", slot.cast("long")).filter(F.col("slot") <= limit).select(*df.columns, "slot")


def deferred(jobs: DataFrame, blocked: Column, delay: str = "INTERVAL 1 MINUTE") -> DataFrame:
    """Jobs (status, attempts, due); those that found their lock taken are queued again after a delay, and that attempt does not count."""
    taken = F.coalesce(blocked, F.lit(False))
    return jobs.withColumns(
        {
            "status": F.when(taken, "queued").otherwise(F.col("status")),
            "attempts": F.when(taken, F.greatest(F.lit(0), F.col("attempts") - 1)).otherwise(F.col("attempts")),
            "due": F.when(taken, F.col("due") + F.expr(delay)).otherwise(F.col("due")),
        }
    )
