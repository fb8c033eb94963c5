"""Scan ledger: batches, their members, evidence, and what may be retired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloft.operators.planning import within_budget


def batch_id(*parts: Column) -> Column:
    """The same batch always gets the same id, so that writing it again changes nothing."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def verified(batches: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Each batch with its number of members and whether it has none."""
    counted = members.groupBy(key).agg(F.count("*").alias("members"))
    out = batches.join(counted, key, "left").withColumn("members", F.coalesce("members", F.lit(0).cast("long")))
    return out.withColumn("missing", F.col("members") == 0)


def append_once(ledger: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The ledger with the batch's rows unless its id is there."""
    return ledger.unionByName(batch.join(ledger.select(key).distinct(), key, "left_anti"))


def absent_scopes(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Scopes that were planned and not seen. Absence is reported, never a deletion."""
    return expected.select(*keys).distinct().join(observed.select(*keys), keys, "left_anti")


def retention(rows: DataFrame, referenced: DataFrame, keys: list[str], group: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """Rows nothing refers to, oldest first, as far as each group's budget goes."""
    return within_budget(rows.join(referenced.select(*keys).distinct(), keys, "left_anti"), group, order, size, budget)
