"""Coverage, concentration, capacity and recall. Unknown is not zero: a rate without a denominator is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matrix(facts: DataFrame, dimensions: list[str], identity: list[str], at: str = "last_verified_at") -> DataFrame:
    """Observed, eligible and excluded offers and eligible vehicles of each combination that occurs. Needs ``eligible``."""
    return facts.groupBy(*dimensions).agg(
        F.count("*").alias("observed_offers"),
        F.count_if("eligible").alias("eligible_offers"),
        F.count_if(~F.col("eligible")).alias("excluded_offers"),
        F.countDistinct(F.when(F.col("eligible"), F.struct(*identity))).alias("eligible_vehicles"),
        F.max(at).alias("last_verified_at"),
        F.when(F.count_if("eligible") > 0, "partial_observed").otherwise("no_current_eligible_observation").alias("status"),
    )


def concentration(facts: DataFrame, source: str = "source", top: int = 3, listed: int = 10) -> DataFrame:
    """The ``listed`` sources with most eligible offers, their shares, and the share of the first ``top``.

    Ranks are over one row per source, the total over one row.
    """
    by = facts.filter("eligible").groupBy(source).agg(F.count("*").alias("eligible_offers"))
    best = by.orderBy(F.desc("eligible_offers"), source).limit(listed).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("eligible_offers"), source)))
    total = by.agg(F.sum("eligible_offers").alias("total"), F.count("*").alias("contributing_sources"))
    lead = best.filter(F.col("rank") <= top).agg(F.sum("eligible_offers").alias("lead"))
    share = lambda c: F.round(100 * c / F.col("total"), 2)
    return best.crossJoin(total).crossJoin(lead).select(source, "rank", "eligible_offers", share(F.col("eligible_offers")).alias("share_percent"), share(F.col("lead")).alias("top_share_percent"), "contributing_sources")


def capacity(offers: DataFrame, condition: str, target: Column, overdue: Column, ready: Column, enrolled: Column, limit: int = 10, interval: int = 15) -> DataFrame:
    """Checks needed an hour against those reserved, by condition: demo gets the larger half of the attempts."""
    slots = F.when(F.col(condition) == "demo", (limit + 1) // 2).otherwise(limit // 2)
    out = offers.filter(F.col(condition).isin("used", "demo")).groupBy(condition).agg(
        F.count("*").alias("renewable_offers"),
        F.sum(60.0 / target).alias("needed"),
        F.count_if(overdue).alias("overdue_offers"),
        F.count_if(ready).alias("ready_jobs"),
        F.count_if(~enrolled).alias("not_enrolled"),
    )
    hourly = slots * 60.0 / interval
    return out.select(
        condition, "renewable_offers", "overdue_offers", "ready_jobs", "not_enrolled",
        F.round("needed", 2).alias("demand_per_hour"), F.round(hourly, 2).alias("reserved_per_hour"),
        F.round(F.try_divide(hourly, F.col("needed")), 4).alias("capacity_ratio"),
        F.ceil(F.try_divide(F.col("needed"), hourly)).cast("long").alias("budgets"),
        F.round(F.try_divide(F.col("overdue_offers").cast("double"), hourly), 2).alias("backlog_hours"),
    )


def recall(sample: DataFrame, offers: DataFrame, key: Column, urls: list[str], attributes: list[str], strata: list[str]) -> DataFrame:
    """Matched and sampled listings, overall and by each stratum. ``key`` is an expression over column ``url``.

    A listing matches if an offer of its source has its key, as any of ``urls``, and the same attributes.
    An offer that two URLs of its own bring in counts once.
    """
    keyed = offers.select("source", *attributes, F.explode(F.array_distinct(F.array_compact(F.array(*urls)))).alias("url")).withColumn("__key", key)
    hits = keyed.select(F.col("source").alias("__s"), F.col("__key").alias("__k"), *(F.col(a).alias(f"__{a}") for a in attributes)).distinct()
    asked = sample.filter("eligible").withColumn("__key", key).withColumn("__id", F.monotonically_increasing_id())
    on = (F.col("source") == F.col("__s")) & (F.col("__key") == F.col("__k"))
    for a in attributes:
        on = on & (F.col(a) == F.col(f"__{a}"))
    found = asked.join(hits.dropDuplicates(["__s", "__k", *(f"__{a}" for a in attributes)]), on, "left").withColumn("hit", F.col("__k").isNotNull())
    dims = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *(F.struct(F.lit(s).alias("dimension"), F.col(s).cast("string").alias("value")) for s in strata))
    long = found.select("hit", F.inline(dims))
    out = long.groupBy("dimension", "value").agg(F.count("*").alias("eligible_sample"), F.count_if("hit").alias("matched"))
    return out.withColumn("recall", F.round(F.try_divide(F.col("matched").cast("double"), F.col("eligible_sample").cast("double")), 6))


def quality(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """How many rows there are and what percentage has each field; null without rows."""
    share = lambda c: F.round(F.try_divide(100.0 * F.count_if(c), F.count("*").cast("double")), 1)
    return rows.agg(F.count("*").alias("rows"), *(share(c).alias(f"{name}_percent") for name, c in fields.items()))
