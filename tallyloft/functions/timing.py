"""Freshness, expiry, delays and priorities. "Now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TARGET, STALE, EXPIRE = 360, 1440, 10080


def age_minutes(at: Column, now: Column) -> Column:
    """Minutes since ``at``, not below 0."""
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.greatest(F.lit(0.0), seconds / F.lit(60_000_000.0))


def freshness(at: Column, now: Column, target: int = TARGET, stale: int = STALE, expire: int = EXPIRE) -> Column:
    """fresh, aging, stale or expired; a null time is expired."""
    age = age_minutes(at, now)
    return F.when(at.isNull(), "expired").when(age <= target, "fresh").when(age <= stale, "aging").when(age <= expire, "stale").otherwise("expired")


def expiry_minutes(condition: Column, source_minutes: Column, cap: int = 10080, demo: int = 1440, used: int = 2880) -> Column:
    """The least of the global cap, the source's own and the condition's; a minute at least."""
    cap, demo, used = max(60, cap), max(60, demo), max(60, used)
    return F.least(F.lit(cap), F.greatest(F.lit(1), source_minutes), F.when(condition == "demo", demo).otherwise(min(cap, used)))


def retry_delay(failures: Column) -> Column:
    """Minutes: 15 doubled per failure up to 360; a day from five failures on."""
    return F.when(failures >= 5, 1440).otherwise(F.least(F.lit(360), (F.lit(15) * F.pow(F.lit(2), F.least(failures, F.lit(5)))).cast("int")))


def breaker_cooldown(failures: Column, threshold: int = 3, minutes: int = 15) -> Column:
    """Minutes a circuit stays open after ``failures`` in a row; null below the threshold."""
    over = F.least(F.lit(5), F.greatest(F.lit(0), failures - threshold))
    return F.when(failures >= threshold, F.least(F.lit(360), (minutes * F.pow(F.lit(2), over)).cast("int")))


def refresh_priority(searches: Column, hits: Column, reliability: Column, state: Column) -> Column:
    gap = F.greatest(F.lit(0), searches - hits)
    weight = F.when(state == "fresh", 0.0).when(state == "aging", 1.0).when(state == "stale", 3.0).otherwise(6.0)
    return F.round((gap + 1) * F.greatest(F.lit(0.1), reliability) * (1 + weight), 4)


def register(spark, name: str = "freshness_state") -> None:
    """The freshness rule as a SQL function (at, now) of the session, inlined by the optimizer where it is used."""
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(seen TIMESTAMP, now TIMESTAMP) RETURNS STRING RETURN
        CASE WHEN seen IS NULL THEN 'expired' WHEN (unix_micros(now) - unix_micros(seen)) <= {TARGET} * 60000000L THEN 'fresh'
             WHEN (unix_micros(now) - unix_micros(seen)) <= {STALE} * 60000000L THEN 'aging'
             WHEN (unix_micros(now) - unix_micros(seen)) <= {EXPIRE} * 60000000L THEN 'stale' ELSE 'expired' END"""
    )
