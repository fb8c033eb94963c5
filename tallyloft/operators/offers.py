"""Offers rolled up to vehicles, compared with cohorts, ranked and paged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloft.functions import scores

COHORT = ["brand", "model", "variant", "mfg_year", "condition", "price_basis"]


def cheapest(column: str, price: str = "price_lakh", tie: str = "listing_id") -> Column:
    """The column's value, null or not, in the row with the least price; null prices last, then the least tie."""
    return F.min_by(F.struct(column), F.struct(F.col(price).isNull(), F.col(price), F.col(tie)))[column]


def roll_up(offers: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """One row for each key: least price, carried attributes of the cheapest offer, sources, and all offers in order."""
    nested = F.struct(F.col("price_lakh").isNull().alias("unpriced"), "price_lakh", "source", "listing_id")
    return offers.groupBy(*keys).agg(
        F.min("price_lakh").alias("price_lakh"),
        *(cheapest(c).alias(c) for c in carried),
        F.bool_and("data_consistent").alias("data_consistent"),
        F.countDistinct("source").alias("source_count"),
        F.array_sort(F.collect_list(nested)).alias("offers"),
    )


def cohorts(offers: DataFrame, entity: str = "vehicle_id", keys: list[str] = COHORT, least: int = 3) -> DataFrame:
    """Number and median price of the consistent vehicles of each cohort; the median only from ``least`` on, for known years and used or demo ones.

    Built from all offers before a buyer's refinements: these must not move the market they are compared with.
    """
    vehicles = offers.groupBy(entity, *keys).agg(F.min("price_lakh").alias("price_lakh"), F.bool_and("data_consistent").alias("ok"))
    median = F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY price_lakh) FILTER (WHERE ok)")
    counted = vehicles.groupBy(*keys).agg(F.count_if("ok").alias("comparable_count"), median.alias("__m"))
    sound = (F.col("comparable_count") >= least) & F.col("mfg_year").isNotNull() & F.col("condition").isin("used", "demo")
    return counted.withColumn("comp_median", F.when(sound, F.col("__m"))).drop("__m")


def with_cohorts(grouped: DataFrame, cohort: DataFrame, keys: list[str] = COHORT, optional: tuple[str, ...] = ("variant", "mfg_year")) -> DataFrame:
    """``grouped`` joined to its cohorts, null-safe on optional keys only, so that it stays an equality join."""
    right = cohort.select(*(F.col(k).alias(f"__{k}") for k in keys), "comparable_count", "comp_median")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) if k in optional else F.col(k) == F.col(f"__{k}") for k in keys]
    return grouped.join(right, on).drop(*(f"__{k}" for k in keys))


def gapped(df: DataFrame) -> DataFrame:
    df = df.withColumn("gap", scores.gap_percent(F.col("comp_median"), F.col("price_lakh"), F.col("comparable_count")))
    return df.withColumn("match", scores.match_rank(F.col("gap"), F.col("source_count"), F.col("identity_confidence"), F.col("km"), F.col("owners")))


ORDERS = {
    "price": lambda: F.col("price_lakh").asc_nulls_last(),
    "km": lambda: F.col("km").asc_nulls_last(),
    "year": lambda: F.col("mfg_year").desc_nulls_last(),
    "gap": lambda: F.col("gap").desc_nulls_last(),
    "match": lambda: F.col("match").desc_nulls_last(),
}


def ordering(sort: str) -> list[Column]:
    """The sort's column, then ties: price, newest, vehicle, price basis."""
    return [ORDERS[sort](), F.col("price_lakh").asc_nulls_last(), F.col("observed_at").desc_nulls_last(), F.col("vehicle_id").asc(), F.col("price_basis").asc()]


def page(df: DataFrame, sort: str, limit: int, offset: int = 0, total: int | None = None) -> DataFrame:
    """A page with ``result_order``; only offset + limit rows are ever gathered. Limits are held to 1..2000 and 0..1,000,000.

    With the ``total`` known, a page may start anywhere up to it, and one past the last result is empty and ranks nothing.
    """
    from pyspark.sql import Window

    limit, offset = max(1, min(2000, limit)), max(0, min(max(1_000_000, total or 0), offset))
    order = ordering(sort)
    top = df.orderBy(*order).limit(0 if total is not None and offset >= total else offset + limit)
    return top.withColumn("result_order", F.row_number().over(Window.orderBy(*order))).filter(F.col("result_order") > offset)


def page_with_total(df: DataFrame, paged: DataFrame) -> DataFrame:
    """The page beside the exact total; if the page is empty, one row with the total remains."""
    total = df.agg(F.count("*").alias("total_count"))
    return total.join(paged, F.lit(True), "left")


def facets(df: DataFrame, city: str = "location", source: str = "source") -> DataFrame:
    """One row: how many results, how many and which cities and sources; null cities are left out."""
    return df.agg(
        F.count("*").alias("result_count"),
        F.countDistinct(city).alias("city_count"),
        F.array_join(F.sort_array(F.collect_set(city)), "|").alias("cities"),
        F.array_join(F.sort_array(F.collect_set(source)), "|").alias("sources"),
    )
