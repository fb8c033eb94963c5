"""Tables of a data folder, and views of them in the roles of an offer catalogue.

A view selects and renames only, so filters and column pruning reach the scan below it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OBSERVATIONS_SQL = """
  SELECT event_id AS observation_id, user_id AS listing_id, ts AS observed_at, event_type, value AS price, props AS snapshot,
         event_type = 'error' AS negative
  FROM events
"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of listings; an error is a negative one."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("observation_id"), F.col("user_id").alias("listing_id"), F.col("ts").alias("observed_at"), "event_type", F.col("value").alias("price"), F.col("props").alias("snapshot"),
        (F.col("event_type") == "error").alias("negative"),
    )


OFFERS_SQL = """
  SELECT l_orderkey * 10 + l_linenumber AS listing_id, l_partkey AS vehicle_id, s_name AS source,
         CAST(s_nationkey % 3 + 1 AS INTEGER) AS source_tier, n_name AS location, r_name AS region,
         p_brand AS brand, p_type AS model, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'v' || CAST(p_size % 2 AS VARCHAR) END AS variant, p_name AS title,
         CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(2015 + p_size % 3 AS INTEGER) END AS mfg_year,
         CASE l_returnflag WHEN 'A' THEN 'used' WHEN 'N' THEN 'demo' ELSE 'new' END AS condition,
         CASE WHEN l_tax > 0.04 THEN 'ex_showroom' ELSE 'on_road' END AS price_basis,
         l_extendedprice / l_quantity AS price_lakh, CAST(l_quantity * 1000 AS BIGINT) AS km, l_linenumber AS owners,
         l_shipdate AS observed_at, l_linestatus = 'O' AS active, l_discount < 0.09 AS data_consistent,
         CAST(p_size % 5 AS DOUBLE) / 8 AS identity_confidence
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as offers, parts as vehicles, suppliers as sources. Small sides are broadcast by their size, by Spark."""
    t = lambda name: table(spark, sf_dir, name)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    size = F.col("p_size")
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("listing_id"),
        F.col("l_partkey").alias("vehicle_id"),
        F.col("s_name").alias("source"),
        (F.col("s_nationkey") % 3 + 1).cast("int").alias("source_tier"),
        F.col("n_name").alias("location"),
        F.col("r_name").alias("region"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("model"),
        F.when(size % 5 != 0, F.concat(F.lit("v"), (size % 2).cast("string"))).alias("variant"),
        F.col("p_name").alias("title"),
        F.when(size % 7 != 0, (size % 3 + 2015).cast("int")).alias("mfg_year"),
        F.when(F.col("l_returnflag") == "A", "used").when(F.col("l_returnflag") == "N", "demo").otherwise("new").alias("condition"),
        F.when(F.col("l_tax") > 0.04, "ex_showroom").otherwise("on_road").alias("price_basis"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_lakh"),
        (F.col("l_quantity") * 1000).cast("long").alias("km"),
        F.col("l_linenumber").alias("owners"),
        F.col("l_shipdate").alias("observed_at"),
        (F.col("l_linestatus") == "O").alias("active"),
        (F.col("l_discount") < 0.09).alias("data_consistent"),
        ((size % 5).cast("double") / 8).alias("identity_confidence"),
    )
