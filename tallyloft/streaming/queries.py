"""Streams as queries: run over all there is, and read back."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloft.plans.queries import query
from tallyloft.sources.tables import OBSERVATIONS_SQL, table
from tallyloft.streaming import streams


def _folder(spark: SparkSession) -> str:
    """The shared folder the session names; only a local session may do without and take a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or "file://" + tempfile.mkdtemp(prefix="tallyloft-")).rstrip("/")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = streams.read_stream(spark, sf_dir, table(spark, sf_dir, "events").schema, "events.parquet")
    return raw.select(F.col("event_id").alias("observation_id"), F.col("user_id").alias("listing_id"), F.col("ts").alias("observed_at"), "event_type", F.col("value").alias("price"), (F.col("event_type") == "error").alias("negative"))


@query("stream_latest", f"""WITH obs AS ({OBSERVATIONS_SQL}) SELECT listing_id, observation_id, price, negative FROM (
    SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, observation_id DESC) AS rn FROM obs) WHERE rn = 1""")
def stream_latest(spark, sf_dir):
    out = streams.drain(streams.latest_stream(_stream(spark, sf_dir)), "update", _folder(spark))
    return streams.last_batch(out, ["listing_id"])


@query("stream_demand", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS searches FROM events GROUP BY 1, 2")
def stream_demand(spark, sf_dir):
    out = streams.drain(streams.demand_stream(_stream(spark, sf_dir), "observed_at", ["event_type"]), "update", _folder(spark))
    return streams.last_batch(out, ["hour", "event_type"]).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "searches")


@query("stream_breaker", f"""WITH obs AS ({OBSERVATIONS_SQL}), last_good AS (SELECT listing_id, max((observed_at, observation_id)) FILTER (WHERE NOT negative) AS g FROM obs GROUP BY 1),
  s AS (SELECT o.listing_id, count(*) FILTER (WHERE negative AND (g IS NULL OR (observed_at, observation_id) > g)) AS streak FROM obs o JOIN last_good USING (listing_id) GROUP BY 1)
  SELECT listing_id, streak, CASE WHEN streak >= 3 THEN 'open' ELSE 'closed' END AS circuit, CASE WHEN streak >= 3 THEN CAST(least(360, 15 * power(2, least(5, streak - 3))) AS INTEGER) END AS cooldown FROM s""")
def stream_breaker(spark, sf_dir):
    out = streams.drain(streams.breaker_stream(_stream(spark, sf_dir)), "update", _folder(spark))
    return streams.last_batch(out, ["listing_id"])


