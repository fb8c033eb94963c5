"""File sources and sinks with declared schemas: feeds, logs, registries, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OFFER = """source string, source_listing_id string, brand string, model string, variant string, listing_name string, url string, final_url string,
price_lakh double, price_basis string, mfg_year int, registration_year int, km double, owners int, fuel string, transmission string, body_type string,
condition_signal string, seller_city string, seller_state string, live_verified boolean, sold_signal boolean, data_consistent boolean, images array<string>, metadata map<string,string>"""
REGISTRY_FIELDS = ("name", "url", "adapter_status", "source_type", "priority", "conditions", "brands", "segments")
REGISTRY = "name string, url string, adapter_status string, source_type string, priority int, conditions array<string>, brands array<string>, segments array<string>, metadata map<string,string>"


def feed(spark: SparkSession, path: str, schema: str = OFFER) -> DataFrame:
    """A JSON-lines feed of offers; fields that are not declared are dropped, broken lines give null rows, left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def registry(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Registry entries, parsed on the driver, as rows; what is not a declared field goes to ``metadata``."""
    rows = []
    for e in entries:
        rest = {k: v if isinstance(v, str) else json.dumps(v, sort_keys=True) for k, v in e.items() if k not in REGISTRY_FIELDS}
        rows.append((e["name"], e.get("url"), e.get("adapter_status", "candidate"), e.get("source_type"), int(e.get("priority", 50)), list(e.get("conditions", [])), list(e.get("brands", [])), list(e.get("segments", [])), rest))
    return spark.createDataFrame(rows, REGISTRY)


def log_events(spark: SparkSession, path: str, schema: str, most: int = 200, longest: int = 65536) -> DataFrame:
    """JSON objects at the ends of log lines, the last ``most``; longer lines than ``longest`` and others are left out."""
    lines = spark.read.text(path).filter(F.length("value") <= longest)
    tail = F.regexp_extract("value", r"(\{.*\})\s*$", 1)
    return lines.select(F.regexp_extract("value", r"^(\S+)", 1).alias("at"), F.from_json(tail, schema).alias("event")).filter("event IS NOT NULL").orderBy(F.desc("at")).limit(most)


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def to_markdown(df: DataFrame, title: str, most: int = 20) -> str:
    """A small report: the first ``most`` rows as a table."""
    rows = df.limit(most).collect()
    out = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(out + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows]) + "\n"
