"""Validation that explains itself: samples, ledger evidence, replayed captures, routes of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloft.functions import url


def sample_problems(sample: DataFrame, collected: Column, now: Column, hours: int = 24) -> DataFrame:
    """``problems`` of each sampled listing: labels missing, condition unknown, URL not public, stale or future, listed twice.

    Listed twice: an earlier row (by ``id``) has the same source and the same URL but for tracking.
    """
    u, blank = F.col("url"), lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    key = url.url_key(u)
    repeat = F.row_number().over(Window.partitionBy(F.lower(F.trim("source")), key).orderBy("id")) > 1
    fresh = (collected <= now) & (collected >= now - F.make_dt_interval(hours=F.lit(hours)))
    rules = {
        "labels": ~(blank("source") | blank("brand") | blank("model")),
        "condition": F.col("condition").isin("used", "demo"),
        "eligible": F.col("eligible").isNotNull(),
        "url": key.isNotNull() & ~F.contains(url.host(u), F.lit("@")),
        "collected": fresh,
        "duplicate": ~(repeat & key.isNotNull()),
    }
    return sample.withColumn("problems", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()))))


def ledger_evidence(rows: DataFrame, contract: int, flags: tuple[str, ...], payload: str, fingerprint: str) -> DataFrame:
    """``valid``: the contract's version, flags that grant nothing, and a fingerprint that is the payload's hash."""
    ok = (F.col("version") == contract) & (F.sha2(F.col(payload), 256) == F.col(fingerprint))
    for f in flags:
        ok = ok & ~F.coalesce(F.col(f), F.lit(True))
    return rows.withColumn("valid", F.coalesce(ok, F.lit(False)))


def replay(expected: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """matched, drift or unavailable for each captured page, by a hash of its rows in any order."""
    line = F.sha2(F.to_json(F.struct(*(F.col(f).cast("string").alias(f) for f in fields)), {"ignoreNullFields": "false"}), 256)
    digest = lambda df, name: df.groupBy(key).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(line))), 256).alias(name))
    both = digest(expected, "want").join(digest(found, "got"), key, "left")
    return both.select(key, F.when(F.col("got").isNull(), "unavailable").when(F.col("got") == F.col("want"), "matched").otherwise("drift").alias("status"))


def route(template: Column, override: Column, values: dict[str, Column]) -> Column:
    """A source's URL: the override if there is one, else its template, with {names} filled in; null if one has no value."""
    out = F.coalesce(override, template)
    for name, v in values.items():
        hole = F.lit("{" + name + "}")
        out = F.when(F.contains(out, hole) & v.isNull(), F.lit(None)).otherwise(F.replace(out, hole, F.coalesce(v, F.lit(""))))
    return out


def survivors(rows: DataFrame, pairs: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``kept``: the best by ``order`` of each group of ``pairs`` (id, group_id); rows in no group are kept."""
    w = Window.partitionBy("group_id").orderBy(*order)
    joined = rows.join(pairs, "id", "left").withColumn("group_id", F.coalesce("group_id", F.col("id")))
    return joined.withColumn("kept", F.row_number().over(w) == 1)
