"""Duplicate offers: exact by normalised text, fuzzy by a greedy pass in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloft.functions import text


def exact(df: DataFrame, column: str, order: str) -> DataFrame:
    """``representative``: the least ``order`` among rows of the same text, white space and case aside; nulls stand alone.

    Groups are made by a hash and a partial minimum, then joined back; a hot text is a row in the small side.
    """
    keyed = df.withColumn("__key", F.sha2(F.lower(text.collapse(F.col(column))), 256))
    first = keyed.filter("__key IS NOT NULL").groupBy("__key").agg(F.min(order).alias("representative"), F.count("*").alias("copies"))
    out = keyed.join(first, "__key", "left")
    return out.withColumn("representative", F.coalesce("representative", F.col(order))).withColumn("copies", F.coalesce("copies", F.lit(1).cast("long"))).drop("__key")


def indel_ratio(a: str, b: str) -> float:
    """200 * LCS / (len a + len b); 100 for two empty texts. Bit-parallel, a row of the table is one integer."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


# How far apart two records of one vehicle may be.
YEARS_APART, KM_APART, KM_SHARE = 1, 1500, 0.12


def first_similar(year: list, km: list, title: list, least: float = 82.0) -> list[int]:
    """The group of each row, in the given order: the oldest group whose first row is similar, else one of its own.

    Year and mileage of all groups are compared at once; titles, by an indel ratio of ``least`` or more, only where these
    agree. What is missing tells nothing apart.
    """
    known = lambda values: np.array([np.nan if not v else float(v) for v in values])
    years, kms, names = known(year), known(km), [t.lower() if t else None for t in title]
    heads, out = np.zeros(len(names), np.int64), []
    groups = 0
    for row, name in enumerate(names):
        of = heads[:groups]
        # A comparison with what is missing is false, so it rules nothing out.
        apart = (np.abs(years[of] - years[row]) > YEARS_APART) | (np.abs(kms[of] - kms[row]) > np.fmax(KM_APART, KM_SHARE * kms[row]))
        near = (g for g in np.flatnonzero(~apart).tolist() if name is None or names[heads[g]] is None or indel_ratio(name, names[heads[g]]) >= least)
        group = next(near, groups)
        if group == groups:
            heads[groups] = row
            groups += 1
        out.append(group)
    return out


def fuzzy(df: DataFrame, least: float = 82.0) -> DataFrame:
    """``group_id`` (id of the group's first row) for rows of id, brand, model, year, km, title.

    Greedy inside each (brand, model), in order of id; rows without brand or model stand alone. Exact
    repeats of all compared fields are one row in the pass, so a block is as large as its different rows.
    """
    known = F.coalesce(F.trim("brand"), F.lit("")).cast("string").isin("") | F.coalesce(F.trim("model"), F.lit("")).isin("")
    fields = ["brand", "model", "year", "km", "title"]
    single = df.filter(known).select("id", F.col("id").alias("group_id"))
    rest = df.filter(~known)
    firsts = rest.groupBy(*fields).agg(F.min("id").alias("id"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").astype(object)
        pdf = pdf.where(pdf.notna(), None)
        groups = np.array(first_similar(pdf["year"].tolist(), pdf["km"].tolist(), pdf["title"].tolist(), least))
        ids = pdf["id"].to_numpy(np.int64)
        _, first = np.unique(groups, return_index=True)
        return pd.DataFrame({"first_id": ids, "group_id": ids[first][groups]})

    found = firsts.groupBy("brand", "model").applyInPandas(block, "first_id long, group_id long")
    named = firsts.join(found, firsts["id"] == found["first_id"]).select(*(F.col(f).alias(f"__{f}") for f in fields), "group_id")
    on = [F.col(f).eqNullSafe(F.col(f"__{f}")) for f in fields]
    return rest.join(named, on).select("id", "group_id").union(single)
