"""Named predicates that decide and explain. A predicate that is null fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = dict[str, Column]


def holds(rules: Rules) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(r, F.lit(False)) for r in rules.values()), F.lit(True))


def reasons(rules: Rules) -> Column:
    """Names of the rules that fail, in their order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(r, F.lit(False)), F.lit(name)) for name, r in rules.items())))


def judged(df: DataFrame, rules: Rules) -> DataFrame:
    return df.withColumn("eligible", holds(rules)).withColumn("exclusion_reasons", reasons(rules))


def reason_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """How many rows each rule excludes; a row may count for several."""
    return df.select(F.explode(reasons(rules)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def source_applies(conditions: Column, brands: Column, segments: Column, condition: str | None, brand: str | None, segment: str | None) -> Column:
    """Whether a source's capability lists admit the intent; an empty list admits all."""

    def admits(have: Column, want: str | None) -> Column:
        return F.lit(True) if want is None else (F.size(have) == 0) | F.array_contains(have, want) | F.array_contains(have, "all")

    return admits(conditions, condition) & admits(brands, brand) & admits(segments, segment)
