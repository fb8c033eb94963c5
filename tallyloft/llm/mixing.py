"""Mixing sources to target weights by Pfair scheduling; rows are handled in DataFrame operations only.

Each source's rows are shuffled by a hash and cut into blocks of equal size. Block j (from 1) of a source
of weight w may run from slot floor((j - 1) / w) and must have run before slot ceil(j / w). Slots are
given to the released block with the earliest deadline, so that after any number of slots a source has
had within one block of its share. Weights are exact ratios, never rounded, and the schedule covers the whole
horizon. It is a fold whose state is one number a source, a step for each block, done on the driver and
written to the shared folder as it goes, by SQL over literals; rows are joined with it by source and block.

Nothing is dropped. A source with too few blocks starts over ("epoch"), until every source has been used
up at least once; or, without repeats, its slots stay empty once it is used up.

Skew: a row's place in its source is its place in a hash bucket plus the sizes of the buckets before, so
that no task holds a whole source.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tallyloft.llm.common import scratch_path, stored

MOST_SOURCES = 100_000  # what is broadcast has a row for each
BUCKET_ROWS = 1024
CHUNK = 1 << 16  # slots written at a time


def tempered(counts: dict[str | None, int], power: float) -> dict[str | None, float]:
    """Target weights in proportion to size ** power: below 1 it lifts small sources."""
    return {s: n**power for s, n in counts.items() if n}


def whole(weights: dict[str | None, float]) -> dict[str | None, int]:
    """Positive weights as whole numbers in exactly their ratio."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    if len(exact) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    scale = math.lcm(*(x.denominator for x in exact.values()))
    parts = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*parts.values())
    return {s: n // common for s, n in parts.items()}


def names_of(part: dict[str | None, int]) -> list[str | None]:
    return sorted(part, key=lambda s: (s is None, str(s)))


def turns(part: dict[str | None, int], slots: int, blocks: dict[str | None, int] | None = None, repeat: bool = True) -> Iterator[tuple[int, int, int]]:
    """Number of the source, turn (from 0) and slot of each block that runs: earliest deadline first.

    The first ``blocks`` of each source all run, even if their share of ``slots`` is less: a deadline beyond the
    end is moved to the end, and what is left then follows at once, fewer blocks than there are sources. Without
    ``repeat``, no others run.
    """
    names, total = names_of(part), sum(part.values())
    size, must = [part[s] for s in names], [(blocks or {}).get(s, 0) for s in names]
    left = sum(must)

    def block(i: int, j: int) -> tuple[int, int, int, int]:
        deadline = -(-(j + 1) * total // size[i])
        return j * total // size[i], min(deadline, slots) if j < must[i] else deadline, i, j

    waiting, ready, slot = [block(i, 0) for i in range(len(names)) if repeat or must[i]], [], 0
    heapq.heapify(waiting)
    while left or (repeat and slot < slots):
        if not ready and waiting[0][0] > slot:
            slot = waiting[0][0]
        while waiting and waiting[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        _, i, j = heapq.heappop(ready)
        yield i, j, slot
        left -= j < must[i]
        if repeat or j + 1 < must[i]:
            heapq.heappush(waiting, block(i, j + 1))
        slot += 1


def literal(spark, rows: list[dict], kind: str) -> DataFrame:
    """Rows as a table, from a JSON literal."""
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")))


def written(spark, runs: Iterator[tuple[int, int, int]], many: int) -> tuple[DataFrame, list[int]]:
    """``runs`` as a stored table of ``i``, ``turn`` and ``slot``, and how many turns each of ``many`` sources has."""
    path, ran, held = scratch_path(spark, "slots"), [0] * many, {}

    def write() -> None:
        rows = [{"i": i, "first": ran[i] - len(slots), "slots": slots} for i, slots in held.items()]
        table = literal(spark, rows, "i:int,first:bigint,slots:array<bigint>").select("i", "first", F.posexplode("slots").alias("nth", "slot"))
        table.select("i", (F.col("first") + F.col("nth")).alias("turn"), "slot").write.mode("append").parquet(path)
        held.clear()

    for at, (i, _, slot) in enumerate(runs, 1):  # a source's turns come in order
        held.setdefault(i, []).append(slot)
        ran[i] += 1
        if at % CHUNK == 0:
            write()
    write()
    return spark.read.schema("i int, turn long, slot long").parquet(path), ran


def schedule(spark, part: dict[str | None, int]) -> DataFrame:
    """``source``, ``turn`` (from 0) and ``slot`` of one period of weights that are whole parts of it."""
    names = names_of(part)
    runs, _ = written(spark, turns(part, sum(part.values())), len(names))
    source = F.get(F.array(*(F.lit(s).cast("string") for s in names)), F.col("i"))
    return runs.select(source.alias("source"), "turn", "slot")


def placed(df: DataFrame, group: str, size: Column, order: tuple[Column, ...], rows: DataFrame) -> DataFrame:
    """``df`` with ``__start``: the sizes of the rows of its group before it, in hash order; no task holds a group.

    ``rows``: how many rows (``__rows``) each group (``__g``) has; the caller vouches for a bound on the
    number of groups. A group is cut into buckets of about BUCKET_ROWS rows. ``order`` feeds the hash and breaks its ties.
    """
    h = F.xxhash64(*order, F.lit(11))
    many = F.ceil(F.col("__rows") / BUCKET_ROWS)
    cut = df.join(F.broadcast(rows), df[group].cast(rows.schema["__g"].dataType).eqNullSafe(F.col("__g"))).select(*df.columns, h.alias("__h"), size.cast("long").alias("__size"), F.pmod(h, many).cast("int").alias("__bucket"))
    sums = cut.groupBy(group, "__bucket").agg(F.sum("__size").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = stored(sums.select(F.col(group).alias("__g"), F.col("__bucket").alias("__b"), F.coalesce(before, F.lit(0)).alias("__before")), "bucket-sums")
    within = F.sum("__size").over(Window.partitionBy(group, "__bucket").orderBy("__h", *order).rowsBetween(Window.unboundedPreceding, -1))
    ranked = cut.withColumn("__in", F.coalesce(within, F.lit(0)))
    joined = ranked.join(sums, ranked[group].eqNullSafe(sums["__g"]) & (ranked["__bucket"] == sums["__b"]))
    return joined.select(*df.columns, (F.col("__before") + F.col("__in")).alias("__start"))


def mix(
    df: DataFrame,
    weights: dict[str | None, float] | None = None,
    power: float = 1.0,
    source: str = "source",
    size: Column | None = None,
    block: int = 16,
    repeat: bool = True,
    ties: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The rows of ``df`` with ``slot``, ``epoch`` and ``place``: ordered by (slot, place) they form the mixture.

    ``weights``: target weight of each source; by default its size to the ``power``. ``size``: what a row
    weighs (default: one row); ``block``: the weight of a block. A row belongs to the block in which it
    starts, so a block's weight is off by less than a row's. Sources without a positive weight, and a null
    source if it has none, are not part of the mixture. With ``repeat``, rows of sources that run out early
    come again in later epochs, as far as the slots go that the longest-lasting source needs; without, every row comes once.

    Null sizes count as zero. Repeated rows are rows of their own; rows of one doc_id stand in the order of their size and
    of a hash of the row. An empty table gives an empty result.
    Columns of ``df`` named slot, epoch or place are replaced. At most MOST_SOURCES sources are allowed.
    """
    spark = df.sparkSession
    df = df.drop("slot", "epoch", "place")
    weight = F.coalesce(size, F.lit(0)) if size is not None else F.lit(1)
    df = df.withColumn("__mix_weight", weight.cast("long"))
    weight = F.col("__mix_weight")
    stats = df.groupBy(F.col(source).cast("string").alias("s")).agg(F.sum(weight).cast("long").alias("total"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(stats) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    totals = {r["s"]: max(1, r["total"]) for r in stats}
    target = tempered(totals, power) if weights is None else {s: weights.get(s, 0) for s in totals}
    if not any(w > 0 for w in target.values()):
        return df.drop("__mix_weight").limit(0).select("*", *(F.lit(None).cast("long").alias(c) for c in ("slot", "epoch", "place")))
    part = whole(target)
    names, total = names_of(part), sum(part.values())
    blocks = {s: -(-totals[s] // block) for s in part}
    # The longest-lasting source runs once; the others go on until the same slot.
    horizon = max(-(-totals[s] * total // (part[s] * block)) for s in part)
    slots, ran = written(spark, turns(part, horizon, blocks, repeat), len(names))
    slots = slots.toDF("__j", "__t", "slot")
    most = [max(0, ran[i] - 1) // blocks[s] for i, s in enumerate(names)]
    plan = literal(spark, [{"__s": s, "__i": i, "__blocks": blocks[s], "__most": most[i]} for i, s in enumerate(names)], "__s:string,__i:int,__blocks:bigint,__most:bigint")
    counted = literal(spark, [{"__g": r["s"], "__rows": r["rows"]} for r in stats], "__g:string,__rows:bigint")
    # Rows that tie in all else stand in the order of a hash of the whole row: only equal rows change places.
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    rows = placed(df, source, weight, (*(F.col(t) for t in ties), weight, F.xxhash64(*hashed)), counted)
    # At most MOST_SOURCES rows.
    rows = rows.join(F.broadcast(plan), F.col(source).cast("string").eqNullSafe(F.col("__s")))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__most"))))
    turn = F.col("epoch") * F.col("__blocks") + F.least(F.floor(F.col("__start") / block), F.col("__blocks") - 1)
    rows = rows.withColumn("__turn", turn).withColumn("place", F.col("__start").cast("long"))
    # Every turn of the first epoch has a slot; of the last one, those before the end.
    rows = rows.join(slots, (F.col("__i") == F.col("__j")) & (F.col("__turn") == F.col("__t")))
    return rows.select(*(c for c in df.columns if c != "__mix_weight"), "slot", "epoch", "place")
