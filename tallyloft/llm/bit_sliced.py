"""Exact top-k inner products from a bit-sliced index.

Components become integers floor(scale * x). The index keeps, for a block of rows, one bitmap for
each component and each bit of its value without the lowest ``dropped`` bits, shifted to be
nonnegative. A query's signed digits select bitmaps; carry-save adders on whole bitmaps add them up to
the bit slices of every row's coarse score. From the most significant slice downward the k-th largest
coarse score is found, then all rows that may reach it given what the dropped bits can add or take.
Those boundary rows are scored exactly, ties to the smaller id.

Blocks of queries are small and go to the blocks of index rows: a task reads an index block once and answers
the query blocks that follow it. No row pair is formed. Every vector is indexed, so the result is exact at
every size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloft.llm.common import stored

BLOCK_ROWS = 16_384
BLOCK_QUERIES = 128
LEAST_TASKS = 64  # a small index is dealt out several times, so that its few blocks keep as many tasks busy


def pack(values: np.ndarray, bits: int, dropped: int) -> np.ndarray:
    """Bitmaps, component x bit x words, of the rows' values >> dropped, plus 2 ** (bits - 1)."""
    coarse = (values >> dropped) + (1 << (bits - 1))
    rows = -(-len(values) // 64) * 64
    out = np.zeros((values.shape[1], bits, rows // 64), np.uint64)
    for bit in range(bits):
        plane = np.zeros((values.shape[1], rows), np.uint8)
        plane[:, : len(values)] = ((coarse >> bit) & 1).T
        out[:, bit] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)
    return out


def digits(x: int) -> list[tuple[int, int]]:
    """Nonadjacent signed binary digits of x: (place, 1 or -1)."""
    out, place = [], 0
    while x:
        if x & 1:
            d = 2 - (x & 3)
            out.append((place, d))
            x -= d
        x >>= 1
        place += 1
    return out


def add(columns: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Slices, least first, of the sum of bitmaps given by their place value."""
    slices: list[np.ndarray] = []
    place = 0
    columns = {p: list(v) for p, v in columns.items()}
    while columns:
        col = columns.pop(place, [])
        up = columns.setdefault(place + 1, []) if len(col) > 1 else None
        while len(col) > 1:
            a, b = col.pop(), col.pop()
            t = a ^ b
            if col:
                c = col.pop()
                up.append((a & b) | (t & c))
                t ^= c
                col.append(t)
            else:
                up.append(a & b)
                col.append(t)
        slices.append(col[0] if col else np.zeros(words, np.uint64))
        place += 1
    return slices


def coarse_slices(index: np.ndarray, query: np.ndarray, bits: int) -> list[np.ndarray]:
    """Slices of the score of the coarse values, shifted by what is the same for all rows, so that none is negative.

    A positive digit adds a component's value, a negative one its complement.
    """
    columns: dict[int, list[np.ndarray]] = {}
    for d, q in enumerate(query.tolist()):
        for place, sign in digits(q):
            for bit in range(bits):
                plane = index[d, bit]
                columns.setdefault(place + bit, []).append(plane if sign > 0 else ~plane)
    return add(columns, index.shape[2])


def at_least(slices: list[np.ndarray], bound: int, words: int) -> np.ndarray:
    """Rows whose value is ``bound`` or more."""
    if bound <= 0:
        return np.full(words, ~np.uint64(0))
    if bound >> len(slices):
        return np.zeros(words, np.uint64)
    more, equal = np.zeros(words, np.uint64), np.full(words, ~np.uint64(0))
    for i in reversed(range(len(slices))):
        if bound >> i & 1:
            equal = equal & slices[i]
        else:
            more = more | (equal & slices[i])
            equal = equal & ~slices[i]
    return more | equal


def kth_largest(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest value among ``rows``, from the most significant slice downward; 0 if there are fewer."""
    sure, equal, value = np.zeros_like(rows), rows, 0
    for i in reversed(range(len(slices))):
        both = equal & slices[i]
        if int(np.bitwise_count(sure | both).sum()) >= k:
            equal = both
            value |= 1 << i
        else:
            sure = sure | both
            equal = equal & ~slices[i]
    return value


def search_block(ids: np.ndarray, values: np.ndarray, index: np.ndarray, query: np.ndarray, own: int, k: int, bits: int, dropped: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the block's k best rows for one query, rows of the query's own id left out."""
    words = index.shape[2]
    mask = np.zeros(words * 64, np.uint8)
    mask[: len(ids)] = ids != own
    rows = np.packbits(mask, bitorder="little").view(np.uint64)
    slices = coarse_slices(index, query, bits)
    # The low bits of a value, 0 to 2 ** dropped - 1, add up to at most `slack` between any two rows.
    slack = ((1 << dropped) - 1) * int(np.abs(query).sum())
    bound = kth_largest(slices, rows, k) - (slack >> dropped)
    hit = np.flatnonzero(np.unpackbits((at_least(slices, bound, words) & rows).view(np.uint8), bitorder="little"))
    score = values[hit] @ query
    best = np.lexsort((ids[hit], -score))[:k]
    return ids[hit][best], score[best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, dropped: int = 3, vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's k highest integer inner products.

    ``queries`` has vec_id and the vector like ``vectors``. Candidates are all rows but those of the
    query's own id; all, if fewer than k. Vectors that are null or hold null or non-finite components take
    no part; shorter ones count as padded with zeros. A row that repeats a vec_id is a candidate of its own;
    a repeated query is answered once, by its least vector if they differ. Empty tables give an empty result. Values whose products could
    exceed 62 bits are an error.
    """
    spark = vectors.sparkSession
    kind = "query_id long, vec_id long, score long"
    ok = f"vec_id IS NOT NULL AND `{vector}` IS NOT NULL AND NOT exists(`{vector}`, x -> x IS NULL OR isnan(x) OR abs(CAST(x AS DOUBLE)) = double('infinity'))"
    whole = F.expr(f"transform(`{vector}`, x -> CAST(floor({scale}D * CAST(x AS DOUBLE)) AS BIGINT))")
    data = stored(vectors.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")), "vectors")
    asked = queries.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, dims, low, high = data.agg(F.count("*"), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    asked_n = asked.count()
    if not n or not asked_n or not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = max(abs(low), abs(high), 1)
    if dims * most * most >= 1 << 62:
        raise ValueError("vector components are too large for exact 64-bit scores")
    dropped = max(0, min(dropped, most.bit_length() - 4))
    bits = (most >> dropped).bit_length() + 1
    blocks, askers = math.ceil(n / BLOCK_ROWS), math.ceil(asked_n / BLOCK_QUERIES)

    def matrix(lists: pd.Series) -> np.ndarray:
        out = np.zeros((len(lists), dims), np.int64)
        for i, x in enumerate(lists):
            out[i, : len(x)] = x
        return out

    def index_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        values = matrix(pdf["v"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "rows": [len(pdf)], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vals": [values.astype(np.int32 if most < 1 << 31 else np.int64).tobytes()], "planes": [pack(values, bits, dropped).tobytes()]})

    def ask_block(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"asker": [pdf["asker"].iloc[0]], "qids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "qvals": [matrix(pdf["v"]).tobytes()]})

    index = data.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(index_block, "block int, rows int, ids binary, vals binary, planes binary")
    index = stored(index, "bit-sliced-index")
    asks = asked.withColumn("asker", F.pmod(F.xxhash64("vec_id"), F.lit(askers)).cast("int")).groupBy("asker").applyInPandas(ask_block, "asker int, qids binary, qvals binary")
    lanes = max(1, min(askers, LEAST_TASKS // blocks))
    held = index.select("block", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("kind"), "rows", "ids", "vals", "planes")
    asks = asks.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod("asker", F.lit(lanes)).cast("int").alias("lane"), F.lit(1).alias("kind"), F.lit(0).alias("rows"), F.col("qids").alias("ids"), F.col("qvals").alias("vals"), F.lit(None).cast("binary").alias("planes"))
    met = held.union(asks).repartition(blocks * lanes, "block", "lane").sortWithinPartitions("block", "lane", "kind")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                if r.kind == 0:
                    ids = np.frombuffer(r.ids, np.int64)
                    values = np.frombuffer(r.vals, np.int32 if most < 1 << 31 else np.int64).reshape(r.rows, dims).astype(np.int64)
                    planes = np.frombuffer(r.planes, np.uint64).reshape(dims, bits, -1)
                    continue
                qids = np.frombuffer(r.ids, np.int64)
                qvals = np.frombuffer(r.vals, np.int64).reshape(len(qids), dims)
                out = [search_block(ids, values, planes, q, qid, k, bits, dropped) for qid, q in zip(qids.tolist(), qvals)]
                sizes = [len(found) for found, _ in out]
                yield pd.DataFrame({"query_id": np.repeat(qids, sizes), "vec_id": np.concatenate([f for f, _ in out]), "score": np.concatenate([x for _, x in out])})

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = met.mapInPandas(search, kind)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
