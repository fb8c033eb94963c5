"""Document fingerprints by Order MinHash, sensitive to edit distance.

The k-mers of a text are numbered by occurrence, so a repeated k-mer counts as often as it stands.
For each of ``size`` orders the ``group`` smallest (k-mer, occurrence) pairs are selected, put back in
text order, and hashed as a tuple. The share of equal entries of two signatures is their likeness: it
falls when k-mers differ and also when the same k-mers stand in another order.

Text shorter than a k-mer is one k-mer; with fewer pairs than ``group`` a tuple takes all there are.
An empty or null text has the signature of zeros. Equal texts have equal signatures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloft.llm.common import code_points, mix64

K, GROUP, SIZE = 5, 2, 32
BLOCK = 1 << 20  # cells of (orders x k-mers) held at a time


def seeds(size: int) -> np.ndarray:
    """A 32-bit number for each order."""
    return (mix64(np.arange(1, size + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def ordered(short: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Orders x pairs: where each pair stands in each order, by a mixer of 32-bit numbers that differs with the seed."""
    x = short[None, :] ^ seed[:, None]
    x *= seed[:, None] | np.uint32(1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    return x


def signature(codes: np.ndarray, k: int = K, group: int = GROUP, size: int = SIZE) -> np.ndarray:
    if not len(codes):
        return np.zeros(size, np.uint32)
    k = min(k, len(codes))
    n = len(codes) - k + 1
    h = codes[:n].astype(np.uint64)
    for j in range(1, k):
        h *= np.uint64(0x100000001B3)
        h += codes[j : j + n]
    h = mix64(h)
    # Equal k-mers come together, in text order, when hash and place are sorted as one number.
    bits = np.uint64(n.bit_length())
    packed = np.sort((h >> bits << bits) | np.arange(n, dtype=np.uint64))
    place = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    kmer = packed >> bits
    rank = np.arange(n)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kmer[1:], kmer[:-1], out=new[1:])
    occurrence = rank - np.maximum.accumulate(np.where(new, rank, 0))
    pair = mix64(h[place] + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    short = (pair >> np.uint64(32)).astype(np.uint32)
    seed = seeds(size)
    group = min(group, n)
    chosen = np.empty((size, group), np.int64)
    rows = max(1, BLOCK // n)
    for lo in range(0, size, rows):
        value = ordered(short, seed[lo : lo + rows])
        at = np.arange(len(value))
        for g in range(group):
            best = value.argmin(axis=1)
            chosen[lo : lo + rows, g] = best
            value[at, best] = np.uint32(0xFFFFFFFF)
    order = np.argsort(place[chosen], axis=1, kind="stable")
    chosen = np.take_along_axis(chosen, order, axis=1)
    out = np.arange(size, dtype=np.uint64)
    for g in range(group):
        out = mix64(out * np.uint64(0x100000001B3) + pair[chosen[:, g]])
    return (out >> np.uint64(32)).astype(np.uint32)


def hexed(signature_: np.ndarray) -> str:
    return signature_.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, group: int = GROUP, size: int = SIZE) -> DataFrame:
    """``docs`` without its text, with ``fingerprint`` (hex) for each row; one pass without a shuffle."""
    source = docs.withColumn("__text", F.col(text)).drop(text, "fingerprint")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="__text").assign(fingerprint=[hexed(signature(code_points(t or ""), k, group, size)) for t in batch["__text"]])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text"), "fingerprint string"])
    return source.mapInPandas(run, schema)


def _ranges(ids: DataFrame, many: int) -> tuple[list[int], list[int | None]]:
    """Bounds that cut the ids, descending, into about ``many`` even ranges, and the largest id of each range."""
    bounds = ids.approxQuantile("id", [i / many for i in range(1, many)], 0.25 / many) if many > 1 else []
    bounds = sorted({int(b) for b in bounds}, reverse=True)
    heads = {r["range"]: r["head"] for r in ids.select(_range_of(bounds).alias("range"), "id").groupBy("range").agg(F.max("id").alias("head")).collect()}
    return bounds, [heads.get(i) for i in range(len(bounds) + 1)]


def _range_of(bounds: list[int]) -> F.Column:
    """How many bounds are larger than or equal to ``id``, by halving."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    held = f"array({', '.join(f'{b}L' for b in bounds)})"
    return F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (at, s) -> if(at + s <= {len(bounds)} AND get({held}, at + s - 1) > id, at + s, at))")


def edited_likeness(docs: DataFrame, text: str = "text", k: int = K, group: int = GROUP, size: int = SIZE) -> DataFrame:
    """Each document's fingerprint beside that of an edited text and of the next document.

    The edited text has the last third of the code points (rounded down) replaced by the first as many of
    the next document by descending doc_id; the last takes the first. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, a row for each row.

    Null texts count as empty. Rows of one doc_id follow each other by their text's hash; a null doc_id
    comes last. A table of one row is its own next; an empty one gives none. Other columns are not read.

    Texts move once, to ranges of neighbouring ids; the first text of each range also goes to the range before. There are
    four ranges a shuffle partition, and a number of each reaches the driver, however many rows there are: a task streams
    its ranges in order and holds one row.
    """
    spark = docs.sparkSession
    least = -(1 << 63) + 1
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = rows.select("id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, heads = _ranges(ids, 4 * parts)
    filled = [i for i, h in enumerate(heads) if h is not None]
    before = {b: a for a, b in zip(filled, filled[1:])} | ({filled[0]: filled[-1]} if filled else {})
    head = F.expr("get(array(" + ", ".join("NULL" if h is None else f"{h}L" for h in heads) + "), range)") if filled else F.lit(None)
    back = F.expr("get(array(" + ", ".join(str(before.get(i, -1)) for i in range(len(heads))) + "), range)")
    rows = rows.withColumn("range", _range_of(bounds)).withColumn("head", head).withColumn("back", back)
    own = F.struct(F.col("range").alias("to"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("back").alias("to"), F.lit(1).alias("guest"))
    sent = rows.withColumn("at", F.explode(F.when(F.col("id") == F.col("head"), F.array(own, guest)).otherwise(F.array(own))))
    sent = sent.select("at.to", "at.guest", "id", "doc_id", "text")
    dealt = sent.repartition(parts, "to").sortWithinPartitions("to", "guest", F.desc("id"), F.xxhash64("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row that waits for its next
        columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in batches:
            out = []
            for to, is_guest, doc_id, body in zip(batch["to"].tolist(), batch["guest"].tolist(), batch["doc_id"].tolist(), batch["text"].tolist()):
                if is_guest and (held is None or held[0] != to):
                    continue
                codes = code_points(body)
                mine = signature(codes, k, group, size)
                if held is not None and held[0] == to:
                    _, other, its_codes, its_body, its_mine = held
                    third = len(its_codes) // 3
                    edited = its_body[: len(its_body) - third] + body[:third]
                    theirs = signature(code_points(edited), k, group, size) if third else its_mine
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((other, len(its_codes), digest, hexed(its_mine), hexed(theirs), likeness(its_mine, theirs), likeness(its_mine, mine)))
                held = None if is_guest else (to, doc_id, codes, body, mine)
            frame = pd.DataFrame(out, columns=columns)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return dealt.mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
