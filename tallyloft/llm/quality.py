"""Quality of documents by the perplexity of an interpolated modified Kneser-Ney model.

The model is of characters over the whole alphabet, of order 4, trained on all trusted documents. Counts are sharded
by n-gram and context: joins between them give continuation counts, discounts, back-off weights and interpolated
probabilities. The tables grow with the corpus and never leave the cluster's shared folder. Documents are scored in
blocks of file splits: a block's different n-grams, pre-aggregated, are joined with the tables, and the answers are
written to the shared folder by block, where the task that scores a document of the block reads them. No text is
shuffled, no table is broadcast or gathered on the driver, and what a task holds is bounded by its block.

Three quarters of the trusted documents teach the model; the last quarter, which it has not read, sets the limits. A
document is kept if its surprise a character, drawn toward its language's mean as if by ``prior`` more characters (a
short text says little), is within a quantile of that quarter in its language, plus a ``margin`` in nats a character. A
language with fewer than ``enough`` such documents takes the quantile of all of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloft.llm.common import code_points, discard, scratch_path, stored
from tallyloft.llm.grams import chunks

ORDER, UNIT = 4, 16  # characters of an n-gram, bits of a character
ALPHABET = 1 << UNIT  # characters beyond the basic plane are one
BIN = 1e-3  # width, in nats, of the histogram that quantiles are read from
BLOCK_ROWS = 8192  # documents of a block, about
CHARS, PAIRS = 1 << 10, 1 << 12  # characters and pairs of them that a task maps directly


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts in a row, three zeros before each and after the last; and where each text starts."""
    pad = "\0" * (ORDER - 1)
    codes = np.minimum(code_points(pad + pad.join(texts) + pad), ALPHABET - 1).astype(np.uint16)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return codes, np.concatenate(([0], np.cumsum(lengths + ORDER - 1)[:-1]))


def grams(codes: np.ndarray) -> np.ndarray:
    """The n-gram that starts at each place, as one integer."""
    size = max(0, len(codes) - ORDER + 1)
    ids = np.zeros(size, np.uint64)
    for k in range(ORDER):
        ids = (ids << np.uint64(UNIT)) | codes[k : k + size]
    return ids


class Distinct:
    """The different n-grams of the texts it is shown: a bit for each pair of character pairs; a sorted list if there are too many pairs for that."""

    def __init__(self):
        self.char = np.full(ALPHABET, -1, np.int32)
        self.pair = np.full(CHARS * CHARS, -1, np.int32)
        self.chars, self.pairs = 0, np.zeros(0, np.uint64)
        self.seen = np.zeros(PAIRS * PAIRS, bool)
        self.more = np.zeros(0, np.uint64)

    def add(self, codes: np.ndarray) -> None:
        fresh = np.unique(codes[self.char[codes] < 0])
        if self.chars + len(fresh) <= CHARS:
            self.char[fresh] = np.arange(self.chars, self.chars + len(fresh))
            self.chars += len(fresh)
            small = self.char[codes]
            key = small[:-1] * CHARS + small[1:]
            new, first = np.unique(key[self.pair[key] < 0], return_index=True)
            if len(self.pairs) + len(new) <= PAIRS:
                at = np.flatnonzero(self.pair[key] < 0)[first]
                self.pair[new] = np.arange(len(self.pairs), len(self.pairs) + len(new))
                self.pairs = np.append(self.pairs, (codes[at].astype(np.uint64) << np.uint64(UNIT)) | codes[at + 1])
                ids = self.pair[key]
                self.seen[ids[:-2].astype(np.int64) * PAIRS + ids[2:]] = True
                return
        self.more = np.union1d(self.more, grams(codes))

    def all(self) -> np.ndarray:
        at = np.flatnonzero(self.seen)
        both = (self.pairs[at // PAIRS] << np.uint64(2 * UNIT)) | self.pairs[at % PAIRS]
        return np.union1d(both, self.more)


class Answers:
    """What a block has been told: the log-probability of each of its n-grams, found through character pairs or, beyond PAIRS of them, by halving."""

    def __init__(self, gram: np.ndarray, logp: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.logp, self.dense = gram[order], logp[order].astype(np.float32), None
        first, last = (gram >> np.uint64(2 * UNIT)).astype(np.uint32), (gram & np.uint64((1 << 2 * UNIT) - 1)).astype(np.uint32)
        pairs = np.unique(np.concatenate([first, last]))
        chars = np.unique(np.concatenate([pairs >> UNIT, pairs & (ALPHABET - 1)]))
        if len(chars) <= CHARS and len(pairs) <= PAIRS:
            self.char = np.zeros(ALPHABET, np.int32)
            self.char[chars] = np.arange(len(chars))
            self.pair = np.zeros(CHARS * CHARS, np.int32)
            self.pair[self.char[pairs >> UNIT] * CHARS + self.char[pairs & (ALPHABET - 1)]] = np.arange(len(pairs))
            self.width = len(pairs)
            self.dense = np.zeros(self.width * self.width, np.float32)
            self.dense[np.searchsorted(pairs, first).astype(np.int64) * self.width + np.searchsorted(pairs, last)] = logp

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Log-probabilities of the n-grams that start at each place; any number for those of no text."""
        if self.dense is None:
            return self.logp[np.minimum(np.searchsorted(self.gram, grams(codes)), len(self.gram) - 1)]
        small = self.char[codes]
        ids = self.pair[small[:-1] * CHARS + small[1:]]
        return self.dense[ids[:-2].astype(np.int64) * self.width + ids[2:]]

    def surprise(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Negative log-probability and number of characters of each whole text."""
        nll, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for at, part in chunks(texts):
            codes, starts = units(part)
            sums = np.concatenate(([0.0], np.cumsum(self.of(codes), dtype=np.float64)))
            size = np.fromiter(map(len, part), np.int64, len(part))
            nll[at : at + len(part)] = sums[starts] - sums[starts + size]
            n[at : at + len(part)] = size
        return nll, n


# ---------------------------------------------------------------------------------------------
# blocks of file splits


def filed(docs: DataFrame) -> DataFrame:
    """``docs`` if it is read from files, whose splits make blocks, with no more than columns and rows left out; else a stored copy."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.child()
    return docs if "HadoopFsRelation" in plan.getClass().getName() or plan.nodeName() == "LogicalRelation" else stored(docs, "documents")


def blocks(rows: int) -> int:
    return max(1, math.ceil(rows / BLOCK_ROWS))


def block_of(many: int) -> Column:
    """The block of a row: its file split's, by a hash, so that a split is read by one task and never parted."""
    return F.pmod(F.xxhash64("_metadata.file_path", "_metadata.file_block_start"), F.lit(many)).cast("int")


def by_block(df: DataFrame, many: int, name: str) -> str:
    """Write ``df`` (with ``block``) to a folder for each block; returns the path."""
    path = scratch_path(df.sparkSession, name)
    df.repartition(many, "block").write.partitionBy("block").parquet(path)
    return path


def of_block(path: str, block: int) -> pa.Table | None:
    """What ``by_block`` wrote for a block; None if that is nothing. Runs in tasks, on any store that pyarrow reads."""
    files, root = pa.fs.FileSystem.from_uri(re.sub("^(file:)?/+", "file:///", path))
    folder = f"{root}/block={block}"
    if files.get_file_info(folder).type == pa.fs.FileType.NotFound:
        return None
    return pa.dataset.dataset(folder, filesystem=files, format="parquet").to_table()


# ---------------------------------------------------------------------------------------------
# the model


def count(docs: DataFrame, marked: str, many: int) -> DataFrame:
    """``gram`` and ``n``: how often each n-gram occurs in the texts of the documents that each block's list in ``marked`` names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, n, at, chosen = np.zeros(0, np.uint64), np.zeros(0, np.int64), None, set()
        for batch in batches:
            for block, mine in batch.groupby("block", sort=False):
                if block != at:
                    listed = of_block(marked, block)
                    at, chosen = block, set(listed.column("key").to_pylist()) if listed is not None else set()
                texts = [t for k, t in zip(mine["key"], mine["text"]) if k in chosen]
                for _, part in chunks(texts):
                    codes, starts = units(part)
                    own = np.zeros(len(codes) + 1, np.int32)
                    np.add.at(own, starts, 1)
                    np.add.at(own, starts + np.fromiter(map(len, part), np.int64, len(part)), -1)
                    got = grams(codes)
                    one, c = np.unique(got[np.cumsum(own)[: len(got)] > 0], return_counts=True)
                    ids, inverse = np.unique(np.concatenate([ids, one]), return_inverse=True)
                    n = np.bincount(inverse, weights=np.concatenate([n, c]), minlength=len(ids)).astype(np.int64)
        if len(ids):
            yield pd.DataFrame({"gram": ids.view(np.int64), "n": n})

    rows = docs.select(F.col("doc_id").cast("string").alias("key"), "text", block_of(many).alias("block")).filter("key IS NOT NULL AND text IS NOT NULL")
    return rows.mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(table: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from the counts of counts; middling ones where there are no counts of 1 or 2."""
    found = {r["n"]: r["k"] for r in table.filter("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    n1, n2, n3, n4 = (found.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def suffix(gram: str, order: int) -> Column:
    """The last ``order`` characters of an n-gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << UNIT * order) - 1))


def context(gram: str) -> Column:
    """All characters of an n-gram but the last."""
    return F.shiftrightunsigned(F.col(gram), UNIT)


@dataclass
class KneserNey:
    """Stored tables by order: ``seen`` (gram, p), the probabilities of n-grams that occur, ``weights`` (context, weight) of what is left to shorter ones; ``floor``: the probability of a character never seen."""

    seen: dict[int, DataFrame]
    weights: dict[int, DataFrame]
    floor: float

    def probabilities(self, asked: DataFrame) -> DataFrame:
        """``gram`` and ``p`` for each of the different 4-grams of ``asked``, by joins from the longest order down."""
        out = asked.select("gram")
        p, left = F.lit(None).cast("double"), F.lit(1.0)
        for order in range(ORDER, 0, -1):
            seen = self.seen[order].select(F.col("gram").alias(f"g{order}"), F.col("p").alias(f"p{order}"))
            out = out.withColumn(f"s{order}", suffix("gram", order) if order < ORDER else F.col("gram")).join(seen, F.col(f"s{order}") == F.col(f"g{order}"), "left")
            p = F.coalesce(p, left * F.col(f"p{order}"))
            if order > 1:
                weights = self.weights[order].select(F.col("context").alias(f"c{order}"), F.col("weight").alias(f"w{order}"))
                out = out.join(weights, context(f"s{order}") == F.col(f"c{order}"), "left")
                left = left * F.coalesce(F.col(f"w{order}"), F.lit(1.0))
        return out.select("gram", F.coalesce(p, left * self.floor).alias("p"))

    def discard(self) -> None:
        for table in (*self.seen.values(), *self.weights.values()):
            discard(table)


def train(counts: DataFrame) -> KneserNey:
    """The model of a table of 4-gram counts (gram, n); of an empty one, the uniform model."""
    tables = {ORDER: stored(counts, f"grams-{ORDER}")}
    for order in range(ORDER - 1, 0, -1):
        # Of the shorter n-grams: in how many different longer ones they end.
        shorter = tables[order + 1].groupBy(suffix("gram", order).alias("gram")).agg(F.count("*").alias("n"))
        tables[order] = stored(shorter, f"grams-{order}")
    model = KneserNey({}, {}, 1.0 / ALPHABET)
    for order in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(tables[order])
        table = tables[order].withColumn("context", context("gram"))
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        weights = stored(table.groupBy("context").agg(F.sum("n").alias("total"), (F.sum(cut) / F.sum("n")).alias("weight")), f"weights-{order}")
        parts = table.join(weights, "context").withColumn("own", (F.col("n") - cut) / F.col("total"))
        if order == 1:
            p = parts.select("gram", (F.col("own") + F.col("weight") / ALPHABET).alias("p"))
            only = weights.first()
            model.floor = only["weight"] / ALPHABET if only else 1.0 / ALPHABET
        else:
            # Every suffix of a seen n-gram has been seen, so no row is lost.
            less = model.seen[order - 1].select(F.col("gram").alias("suffix"), F.col("p").alias("less"))
            p = parts.withColumn("suffix", suffix("gram", order - 1)).join(less, "suffix").select("gram", (F.col("own") + F.col("weight") * F.col("less")).alias("p"))
        model.seen[order], model.weights[order] = stored(p, f"probabilities-{order}"), weights
        discard(tables[order])
    return model


# ---------------------------------------------------------------------------------------------
# scoring


def answers(docs: DataFrame, model: KneserNey, many: int, text: str = "text") -> str:
    """Look up every block's different n-grams in the model; returns the path of the answers by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for batch in batches:
            for block, mine in batch.groupby("block", sort=False):
                if block != at:
                    if held is not None:
                        yield pd.DataFrame({"block": at, "gram": held.all().view(np.int64)})
                    at, held = block, Distinct()
                for _, part in chunks(mine["text"].tolist()):
                    held.add(units(part)[0])
        if held is not None:
            yield pd.DataFrame({"block": at, "gram": held.all().view(np.int64)})

    rows = docs.select(F.col(text).alias("text"), block_of(many).alias("block")).filter("text <> ''")
    asked = stored(rows.mapInPandas(run, "block int, gram long").distinct(), "asked")
    told = stored(model.probabilities(asked.select("gram").distinct()).select("gram", F.log("p").cast("float").alias("logp")), "told")
    path = by_block(asked.join(told, "gram").select("block", "gram", "logp"), many, "answers")
    discard(asked)
    discard(told)
    return path


def perplexities(docs: DataFrame, path: str, many: int, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``nll`` and ``chars`` from its blocks' answers, one pass without a shuffle; columns of these names are replaced."""
    gone = {"nll", "chars"} | (set() if keep_text else {text})
    source = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in gone), F.col(text).alias("__text"), block_of(many).alias("__block"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, told = None, None
        for batch in batches:
            for block, mine in batch.groupby("__block", sort=False):
                if block != at:
                    table = of_block(path, block)
                    at, told = block, None if table is None else Answers(table.column("gram").to_numpy().view(np.uint64), table.column("logp").to_numpy())
                texts = [t if isinstance(t, str) else None for t in mine["__text"]]
                nll, n = told.surprise(texts) if told is not None else (np.zeros(len(texts)), np.zeros(len(texts), np.int64))
                yield mine.drop(columns=["__text", "__block"]).assign(nll=nll, chars=n)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name[:2] != "__"), "nll double", "chars long"])
    return source.mapInPandas(run, schema)


@dataclass
class Quality:
    """The documents (as files), the path and number of their blocks' answers, each language's mean surprise a character, and its limit; under None those of all."""

    docs: DataFrame
    path: str
    many: int
    mean: dict[str | None, float]
    limit: dict[str | None, float]
    prior: float


def fit(docs: DataFrame, trusted: DataFrame, quantile: float = 0.999, margin: float = 0.01, prior: float = 300.0, enough: int = 30) -> tuple[Quality, DataFrame]:
    """The answers for ``docs`` from the documents whose doc_id is in ``trusted`` (distinct ids), the limits, and the scores (doc_id, lang, nll, chars).

    Null ids are never trusted. Trusted texts that are null or empty teach nothing.
    """
    docs = filed(docs)
    many = blocks(docs.count())
    ids = trusted.select(F.col("doc_id").cast("string").alias("key")).filter("key IS NOT NULL").distinct().withColumn("teaches", F.pmod(F.xxhash64("key"), F.lit(4)) > 0)
    listed = docs.select(F.col("doc_id").cast("string").alias("key"), block_of(many).alias("block")).distinct().join(ids.filter("teaches"), "key").select("block", "key")
    marked = by_block(listed, many, "trusted")
    model = train(count(docs, marked, many))
    path = answers(docs, model, many)
    model.discard()
    scores = stored(perplexities(docs.select("doc_id", "lang", "text"), path, many, keep_text=False), "surprise")
    known = scores.filter("chars > 0").join(ids.filter("NOT teaches"), F.col("doc_id").cast("string") == F.col("key"), "left_semi").select("lang", "nll", "chars")
    means = known.groupBy("lang").agg(F.sum("nll").alias("nll"), F.sum("chars").alias("chars"), F.count("*").alias("n"))
    whole = means.agg(F.sum("nll").alias("nll"), F.sum("chars").alias("chars")).first()
    overall = whole["nll"] / whole["chars"] if whole["chars"] else 0.0
    # A row for each language with enough documents of its own.
    mean = {r["lang"]: r["nll"] / r["chars"] for r in means.filter((F.col("n") >= enough) & F.col("lang").isNotNull()).collect()} | {None: overall}
    quality = Quality(docs, path, many, mean, {}, prior)
    # Quantiles from histograms: a number of rows that depends on the spread of surprise, not on the corpus.
    bins = known.select("lang", F.floor(drawn(quality) / BIN).alias("bin")).groupBy("lang", "bin").agg(F.count("*").alias("n")).toPandas()
    for lang in mean:
        part = (bins if lang is None else bins[bins["lang"] == lang]).groupby("bin")["n"].sum().sort_index()
        if len(part):
            quality.limit[lang] = float(part.index[np.searchsorted(part.cumsum(), quantile * part.sum())] + 1) * BIN + margin
    return quality, scores


def by_language(values: dict[str | None, float]) -> Column:
    """The value of a row's language, of None if it has none of its own."""
    named = {k: v for k, v in values.items() if k is not None}
    rest = F.lit(values.get(None)).cast("double")
    if not named:
        return rest
    table = F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*(F.lit(v).cast("double") for v in named.values())))
    return F.coalesce(F.try_element_at(table, F.coalesce("lang", F.lit(""))), rest)


def drawn(q: Quality) -> Column:
    """Surprise a character, drawn toward the language's mean."""
    return (F.col("nll") + q.prior * by_language(q.mean)) / (F.col("chars") + q.prior)


def judge(scores: DataFrame, q: Quality) -> DataFrame:
    """``scores`` (with lang, nll, chars) with ``perplexity`` (the document's own), ``smoothed`` (drawn to its language's mean, what is judged), ``threshold`` and ``keep``.

    Null and empty texts have no perplexity and are not kept. If nothing was trusted, all else is kept.
    """
    some = F.col("chars") > 0
    limit = by_language(q.limit) if q.limit else F.lit(None).cast("double")
    return scores.withColumns(
        {
            "perplexity": F.when(some, F.exp(F.col("nll") / F.col("chars"))),
            "smoothed": F.when(some, F.exp(drawn(q))),
            "threshold": F.exp(limit),
            "keep": some & F.coalesce(drawn(q) <= limit, F.lit(True)),
        }
    )
