"""Language identification by nearest centroid.

A text is a vector of hashed character n-grams (1 to 3, with word ends): logarithmic counts times
inverse document frequency, at unit length. Each language has several centroids, from spherical
k-means over its own vectors; a text gets the language of the centroid with the largest cosine and is
marked rejected if it is farther from it than all but ``reject`` of that language's training texts.

Document frequencies cover all training texts; the clustering takes a reproducible sample of about
``per_language`` texts of each language at most (drawn by a hash of doc_id).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloft.llm.common import uniform
from tallyloft.llm.grams import buckets, chunks, inside, letter_table, stream

ORDERS = (1, 2, 3)
MOST_LANGUAGES = 10_000  # more than there are; a centroid matrix of that many still fits a task
ROWS = 64  # texts in a dense block


def counts(texts: list[str], letters: np.ndarray, bits: int) -> np.ndarray:
    """Texts x buckets, how often each n-gram bucket occurs."""
    codes, begins = stream(texts, letters)
    is_letter = codes > 0
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(begins, len(codes)))) << bits
    total = np.zeros(len(texts) << bits, np.int64)
    for n in ORDERS:
        if len(codes) >= n:
            ok = inside(is_letter, n)
            total += np.bincount((owner[: len(ok)] + buckets(codes, n, bits))[ok], minlength=len(total))
    return total.reshape(len(texts), -1)


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    for at, part in chunks(texts):
        for lo in range(0, len(part), ROWS):
            yield at + lo, part[lo : lo + ROWS]


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class LanguageModel:
    languages: list[str]  # of each centroid, ascending
    centroids: np.ndarray
    idf: np.ndarray
    near: np.ndarray  # of each centroid, the smallest cosine that is not rejected
    bits: int

    def predict(self, texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, for each text."""
        n = len(texts)
        lang, score, far = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
        if not self.languages:
            return lang, score, far
        names = np.array(self.languages, object)
        for at, part in blocks(texts):
            some = np.array([any(map(str.isalpha, set(t))) for t in part])
            cosine = vectors(counts(part, letters, self.bits), self.idf) @ self.centroids.T
            best = cosine.argmax(axis=1)
            top = cosine[np.arange(len(part)), best]
            lang[at : at + len(part)] = np.where(some, names[best], "und")
            score[at : at + len(part)] = np.where(some, np.clip(top, 0, 1), 0)
            far[at : at + len(part)] = ~some | (top < self.near[best])
        return lang, score, far


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: unit centroids, started from rows far from those before."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    c = x[chosen].copy()
    for _ in range(rounds):
        mine = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (mine == j).any():
                m = x[mine == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit(docs: DataFrame, learn: Column | None = None, per_language: int = 256, centroids: int = 4, bits: int = 12, reject: float = 0.01, seed: int = 3) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of the documents that ``learn`` keeps; a null text or lang teaches nothing.

    What reaches the driver: a number of each bucket, and at most about per_language sparse vectors of each
    language, of which MOST_LANGUAGES are allowed.
    """
    rows = docs.filter(learn) if learn is not None else docs
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")

    def frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, df, n = letter_table(), np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for _, part in blocks(batch["text"].tolist()):
                df += (counts(part, letters, bits) > 0).sum(axis=0)
                n += len(part)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1), "df": np.append(df[at], n)})

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for batch in batches:
            for at, part in blocks(batch["text"].tolist()):
                c = counts(part, letters, bits)
                hit = [np.flatnonzero(row) for row in c]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at : at + len(part)].to_numpy(), "lang": batch["lang"].iloc[at : at + len(part)].to_numpy(), "at": hit, "n": [row[h] for row, h in zip(c, hit)]})

    df = np.zeros(1 << bits, np.int64)
    total = 0
    for r in rows.select("text").mapInPandas(frequency, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        if r["bucket"] < 0:
            total = r["df"]
        else:
            df[r["bucket"]] = r["df"]
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(1)
    draw = F.lit(False)
    for lang, n in sizes.items():
        draw = draw | ((F.col("lang") == lang) & (uniform("doc_id", seed=seed) < min(1.0, per_language / n)))
    names, cs, near = [], [], []
    if sizes:
        sample = rows.filter(draw).mapInPandas(sparse, "doc_id string, lang string, at array<long>, n array<long>").toPandas()
        sample["first"] = [tuple(a[:4]) for a in sample["at"]]
        sample = sample.sort_values(["lang", "doc_id", "first"], kind="stable")
        for lang, mine in sample.groupby("lang"):
            x = np.zeros((len(mine), 1 << bits), np.int64)
            for i, (a, n) in enumerate(zip(mine["at"], mine["n"])):
                x[i, np.asarray(a, int)] = n
            x = vectors(x, idf)
            x = x[x.any(axis=1)]
            if len(x):
                c = cluster(x, centroids)
                cosine = x @ c.T
                names += [lang] * len(c)
                cs.append(c)
                near += [float(np.quantile(cosine.max(axis=1), reject))] * len(c)
    c = np.concatenate(cs).astype(np.float32) if cs else np.zeros((0, 1 << bits), np.float32)
    return LanguageModel(names, c, idf, np.array(near), bits)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``; one pass, no shuffle.

    Texts that are null or have no letter get ``und``, score 0, rejected. So does all if nothing was learnt.
    Columns of ``docs`` with these names are replaced.
    """
    added = {"lang_pred", "score", "rejected"}
    source = docs.withColumn("__text", F.col(text)).drop(text, *added)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for batch in batches:
            lang, score, far = model.predict([t if isinstance(t, str) else None for t in batch["__text"]], letters)
            yield batch.drop(columns="__text").assign(lang_pred=lang, score=score, rejected=far)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text"), "lang_pred string", "score double", "rejected boolean"])
    return source.mapInPandas(run, schema)
