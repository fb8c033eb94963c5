"""Toxicity by bags of subword embeddings under a linear softmax.

A word is the sum of the embeddings of its hashed character n-grams (3 to 6, with word ends), so a misspelling
shares most vectors with what it misspells. A bag is a run of ``window`` words of the text, every occurrence
counted, and is the average of its n-gram vectors; a linear softmax over it gives its toxicity. Embeddings and
softmax are trained jointly in numpy by gradient descent. Labels belong to documents, and a short insult in a very
long text must not be averaged away: a document's logit is the average of its bags' logits weighted by their softmax,
which leans to the most toxic ones, in training and in scoring alike. Whole texts are scored, every word of them.

Training takes a reproducible sample of labelled rows, at most ``per_class`` of each class (the one bound; the
rows whose hash of doc_id and text is smallest).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloft.llm.common import uniform
from tallyloft.llm.grams import buckets, chunks, inside, letter_table, stream

ORDERS = (3, 4, 5, 6)
FULL = 60  # n-grams of a full bag; a bag with fewer is filled up with zero vectors
MOST_WORDS = 1 << 17  # words whose sums a task keeps


@dataclass
class ToxicityModel:
    """``weight``: what each n-gram bucket adds to the logit of its bag's average; ``bias``: the logit of an empty bag."""

    weight: np.ndarray
    bias: float
    bits: int
    window: int

    def scorer(self, letters: np.ndarray) -> Callable[[list[str | None]], np.ndarray]:
        """A function from texts to the logit of each; the bias for a text without letters.

        It keeps what the words it has met add, and starts anew beyond MOST_WORDS of them.
        """
        ids: dict[str, int] = {}
        value, count = np.zeros(0), np.zeros(0, np.int64)

        def logits(texts: list[str | None]) -> np.ndarray:
            nonlocal value, count
            out = np.full(len(texts), self.bias, np.float64)
            for at, part in chunks(texts):
                words = [t.lower().split() for t in part]
                if len(ids) > MOST_WORDS:
                    ids.clear()
                    value, count = value[:0], count[:0]
                fresh = list(set().union(*words) - ids.keys())
                if fresh:
                    ids.update(zip(fresh, range(len(ids), len(ids) + len(fresh))))
                    buckets_, sizes = word_grams(fresh, letters, self.bits)
                    ends = np.concatenate(([0.0], np.cumsum(self.weight[buckets_], dtype=np.float64)))
                    upto = np.concatenate(([0], np.cumsum(sizes)))
                    value, count = np.append(value, ends[upto[1:]] - ends[upto[:-1]]), np.append(count, sizes)
                which, owner = word_ids(words, ids, count)
                starts = bag_starts(owner, self.window)
                if len(starts):
                    z = np.add.reduceat(value[which], starts) / np.maximum(np.add.reduceat(count[which], starts), FULL)
                    doc, first, bags = np.unique(owner[starts], return_index=True, return_counts=True)
                    out[at + doc] = lean(z, first, bags)[0] + self.bias
            return out

        return logits


def word_grams(words: list[str], letters: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word, word by word, and how many each has; a word without letters has none."""
    found, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for _, part in chunks(words, 1 << 16):
        codes, begins = stream(part, letters)
        is_letter = codes > 0
        ids, places = [], []
        for n in ORDERS:
            if len(codes) >= n:
                at = np.flatnonzero(inside(is_letter, n))
                ids.append(buckets(codes, n, bits)[at].astype(np.uint32))
                places.append(at)
        if ids:
            owner = np.searchsorted(begins, np.concatenate(places), side="right") - 1
            found.append(np.concatenate(ids)[np.argsort(owner, kind="stable")])
            sizes.append(np.bincount(owner, minlength=len(part)))
        else:
            sizes.append(np.zeros(len(part), np.int64))
    return np.concatenate(found), np.concatenate(sizes)


def word_ids(words: list[list[str]], ids: dict[str, int], count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words that have n-grams, text by text, and the text of each."""
    which = np.fromiter(map(ids.__getitem__, chain.from_iterable(words)), np.int64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    some = count[which] > 0
    return which[some], owner[some]


def bag_starts(owner: np.ndarray, window: int) -> np.ndarray:
    """Where bags start: at every ``window``-th word of a text; a text's last bag takes the words left over."""
    number = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
    left = np.searchsorted(owner, owner, side="right") - np.arange(len(owner))
    return np.flatnonzero((number % window == 0) & ((number == 0) | (left >= window)))


def lean(z: np.ndarray, first: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The average of each document's bags' logits ``z``, weighted by their softmax, and those weights."""
    weight = np.exp(z - np.repeat(np.maximum.reduceat(z, first), bags))
    weight /= np.repeat(np.add.reduceat(weight, first), bags)
    return np.add.reduceat(weight * z, first), weight


def step(emb: np.ndarray, soft: np.ndarray, bias: np.ndarray, grams: np.ndarray, sizes: np.ndarray, which: np.ndarray, owner: np.ndarray, window: int, toxic: np.ndarray, share: np.ndarray, rate: float) -> None:
    """One step of gradient descent, in place, on the mean weighted log-loss of some documents.

    ``grams``: n-gram rows of the batch's different words, word by word, ``sizes`` of them a word; ``which``, ``owner``: the
    words of the documents and the document of each. A document's logit is the average of its bags' logits, weighted by
    their softmax: all alike at first, the most toxic one nearly alone once the model tells them apart.
    """
    delta = soft[1] - soft[0]
    begin = np.cumsum(sizes) - sizes
    starts = bag_starts(owner, window)
    length = np.diff(np.append(starts, len(owner)))
    full = np.maximum(np.add.reduceat(sizes[which], starts), FULL)
    value = np.add.reduceat((emb @ delta)[grams], begin)
    z = np.add.reduceat(value[which], starts) / full
    doc, first, bags = np.unique(owner[starts], return_index=True, return_counts=True)
    whole, weight = lean(z, first, bags)
    p = 1 / (1 + np.exp(-(whole + bias[1] - bias[0])))
    err = (p - toxic[doc]) * share[doc] / len(toxic)
    each = np.bincount(which, weights=np.repeat(np.repeat(err, bags) * weight / full, length), minlength=len(sizes))
    pull = np.bincount(grams, weights=np.repeat(each, sizes), minlength=len(emb))
    pull[-1] = 0  # the row that stands for all n-grams that are not learnt
    hit = np.flatnonzero(pull)
    g = pull[hit].astype(emb.dtype)
    d_soft = g @ emb[hit]
    emb[hit] -= (rate * g)[:, None] * delta
    soft -= emb.dtype.type(0.1) * np.stack([-d_soft, d_soft])
    bias -= emb.dtype.type(0.1) * np.array([-err.sum(), err.sum()], emb.dtype)


def train(texts: list[str], toxic: np.ndarray, bits: int = 20, dim: int = 8, window: int = 2, steps: int = 400, rate: float = 600.0, batch: int = 48, least: int = 3, caution: float = 4.0, seed: int = 7) -> ToxicityModel:
    """Fit embeddings and softmax jointly, at least ``steps`` batches and 10 passes. Without both classes the model gives every text 0.

    Both classes weigh alike, clean documents ``caution`` times. N-grams in fewer than ``least`` different texts keep weight zero, so that no text is learnt by heart.
    """
    toxic = np.asarray(toxic, bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return ToxicityModel(np.zeros(1 << bits, np.float32), -50.0, bits, window)
    letters = letter_table()
    ids: dict[str, int] = {}
    docs = []
    for t in texts:
        words = t.lower().split()
        for w in words:
            ids.setdefault(w, len(ids))
        docs.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
    grams, sizes = word_grams(list(ids), letters, bits)
    begin = np.cumsum(sizes) - sizes
    docs = [d[sizes[d] > 0] for d in docs]

    def rows_of(words: np.ndarray) -> np.ndarray:
        n = sizes[words]
        return np.repeat(begin[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    seen = np.zeros(1 << bits, np.int32)
    for words in {t: d for t, d in zip(texts, docs)}.values():
        seen[np.unique(grams[rows_of(np.unique(words))])] += 1
    kept = np.flatnonzero(seen >= least)
    dense = np.full(1 << bits, len(kept), np.uint32)
    dense[kept] = np.arange(len(kept))
    grams = dense[grams]
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-0.01, 0.01, (len(kept) + 1, dim)).astype(np.float32)
    soft = rng.uniform(-0.5, 0.5, (2, dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    emb[-1] = 0
    share = np.where(toxic, 1 / toxic.mean(), caution / (~toxic).mean()) / (1 + caution)
    for _ in range(max(10, -(-steps * batch // len(docs)))):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            who = order[lo : lo + batch]
            words, which = np.unique(np.concatenate([docs[d] for d in who]), return_inverse=True)
            if len(words):
                owner = np.repeat(np.arange(len(who)), [len(docs[d]) for d in who])
                step(emb, soft, bias, grams[rows_of(words)], sizes[words], which, owner, window, toxic[who], share[who], rate)
    weight = np.zeros(1 << bits, np.float32)
    weight[kept] = (emb @ (soft[1] - soft[0]))[:-1]
    return ToxicityModel(weight, float(bias[1] - bias[0]), bits, window)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, per_class: int = 1500, seed: int = 7) -> ToxicityModel:
    """Train on documents that ``labels`` (doc_id, toxic 0/1) marks; ``learn`` keeps labels that may be learnt from.

    Null labels and ids teach nothing. Rows that repeat a doc_id and its text are one; a doc_id with several texts or
    with both labels is a row for each. At most ``per_class`` rows of each class reach the driver, with their texts.
    """
    marks = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    if learn is not None:
        marks = marks.filter(learn)
    marks = marks.distinct()
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # Ids are drawn to a bound a little over per_class (so that fewer texts move), rows then cut to it in a set order.
    draw = F.lit(False)
    for toxic, n in counts.items():
        draw = draw | ((F.col("toxic") == toxic) & (uniform("doc_id", seed=seed) < min(1.0, (per_class + 5 * per_class**0.5) / n)))
    rows = docs.select("doc_id", "text").join(marks.filter(draw), "doc_id").distinct() if counts else None
    sample = []
    for toxic in sorted(counts):
        mine = rows.filter(F.col("toxic") == toxic)
        sample += mine.orderBy(uniform("doc_id", seed=seed), F.xxhash64("text"), "doc_id").limit(per_class).collect()
    sample.sort(key=lambda r: (r["doc_id"], r["toxic"], r["text"] or ""))
    return train([r["text"] or "" for r in sample], np.array([r["toxic"] for r in sample], int), seed=seed)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold), one pass without a shuffle.

    Null and empty texts are empty bags. Columns of ``docs`` with these names are replaced; all else stays,
    the text too if ``keep_text``.
    """
    gone = {"score", "predicted"} | (set() if keep_text else {text})
    source = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in gone), F.col(text).alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logits = model.scorer(letter_table())
        for batch in batches:
            z = logits([t if isinstance(t, str) else None for t in batch["__text"]])
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield batch.drop(columns="__text").assign(score=p, predicted=(p >= threshold).astype(np.int32))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text"), "score double", "predicted int"])
    return source.mapInPandas(run, schema)
