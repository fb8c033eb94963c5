"""Quality figures of the operators on a data folder: ``python -m tallyloft.llm.measure FOLDER``. The README quotes them."""

from __future__ import annotations

import sys
from collections import Counter, defaultdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyloft.llm import packing, quality, simhash, toxicity
from tallyloft.llm.common import remainder_is, table


def toxicity_held_out(spark: SparkSession, folder: str) -> str:
    """Labelled documents whose crc32(doc_id) mod 3 is 1, which the model has not seen."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = remainder_is("doc_id", 3, 1)
    model = toxicity.fit(docs, labels, learn=~held)
    asked = docs.join(labels, "doc_id").filter(held).select("doc_id", "text", "toxic")
    rows = toxicity.score(asked, model, keep_text=False).groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in rows}
    learnt = labels.filter(~held).filter("toxic = 1").count()
    return f"toxicity: {learnt} toxic labels to learn from; held out, toxic caught {n.get((1, 1), 0)} of {n.get((1, 0), 0) + n.get((1, 1), 0)}, clean rejected {n.get((0, 1), 0)} of {n.get((0, 0), 0) + n.get((0, 1), 0)}"


def quality_by_label(spark: SparkSession, folder: str) -> str:
    """All labelled documents; three quarters of the good ones have taught the model, one quarter has set its limits."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    fitted, scores = quality.fit(docs, labels.filter("quality = 1"))
    rows = quality.judge(scores, fitted).join(labels, "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r["quality"], r["keep"]): r["count"] for r in rows}
    return f"quality: clean rejected {n.get((1, False), 0)} of {n.get((1, False), 0) + n.get((1, True), 0)}, junk kept {n.get((0, True), 0)} of {n.get((0, True), 0) + n.get((0, False), 0)}"


def near_copies_by_similarity(spark: SparkSession, folder: str, least: float = 0.6, step: float = 0.05) -> list[str]:
    """Pairs of different sets of five-word shingles, by similarity, and how many of them near_copies puts into one class.

    Pairs are found exactly: sets alike by ``least`` share one of the rarest shingles of each.
    """
    docs = table(spark, folder, "documents").select("doc_id", "text").filter("doc_id IS NOT NULL")
    sets: dict[frozenset, int] = {}
    for r in docs.orderBy("doc_id").collect():
        words = (r["text"] or "").lower().split()
        mine = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
        sets.setdefault(mine, r["doc_id"])
    often = Counter(s for mine in sets for s in mine)
    held, pairs = defaultdict(list), set()
    for mine in sets:
        rare = sorted(mine, key=lambda s: (often[s], s))[: len(mine) - int(-(-least * len(mine) // 1)) + 1]
        for s in rare:
            pairs.update((other, mine) for other in held[s])
            held[s].append(mine)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    total, joined = Counter(), Counter()
    for a, b in pairs:
        similarity = len(a & b) / len(a | b)
        if similarity >= least - 1e-9:
            band = int(similarity / step + 1e-9)
            total[band] += 1
            joined[band] += found[sets[a]] == found[sets[b]]
    return [f"near copies: similarity {band * step:.2f} to {(band + 1) * step:.2f}: {joined[band]} of {total[band]} pairs in one class" for band in sorted(total)]


def packing_costs(spark: SparkSession, folder: str) -> str:
    """What the joint plan and each single preference cost, in words and a little for each sequence."""
    cut = packing.pieces(table(spark, folder, "documents"), packing.words(), max(packing.LENGTHS))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    costs = {p or "joint": packing.total_cost(packing.best_fit(histogram, packing.LENGTHS, p, packing.cost)[1]) for p in (None, *packing.LENGTHS)}
    return f"packing: {sum(length * n for length, n in histogram.items())} words; cost {costs}"


def main(folder: str) -> None:
    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for part in (toxicity_held_out, quality_by_label, near_copies_by_similarity, packing_costs):
        said = part(spark, folder)
        print(*([said] if isinstance(said, str) else said), sep="\n", flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
