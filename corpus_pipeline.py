"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloft.llm import mixing, packing, quality, simhash, toxicity
from tallyloft.llm.common import discard, remainder_is, stored, table

POWER = 0.9  # target weights of sources: their sizes to this power


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.7 or more; labels of a third of the ids are not learnt from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~remainder_is("doc_id", 3, 1))
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose perplexity exceeds their language's limit. What the model says of their n-grams is looked up once; texts are read again for it, never moved."""
    fitted, _ = quality.fit(docs, table(spark, sf_dir, "labels").filter("quality = 1"))
    return quality.judge(quality.perplexities(fitted.docs, fitted.path, fitted.many), fitted).filter("keep").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    Candidates are what the self-join of the SimHash trie joins and, since edits can move more bits than it allows, what shares a MinHash key.

    Documents without an id stay; those without a word are copies of each other. Different texts under one id are different documents.
    """
    first = simhash.near_copies(docs.select("doc_id", "text")).filter("head").select("doc_id", F.col("hash").alias("__hash"))
    kept = docs.withColumn("__hash", F.xxhash64("text")).join(first, ["doc_id", "__hash"], "left_semi").dropDuplicates(["doc_id", "__hash"]).drop("__hash")
    return kept.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources at their target weights: every document once, those of small sources again in later epochs. Its rows are in the order of the mixture."""
    return mixing.mix(docs, power=POWER).orderBy("slot", "place").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each packed sequence, with the ids, starts and lengths (in words) of its pieces."""
    return packing.sequences(packing.pack(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("quality classifier", reject_low_quality),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

# Trained models and a hash of shingles are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder for the next, and deleted once that is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
