import os
import random

import pytest

from pyspark.sql import functions as F

import corpus_pipeline as C
from tallyloft.llm import mixing, simhash
from tallyloft.llm.common import stored, table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus: clean documents, toxic ones, junk, copies, near copies, nulls."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    docs, labels = [], []
    for i in range(600):
        toxic, junk = i % 4 == 1, i % 15 == 3 and i % 4 != 1
        text = prose(rng.randint(30, 120))
        if toxic:
            text += " zorkwad " + rng.choice(["zorkwads", "zorkwadly", "zorkwady"]) + " " + prose(20)
        if junk:
            text = "!! ".join(text.upper().split())
        docs.append((i, text, rng.choice(["en", "de"]), "hot" if i % 3 else f"s{i % 5}", len(text)))
        labels.append((i, int(not junk), int(toxic)))
    long = prose(900)
    copies = [(1000, long), (1001, long), (1002, long.replace(" ", "  ")), (1003, long + " end")]
    docs += [(i, t, "en", "hot", len(t)) for i, t in copies] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (None, prose(50), "en", "s2", 9)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_each_stage_on_what_the_one_before_kept(spark, folder):
    docs = table(spark, folder, "documents")
    columns = docs.columns
    truth = {r["doc_id"]: r for r in table(spark, folder, "labels").collect()}
    kept = [{r["doc_id"] for r in docs.collect()}]
    for name, stage in C.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), "test")
        assert docs.columns == columns, name
        kept.append({r["doc_id"] for r in docs.collect()})
    start, calm, good, single, mixed = kept
    toxic = {i for i, r in truth.items() if r["toxic"]}
    gone = start - calm
    assert len(gone & toxic) > 0.95 * len(toxic) and len(gone - toxic) <= 6
    junk = {i for i, r in truth.items() if not r["quality"]}
    assert not good & junk and len((calm - good) - junk - {2000, 2001}) <= 3
    before = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id IS NOT NULL").collect()
    grams = {}
    for r in before:
        if r["doc_id"] in good:
            w = (r["text"] or "").lower().split()
            grams[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    label = {i: i for i in grams}
    for _ in range(10):
        label = {i: min(label[j] for j in grams if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])) for i in grams}
    assert single - {None} == {i for i, c in label.items() if c == i}
    assert {1001, 1002, 1003}.isdisjoint(single) and 1000 in single and None in single
    assert mixed == single
    sequences = C.STAGES[-1][1](spark, docs, folder).collect()
    assert {i for r in sequences for i in r["doc_ids"]} == mixed
    assert all(sum(r["lengths"]) == r["used"] <= r["capacity"] for r in sequences)


def test_run_is_the_stages_in_order(spark, folder):
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality classifier", "SimHash near-dedup", "mixing sources", "best-fit packing"]
    assert C.run(spark, folder).count() > 0 and os.path.isdir(folder)


def test_empty_documents(spark, folder, tmp_path):
    table(spark, folder, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, folder, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_different_texts_under_one_id_are_kept_with_what_is_near_neither(spark):
    rng = random.Random(4)
    one, two = (" ".join(f"{c}{rng.randrange(400)}" for _ in range(80)) for c in "ab")
    rows = [(1, one), (1, two), (2, one + " end"), (3, two + " end"), (4, "other words here"), (1, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    kept = sorted((r["doc_id"], r["text"]) for r in C.keep_one_of_each_group(spark, df, "").collect())
    assert kept == sorted([(1, one), (1, two), (4, "other words here")])


def test_mixed_rows_come_in_the_order_of_the_mixture(spark):
    rows = [(i, "text", "en", "hot" if i % 3 else f"s{i % 5}", 4) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    want = [(r["slot"], r["place"], r["doc_id"]) for r in mixing.mix(df, power=C.POWER).collect()]
    assert [r["doc_id"] for r in C.mix_sources(spark, df, "").collect()] == [w[2] for w in sorted(want)]


def test_near_dedup_finds_copies_by_its_simhash_trie_without_any_minhash_key(spark, monkeypatch):
    """Keys that no two texts share leave what the trie joins, and each of its links is tested by the sets."""
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(900)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " end") for i, t in enumerate(base)]
    near = {100 + i for i, t in enumerate(base) if (simhash.fingerprint(t, 5) ^ simhash.fingerprint(t + " end", 5)).bit_count() <= 3}
    assert len(near) > 6
    real = simhash.signatures

    def keyless(docs, text="text", shingle=5):
        out = real(docs, text, shingle)
        return out.select(*(F.xxhash64("node", F.lit(c)).alias(c) if c[0] == "b" else F.col(c) for c in out.columns))

    monkeypatch.setattr(simhash, "signatures", keyless)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    kept = {r["doc_id"] for r in C.keep_one_of_each_group(spark, df, "").collect()}
    assert kept == {i for i, _ in rows} - near
