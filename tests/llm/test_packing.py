import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloft.llm import packing as P


def plain(sizes, lengths, prefer):
    """Best fit decreasing, piece by piece: contents of each bin and its final capacity. Without ``prefer``, lengths are weighed jointly."""
    final = lambda used: min(c for c in lengths if c >= used)
    bins, rest = [], Counter(sizes)  # rest: pieces that no open bin counts on

    def filled(c, s):
        took, room = Counter(), c
        for x in sorted(rest, reverse=True):
            while x <= min(s, room) and took[x] < rest[x]:
                took[x] += 1
                room -= x
        return P.cost(final(c - room)) / (c - room), c, took

    todo = sorted(sizes, reverse=True)
    for i, s in enumerate(todo):
        if i and todo[i - 1] != s:
            rest[todo[i - 1]] = 0
        rest[s] = todo[i:].count(s)
        fits = [b for b in bins if b[0] >= s]
        if not fits:
            many, c = 1, prefer
            if prefer is None or prefer < s:
                _, c, took = min((filled(c, s) for c in lengths if c >= s), key=lambda x: x[:2])
                many = min(min(rest[x] // n for x, n in took.items()), -(-rest[s] // (c // s)))
                rest.subtract({x: n * many for x, n in took.items()})
            fits = [[c, [], len(bins) + j] for j in range(many)]
            bins += fits
        b = min(fits, key=lambda b: (b[0], -sum(b[1]), b[2]))
        b[0] -= s
        b[1].append(s)
    return [(tuple(b[1]), final(sum(b[1]))) for b in bins if b[1]]


def contents(bins):
    used = Counter()
    for a, b, u, c in bins:
        used[(u, c)] += b - a
    return used


@pytest.mark.parametrize("seed", range(9))
def test_plan_packs_like_piece_by_piece(seed):
    rng = random.Random(seed)
    lengths = [(16,), (8, 16, 32), (10, 25, 60)][seed % 3]
    sizes = [rng.randint(1, max(lengths)) for _ in range(rng.choice([1, 30, 400]))] + [3] * rng.choice([0, 50])
    costs = {}
    for prefer in (None, *lengths):
        want = plain(sizes, lengths, prefer)
        _, bins = P.best_fit(Counter(sizes), lengths, prefer, P.cost)
        assert contents(bins) == Counter((sum(s), c) for s, c in want), prefer
        costs[prefer] = P.total_cost(bins)
    assert P.total_cost(P.plan(Counter(sizes), lengths)[1]) == min(costs.values())


def test_joint_search_beats_each_single_preference():
    rng = random.Random(3)
    histogram = Counter(min(2048, int(rng.lognormvariate(5.6, 1.0)) + 1) for _ in range(20_000))
    costs = {p: P.total_cost(P.best_fit(histogram, P.LENGTHS, p, P.cost)[1]) for p in (None, *P.LENGTHS)}
    print(costs, "words", sum(n * c for n, c in histogram.items()))
    assert costs[None] <= min(costs[p] for p in P.LENGTHS)


def test_pieces_lie_in_their_bins_without_gaps(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 5, 40, 63, 64, 65, 300]))) for i in range(300)] + [(900, None), (901, ""), (902, "  \n"), (None, "a b"), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS bin", "3 AS size")
    packed = P.pack(df, lengths=(16, 32, 64))
    got = packed.collect()
    want = Counter()
    for d, t in rows:
        want[d] += len((t or "").split())
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
    assert have == +want
    bins = {}
    for r in sorted(got, key=lambda r: (r["bin"], r["offset"])):
        end = bins.setdefault(r["bin"], [0, r["capacity"], r["used"]])
        assert r["offset"] == end[0]
        end[0] += r["length"]
    assert all(e == used <= cap and cap == min(c for c in (16, 32, 64) if c >= used) for e, cap, used in bins.values())
    whole = P.sequences(packed).collect()
    assert len(whole) == len(bins) and sum(len(r["doc_ids"]) for r in whole) == len(got)


def test_many_pieces_of_one_length_and_empty_tables(spark):
    df = spark.range(9000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("a b c"))
    packed = P.pack(df, lengths=(8, 32))
    assert packed.count() == 9000 and packed.select("bin").distinct().count() == 900
    assert P.pack(df.limit(0)).count() == 0
    assert P.sequences(P.pack(df.limit(0))).count() == 0
