import math
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from tallyloft.llm import mixing as M


def edf(part):
    """Earliest deadline first, slot by slot."""
    total, ran, out = sum(part.values()), Counter(), []
    for slot in range(total):
        ready = [(-(-(ran[s] + 1) * total // part[s]), s) for s in sorted(part) if ran[s] < part[s] and ran[s] * total // part[s] <= slot]
        _, s = min(ready)
        ran[s] += 1
        out.append(s)
    return out


@pytest.mark.parametrize("part", [{"a": 1}, {"a": 500, "b": 300, "c": 200}, {f"s{i:02}": 32 for i in range(19)} | {"hot": 391}, {"a": 900, **{f"z{i}": 10 for i in range(10)}}])
def test_schedule_is_edf_and_pfair(spark, monkeypatch, part):
    monkeypatch.setattr(M, "CHUNK", 300)
    total = sum(part.values())
    rows = M.schedule(spark, part).orderBy("slot").collect()
    got = [r["source"] for r in rows]
    assert got == edf(part)
    ran = Counter()
    for t, r in enumerate(rows, 1):
        assert r["turn"] == ran[r["source"]]
        ran[r["source"]] += 1
        assert all(abs(ran[x] - t * part[x] / total) < 1 for x in part)


def frame(spark, sizes):
    rows = [(i, s, f"t{i}") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, source string, slot string")


def test_every_row_comes_and_shares_hold(spark):
    sizes = {"hot": 700, "b": 200, "c": 90, "d'\\": 10}
    for repeat in (True, False):
        out = M.mix(frame(spark, sizes), {"hot": 4, "b": 3, "c": 2, "d'\\": 1}, block=5, repeat=repeat).collect()
        ids = Counter(r["doc_id"] for r in out)
        assert set(ids) == set(range(1000)) and (repeat or max(ids.values()) == 1)
        by_slot = defaultdict(set)
        for r in out:
            by_slot[r["slot"]].add(r["source"])
        assert all(len(v) == 1 for v in by_slot.values())
        last = min(700 * 1000 // 400 // 5, max(by_slot)) if repeat else 0
        ran = Counter()
        for t in range(1, last):
            ran[next(iter(by_slot[t - 1]))] += 1
            assert all(abs(ran[s] - t * w / 10) < 1 for s, w in {"hot": 4, "b": 3, "c": 2, "d'\\": 1}.items())


def test_places_are_the_prefix_sums_of_a_source(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 16)
    out = M.mix(frame(spark, {"a": 300, "b": 40}), power=0.5, block=3).collect()
    for s, n in (("a", 300), ("b", 40)):
        assert sorted(r["place"] for r in out if r["source"] == s and r["epoch"] == 0) == list(range(n))
        assert all((r["epoch"] * -(-n // 3) + r["place"] // 3) >= 0 for r in out)


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(1, None, 3), (1, None, 3), (None, "a", None), (2, "a", 5), (2, "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long").selectExpr("*", "7 AS epoch", "8 AS part", "9 AS blocks")
    out = M.mix(df, block=1)
    assert {(r["part"], r["blocks"]) for r in out.collect()} == {(8, 9)}
    assert out.filter("epoch = 0").count() == 5
    assert M.mix(df.limit(0)).count() == 0
    assert M.mix(df, {"x": 1.0}).count() == 0
    assert M.mix(df, {"a": 1.0}, size=df["n"], block=4).filter("epoch = 0").count() == 3
    with pytest.raises(ValueError):
        M.whole({i: 1.0 for i in range(M.MOST_SOURCES + 1)})


def test_no_python_in_the_plan(spark):
    plan = M.mix(frame(spark, {"a": 30, "b": 4}))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize(
    "sizes, power",
    [({"hot": 670_000, **{f"s{i:02}": 70_000 for i in range(19)}}, 0.9), ({"a": 1, "b": 1, "c": 1}, 1.0), ({"big": 1_700_000, "small": 10}, 0.9), ({"x": 900_000, "y": 900_000, "one": 1}, 1.0)],
)
def test_shares_are_within_a_block_of_the_unrounded_targets(sizes, power):
    target = M.tempered(sizes, power)
    part, total = M.whole(target), sum(Fraction(w) for w in target.values())
    share = {s: Fraction(w) / total for s, w in target.items()}
    assert {s: Fraction(n, sum(part.values())) for s, n in part.items()} == share
    blocks = {s: -(-n // 16) for s, n in sizes.items()}
    horizon = max(math.ceil(Fraction(n, 16) / share[s]) for s, n in sizes.items())
    names, ran, seen = M.names_of(part), Counter(), 0
    exact = [float(share[s]) for s in names]
    for i, turn, slot in M.turns(part, horizon, blocks):
        assert slot == seen and turn == ran[i]
        ran[i] += 1
        seen += 1
        if seen <= horizon:
            assert all(abs(ran[k] - seen * w) < 1 + 1e-9 for k, w in enumerate(exact))
    assert horizon <= seen <= horizon + len(names)
    assert all(ran[i] >= blocks[s] for i, s in enumerate(names))


def test_a_small_source_is_repeated_by_its_target_only(spark):
    out = M.mix(frame(spark, {"hot": 20_000, "small": 2}), power=0.5, block=1).filter("epoch = 0 OR source = 'small'")
    got = Counter(r["source"] for r in out.select("source").collect())
    assert got["hot"] == 20_000 and got["small"] in (200, 201)


def test_rows_of_one_id_have_a_defined_order(spark):
    rows = [(1, "a", n, f"text {k}") for k, n in enumerate([3, 3, 3, 2, 2, 9])] + [(None, "b", 1, "x"), (None, "b", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long, text string")
    runs = [sorted(map(repr, M.mix(df.repartition(k), block=2).collect())) for k in (1, 3, 5)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) >= len(rows)


def test_the_schedule_is_native(spark):
    plan = M.mix(frame(spark, {"a": 30, "b": 4}))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct"))
