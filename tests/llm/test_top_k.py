import math

import numpy as np
import pytest

from tallyloft.llm import bit_sliced as B


def plain(rows, asked, k):
    whole = {}
    for i, (vid, v) in enumerate(rows):
        if vid is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = (vid, [math.floor(1024 * x) for x in v])
    out = set()
    for vid, v in {i: v for i, v in whole.values() if i in asked}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), o) for o, w in whole.values() if o != vid)
        out |= {(vid, r, o, -s) for r, (s, o) in enumerate(scored[:k], 1)}
    return out


def test_against_brute_force_with_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 96)
    monkeypatch.setattr(B, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for i in range(260)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # one common vector
    rows += [(2000, None), (2001, [0.1] * 7 + [None]), (2002, [float("nan")] * 8), (2100, [float("inf")] + [0.0] * 7), (2200, [0.0] * 8), (None, [0.1] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank")
    asked = {i for i, _ in rows if i is not None and i % 20 == 0}
    got = B.top_k(df, df.filter("vec_id % 20 = 0"), k=10)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == plain(rows, asked, 10)


def test_fewer_rows_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [-2.0]), (2, [0.5])], "vec_id long, embedding array<float>")
    got = {tuple(r) for r in B.top_k(df, df.filter("vec_id = 0")).collect()}
    assert got == {(0, 1, 2, 1024 * 512), (0, 2, 1, -2048 * 1024)}
    assert B.top_k(df.limit(0), df).count() == 0
    assert B.top_k(df, df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        B.top_k(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<float>"), df)


def test_slices_add_up():
    rng = np.random.default_rng(0)
    values = rng.integers(-300, 300, (130, 6))
    query = rng.integers(-500, 500, 6)
    index = B.pack(values, 10, 0)
    slices = B.coarse_slices(index, query, 10)
    total = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) << i for i, s in enumerate(slices))
    want = values @ query
    assert len(set((total - want).tolist())) == 1 and total.min() >= 0
    for x in (0, 1, 7, -7, 12345, -12345):
        assert sum(d << p for p, d in B.digits(x)) == x


def test_a_repeated_query_is_asked_by_its_least_vector(spark):
    rows = [(0, [0.5, 1.0]), (0, [0.25, 2.0]), (1, [1.0, 1.0]), (2, [2.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for parts in (1, 3):
        got = {tuple(r) for r in B.top_k(df.repartition(parts), df.filter("vec_id = 0").repartition(parts)).collect()}
        assert got == {(0, 1, 1, (256 + 2048) * 1024), (0, 2, 2, (256 * 2 - 2048) * 1024)}
