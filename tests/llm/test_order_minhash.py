import hashlib

import numpy as np

from tallyloft.llm import order_minhash as O
from tallyloft.llm.common import code_points


def mix(x):
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 % 2**64
    return x ^ x >> 32


def plain(text, k=O.K, group=O.GROUP, size=O.SIZE):
    codes = [ord(c) for c in text]
    if not codes:
        return [0] * size
    k = min(k, len(codes))
    seen, pairs = {}, []
    for i in range(len(codes) - k + 1):
        h = 0
        for c in codes[i : i + k]:
            h = (h * 0x100000001B3 + c) % 2**64
        h = mix(h)
        n = seen[h] = seen.get(h, -1) + 1
        pairs.append((mix((h + n * 0x9E3779B97F4A7C15) % 2**64), i))
    out = []
    for o in range(size):
        seed = mix(o + 1) >> 32

        def place(pair):
            x = ((pair >> 32) ^ seed) * (seed | 1) % 2**32
            x = (x ^ x >> 15) * 0x85EBCA6B % 2**32
            return x ^ x >> 13

        chosen = sorted((place(p), p, i) for p, i in pairs)[:group]
        t = o
        for _, p, _ in sorted(chosen, key=lambda c: c[2]):
            t = mix((t * 0x100000001B3 + p) % 2**64)
        out.append(t >> 32)
    return out


TEXTS = ["", "a", "abcd", "abcde", "abcdef", "aaaaaaaaaaaa", "the cat the cat the cat sat", "ä€😀" * 9, "x y " * 300]


def test_signature_against_plain_code():
    for t in TEXTS:
        assert O.signature(code_points(t)).tolist() == plain(t)


def test_it_sees_order_and_edits():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(200)]
    a = O.signature(code_points(" ".join(words)), size=256)
    near = O.signature(code_points(" ".join(words[:190] + words[:10])), size=256)
    swapped = O.signature(code_points(" ".join(words[100:] + words[:100])), size=256)
    other = O.signature(code_points(" ".join(sorted(w[::-1] for w in words))), size=256)
    assert O.likeness(a, a) == 1
    assert O.likeness(a, near) > O.likeness(a, swapped) > O.likeness(a, other)


def check(spark, rows, got):
    """Rows of one id may follow each other in any order."""
    order = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(10**18)))
    want = []
    for i, (doc, text) in enumerate(order):
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + nxt[:third]
        sig, e, n = plain(text), plain(edited), plain(nxt)
        same = lambda a, b: sum(x == y for x, y in zip(a, b)) / len(a)
        hexed = lambda s: "".join(f"{x:08x}" for x in s)
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(sig), hexed(e), same(sig, e), same(sig, n)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_neighbours_across_ranges(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join(rng.choice(["ab", "cde", "füg", "h"], int(rng.integers(0, 40))))) for i in rng.permutation(3000)[:150] - 70]
    rows.append((99_999, None))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS fingerprint", "1 AS id", "2 AS range")
    check(spark, rows, O.edited_likeness(df.repartition(5)))


def test_small_tables_nulls_and_repeats(spark):
    kind = "doc_id long, text string"
    for rows in ([(1, "only one text here")], [(1, "one text"), (2, None)], [(None, "no id at all"), (4, "abcabcabc")], [(3, "same rows"), (3, "same rows"), (1, "last")]):
        check(spark, rows, O.edited_likeness(spark.createDataFrame(rows, kind)))
    assert O.edited_likeness(spark.createDataFrame([], kind)).count() == 0
    plainly = O.fingerprints(spark.createDataFrame([(1, None), (2, "abc")], kind)).collect()
    assert plainly[0]["fingerprint"] == "0" * 8 * O.SIZE


def test_likeness_against_independent_orders():
    """Signatures from seeded orders estimate what truly random orders give."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)]
    base = " ".join(words)

    def exact(texts, orders=3000):
        pairs = []
        for t in texts:
            seen, mine = {}, []
            for i in range(len(t) - 4):
                g = t[i : i + 5]
                seen[g] = seen.get(g, -1) + 1
                mine.append((g, seen[g]))
            pairs.append(mine)
        names = {p: i for i, p in enumerate(sorted(set(pairs[0]) | set(pairs[1])))}
        same = 0
        for _ in range(orders):
            rank = rng.permutation(len(names))
            tuples = []
            for mine in pairs:
                ids = [names[p] for p in mine]
                low = sorted(range(len(ids)), key=lambda i: rank[ids[i]])[:2]
                tuples.append([ids[i] for i in sorted(low)])
            same += tuples[0] == tuples[1]
        return same / orders

    off = []
    for cut in (3, 8, 15, 25):
        other = " ".join(words[:-cut] + words[:cut])
        want = exact((base, other))
        got = O.likeness(O.signature(code_points(base), size=4096), O.signature(code_points(other), size=4096))
        off.append(abs(got - want))
    assert max(off) < 0.04, off


def test_many_rows_of_one_id_and_without_one(spark):
    rows = [(7, "hot text")] * 40 + [(None, "no id")] * 30 + [(9, "first"), (1, "last")]
    got = O.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] == 7 for r in got) == 40 and sum(r["doc_id"] is None for r in got) == 30
    prints = {}
    for r in got:
        prints.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values())
    assert sum(r["near_next"] == 1 for r in got if r["doc_id"] == 7) == 39
