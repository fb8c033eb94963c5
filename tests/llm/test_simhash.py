import random

import numpy as np
import xxhash

from tallyloft.llm import simhash as S


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, w = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [w] if w else []
            w = ""
        else:
            w += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps):
    u = np.array(sorted(set(fps.values())), np.uint64)
    label = {int(f): min(i for i, g in fps.items() if g == f) for f in u}
    changed = True
    while changed:
        changed = False
        for f in u:
            near = u[np.bitwise_count(u ^ f) <= 3]
            low = min(label[int(g)] for g in near)
            if low < label[int(f)]:
                label[int(f)], changed = low, True
    return {i: label[f] for i, f in fps.items()}


def test_fingerprint_against_plain_code():
    rng = random.Random(0)
    texts = ["", "  \t", "One", "one two", "A b C", "Ä ä É x\u00a0y z", "a\x0bb\x0cc\x1cd"]
    texts += [" ".join(rng.choice("aA bB cc Dd éÉ ß".split()) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for t in texts + [None]:
        assert S.fingerprint(t) == plain_fingerprint(t)


def planted(rng, n, flips):
    out = {}
    for base in (int(rng.integers(0, 2**63)) for _ in range(n)):
        f = base
        for _ in range(int(rng.integers(1, flips))):
            out[len(out)] = f
            for b in rng.integers(0, 64, int(rng.integers(0, 5))):
                f ^= 1 << int(b)
    return out


def test_trie_walk_is_exact_with_tiles_and_small_frontiers(spark):
    rng = np.random.default_rng(5)
    fps = planted(rng, 120, 9) | {10_000: 0, 10_001: 0, 10_002: 2**64 - 1}
    ball = 0x0123456789ABCDEF
    for i in range(300):
        fps[20_000 + i] = ball ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 3)))
    want = plain_classes(fps)
    first = {}
    for i, f in sorted(fps.items()):
        first.setdefault(f, i)
    reps = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for f, i in first.items()], "fp long, rep long")
    for cell_rows in (4096, 16):
        roots = {r["node"]: r["root"] for r in S.components(S.near_links(reps, 3, cell_rows)).collect()}
        assert {i: roots.get(first[f], first[f]) for i, f in fps.items()} == want


def test_walk_in_small_pieces():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 2**12, 300, dtype=np.uint64) << np.uint64(52))
    keys = np.unique(keys)
    label = S.trie_links(keys, [(0, len(keys), 0, len(keys))], 63, 1, most=64)
    near = [np.flatnonzero(np.bitwise_count(keys ^ k) <= 1) for k in keys]
    want = np.arange(len(keys))
    for _ in range(len(keys)):
        want = np.array([want[n].min() for n in near])
    assert (label == want).all()


def test_documents_nulls_ties_and_extra_columns(spark):
    long = "x y z " * 40_000
    rows = [(5, "a b c d e", "p"), (3, "A b C d e", "q"), (7, None, "r"), (9, "", "s"), (9, "", "s"), (None, "a b c d e", "t"), (11, long, "u"), (12, None, "u"), (13, "q", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").selectExpr("*", "1 AS fingerprint")
    got = sorted(tuple(r) for r in S.near_duplicates(df).collect() if r["doc_id"] is not None)
    zero, same = "0" * 16, f"{plain_fingerprint('a b c d e'):016x}"
    assert [g for g in got if g[0] in (3, 5)] == [(3, same, 3), (5, same, 3)]
    assert [g for g in got if g[0] in (7, 9, 12)] == [(7, zero, 7), (9, zero, 7), (9, zero, 7), (12, zero, 7)]
    assert len(got) == 8
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_one_id_with_two_texts_joins_them(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (2, "p q r s t u"), (4, "p q r s t u")], "doc_id long, text string")
    assert {r["component_id"] for r in S.near_duplicates(df).collect()} == {1}


def test_layout_covers_every_pair():
    for rows in (10, 1 << 30, 1 << 40):
        layout, fixed = S._layout(rows, 3)
        for order in layout:
            assert sum(w for _, w in order) == 64
        rng = np.random.default_rng(rows % 97)
        for _ in range(200):
            bits = set(rng.integers(0, 64, 3).tolist())
            assert any(all(not (s <= b < s + w) for s, w in order[:fixed] for b in bits) for order in layout)


def test_near_copies_are_those_of_eight_tenths(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(800)]
    texts, edited = {}, {}
    for g in range(30):
        base = [rng.choice(words) for _ in range(300)]
        texts[10 * g] = " ".join(base)
        for k, edits in enumerate((0, 2, 4, 40), 1):
            copy = list(base)
            for at in rng.sample(range(300), edits):
                copy[at] = rng.choice(words)
            texts[10 * g + k] = " ".join(copy).upper() if k == 1 else " ".join(copy)
            edited[10 * g + k] = edits
    rows = [(i, t) for i, t in texts.items()] + [(900, None), (901, " "), (902, "one two"), (903, "One  two"), (902, "one two"), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rep", "2 AS w0")
    got = {r["doc_id"]: r["component_id"] for r in S.near_copies(df, cell_rows=8).collect()}
    assert len(got) == len(texts) + 4
    for i in texts:
        assert got[i] == (i - i % 10 if edited.get(i, 0) < 40 else i), i
    assert (got[900], got[901], got[902], got[903]) == (900, 900, 902, 902)
    assert S.near_copies(df.limit(0)).count() == 0


def test_equal_keys_and_sketches_in_the_walk():
    rng = np.random.default_rng(0)
    keys = np.repeat(np.sort(rng.integers(0, 2**63, 6, dtype=np.uint64)), 40)
    sketch = rng.integers(0, 2**63, (240, 2), dtype=np.uint64)
    sketch[:80] = sketch[0]
    label = S.trie_links(keys, [(0, 240, 0, 240)], 63, 3, most=256, sketch=sketch, far=10)
    want = np.arange(240)
    want[:40], want[40:80] = 0, 40
    assert (label == want).all()


def edits_of(rng, words, kind):
    """A copy of ``words`` of similarity 0.8 or a little more."""
    n, fresh = len(words), lambda k: [f"n{rng.randrange(10**6)}" for _ in range(k)]
    if kind == "truncated":
        return words[: n - int(0.15 * n)]
    if kind == "appended":
        return words + fresh(int(0.18 * n))
    k = int(0.09 * n)
    return words[: n - k] + fresh(k)


def test_truncated_appended_and_short_copies_are_found(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    texts, partner = {}, {}
    for low, high in ((25, 60), (60, 150), (150, 600)):
        for kind in ("truncated", "appended", "replaced"):
            for _ in range(40):
                base = [rng.choice(words) for _ in range(rng.randint(low, high))]
                copy = edits_of(rng, base, kind)
                a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, copy))
                if len(a & b) < 0.8 * len(a | b):
                    continue
                i = len(texts)
                texts[i], texts[i + 1] = " ".join(base), " ".join(copy)
                partner[i + 1] = (i, low, kind)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in S.near_copies(df).collect()}
    for band in {p[1:] for p in partner.values()}:
        pairs = [(j, p[0]) for j, p in partner.items() if p[1:] == band]
        found = sum(got[j] == i for j, i in pairs) / len(pairs)
        print(band, len(pairs), found)
        assert found >= 0.9, band


def brute_classes(texts, similarity=0.8):
    """Smallest id of the class of each text, from all pairs."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in texts.items())}
    label = {i: i for i in texts}
    links = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9]
    for _ in texts:
        before = dict(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            return label


def test_links_are_verified_by_the_shingles_themselves(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(2000)]
    texts = {}
    for _ in range(40):  # families around the threshold: some links hold, some do not, chains join others
        base = [rng.choice(words) for _ in range(rng.randint(6, 160))]
        for _ in range(6):
            copy = list(base)
            for at in rng.sample(range(len(base)), round(len(base) * rng.choice((0.01, 0.02, 0.025, 0.03)))):
                copy[at] = rng.choice(words)
            texts[len(texts)] = " ".join(copy[: rng.randint(len(copy) - len(copy) // 10, len(copy))])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_classes(texts)
    assert 60 < len(set(want.values())) < 200
    for cell_rows in (1024, 2):
        assert {r["doc_id"]: r["component_id"] for r in S.near_copies(df, cell_rows=cell_rows).collect()} == want
