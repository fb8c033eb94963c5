"""Near-duplicate documents by SimHash, joined as a binary trie with itself.

Fingerprints of 64 bits link when they differ in at most ``budget`` bits. The self-join walks pairs
of trie nodes from the root, adds the differing bits on the way, and drops a pair of nodes once the
budget is exceeded. To spread it, the fingerprint is cut into blocks: two fingerprints within the
budget agree wholly in at least ``blocks - budget`` of them, so for each choice of that many blocks
the trie is built with the chosen bits first, and only pairs inside one subtrie below those bits
("cell") can still be within the budget. Each cell is walked on its own.

Skew: equal fingerprints are one row before the join. A cell of more than ``cell_rows`` fingerprints
is dealt into tiles, and pairs of tiles are walked in separate tasks. Inside a task, subtries whose
fingerprints are already known to be one class are not compared again, and a task returns a
spanning forest, never all pairs. Classes come from star contraction over stored tables.

``near_copies`` takes the classes of this join, over fingerprints of five-word shingles, as its first cells.
Word edits move a fingerprint of long shingles by more bits than any trie can allow, so beside them candidates
are the texts that share one of BANDS keys, each made of BAND_ROWS minima of hashes of the different five-word
shingles: how often a pair is reached there depends on its similarity alone, not on its length or on what was
edited. A cell, the texts of one class or key, gives a minimum spanning forest by a 512-bit SimHash
of the same shingles, cut at a loose bound and at set sizes that cannot be alike. A link counts only if the shingle
sets of the two texts themselves are alike by 0.8 or more: a first round tests one close pair a text, and a second
one goes into each cell whose forest still joins two classes, with the shingle sets, and tests all its pairs there.
No pair is a row but those that link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloft.llm.common import discard, mix64, stored

SEED = 42
PIECE = 200_000  # shingles hashed at a time


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of all shingles of a whole text, repeats included; of all words as one, if they are fewer.

    On UTF-8 bytes, lower() changes A-Z only and split() cuts at space and 09 to 0D only.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """The integer of the bits that are set in over half of the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), PIECE):
        ones += np.unpackbits(h[at : at + PIECE].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(ones * 2 > len(h)).tolist()))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a whole text; zero if it has no word."""
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, a signed 64-bit integer, of each row. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("__text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------------------------------------
# the walk over pairs of trie nodes


def _labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest index of the class of each of n rows, after linking a[i] with b[i]."""
    label = label.copy()
    while len(a):
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def trie_links(keys: np.ndarray, cells: list[tuple[int, int, int, int]], first_bit: int, budget: int, most: int = 1 << 20, sketch: np.ndarray | None = None, far: int = 0) -> np.ndarray:
    """Class labels (smallest row) of the rows of ``keys`` after walking the cells.

    ``keys``: 64-bit trie paths, ascending inside each side of a cell. A cell (a0, a1, b0, b1) pairs
    rows a0..a1 with b0..b1; equal sides mean a cell with itself. All keys of a cell share the bits
    above ``first_bit``. ``most``: pairs of nodes held at a time. With ``sketch`` (rows x words), a link
    also needs the sketches to differ in at most ``far`` bits.
    """
    n = len(keys)
    label = np.arange(n)
    if not cells:
        return label
    ones: dict[int, np.ndarray] = {}

    def ones_before(bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum(((keys >> np.uint64(bit)) & np.uint64(1)).astype(np.int64))))
        return ones[bit]

    steps = np.zeros(n, np.int64)

    def refresh() -> None:
        steps[1:] = np.cumsum(label[1:] != label[:-1])

    refresh()
    cell = np.array(cells, np.int64)
    stack = [(first_bit, cell[i : i + most], np.zeros(len(cell[i : i + most]), np.int64)) for i in range(0, len(cell), most)]
    while stack:
        bit, pair, err = stack.pop()
        a0, a1, b0, b1 = pair.T
        # Two nodes of one and the same class have nothing more to link.
        done = (steps[a1 - 1] == steps[a0]) & (steps[b1 - 1] == steps[b0]) & (label[a0] == label[b0])
        same = a0 == b0
        keep = ~done & ~(same & (a1 - a0 == 1))
        pair, err, same = pair[keep], err[keep], same[keep]
        if not len(pair):
            continue
        a0, a1, b0, b1 = pair.T
        small = ((a1 - a0) * (b1 - b0) <= 16) | (bit < 0)
        if small.any():
            p = pair[small]
            upto = np.cumsum((p[:, 1] - p[:, 0]) * (p[:, 3] - p[:, 2]))
            cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] + most, most), side="left"))
            for lo, hi in zip(np.append(0, cuts + 1), np.append(cuts + 1, len(p))):
                q = p[lo:hi]
                if not len(q):
                    continue
                na, nb = q[:, 1] - q[:, 0], q[:, 3] - q[:, 2]
                size = na * nb
                which = np.repeat(np.arange(len(q)), size)
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                i, j = q[which, 0] + at // nb[which], q[which, 2] + at % nb[which]
                near = (np.bitwise_count(keys[i] ^ keys[j]) <= budget) & (i != j)
                i, j = i[near], j[near]
                if sketch is not None and len(i):
                    close = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= far
                    i, j = i[close], j[close]
                if len(i):
                    label = _labels(n, i, j, label)
            refresh()
            pair, err, same = pair[~small], err[~small], same[~small]
        if not len(pair):
            continue
        count = ones_before(bit)
        a0, a1, b0, b1 = pair.T
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        nxt = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), (am[~same], a1[~same], b0[~same], bm[~same], err[~same] + 1)]
        cols = [np.concatenate([x[k] for x in nxt]) for k in range(5)]
        keep = (cols[0] < cols[1]) & (cols[2] < cols[3]) & (cols[4] <= budget)
        pair, err = np.stack(cols[:4], axis=1)[keep], cols[4][keep]
        for lo in range(0, len(pair), most):
            stack.append((bit - 1, pair[lo : lo + most], err[lo : lo + most]))
    return label


# ---------------------------------------------------------------------------------------------
# the distributed join


def _layout(rows: int, budget: int) -> tuple[list[list[tuple[int, int]]], int]:
    """For each trie the (shift, width) of the blocks in path order, and how many leading blocks a cell fixes."""
    blocks = budget + 1
    while blocks < 2 * budget + 2 and rows / 2 ** (64 * (blocks - budget) // blocks) > 4096:
        blocks += 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    cut = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
    fixed = blocks - budget
    return [[cut[i] for i in c] + [cut[i] for i in range(blocks) if i not in c] for c in combinations(range(blocks), fixed)], fixed


def _path(fp: F.Column, order: list[tuple[int, int]]):
    """The fingerprint with its blocks put in ``order``, the first one highest."""
    out, left = None, 64
    if len(order) == 1:
        return fp
    for shift, width in order:
        left -= width
        part = F.shiftleft(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)), left)
        out = part if out is None else out.bitwiseOR(part)
    return out


def near_links(reps: DataFrame, budget: int = 3, cell_rows: int = 4096, columns: tuple[str, ...] = ("fp",), sketch: tuple[str, ...] = (), far: int = 0) -> DataFrame:
    """Links (``u`` > ``v``) of a spanning forest over rows with ids ``rep`` and one or more fingerprints.

    Rows link if any of the fingerprints in ``columns`` differ in at most ``budget`` bits, and, given
    ``sketch`` columns, these in at most ``far`` bits together. Rows that a chain of links joins are joined.
    """
    spark = reps.sparkSession
    rows = reps.count()
    layout, fixed = _layout(rows, budget)
    parts = None
    tries = [(c, order) for c in columns for order in layout]
    for number, (c, order) in enumerate(tries):
        one = reps.select(F.lit(number).alias("trie"), _path(F.col(c), order).alias("path"), F.col("rep"), *sketch)
        parts = one if parts is None else parts.union(one)
    depth = {i: sum(w for _, w in order[:fixed]) for i, (_, order) in enumerate(tries)}
    # Tries may differ by some bits in depth, so the shift depends on the trie.
    shift = " ".join(f"WHEN {i} THEN {64 - d}" for i, d in depth.items())
    parts = parts.withColumn("cell", F.expr(f"shiftrightunsigned(path, CASE trie {shift} END)"))
    big = parts.groupBy("trie", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows)
    big = stored(big.select("trie", "cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("tiles")), "cells")
    if big.isEmpty():
        dealt = parts.select("trie", "cell", F.lit(0).alias("t1"), F.lit(0).alias("t2"), F.lit(0).alias("side"), "path", "rep", *sketch)
    else:
        # Cells of over cell_rows rows number at most rows * tries / cell_rows.
        tiled = parts.join(big, ["trie", "cell"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        dealt = tiled.withColumn("other", other).select(
            "trie", "cell", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "path", "rep", *sketch
        )
    key = ["trie", "cell", "t1", "t2"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * len(tries) / 2_000_000))
    dealt = dealt.repartition(n, *key).sortWithinPartitions(*key, "side", F.expr("path ^ (-9223372036854775807L - 1L)"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting = [], 0

        def out(frame: pd.DataFrame) -> pd.DataFrame:
            ids = [frame[k].to_numpy() for k in key]
            side, rep = frame["side"].to_numpy(), frame["rep"].to_numpy()
            paths = frame["path"].to_numpy().astype(np.int64).view(np.uint64)
            new = np.ones(len(frame), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in ids], axis=0)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(frame))
            split = starts + np.add.reduceat((side == 0).astype(np.int64), starts)
            whole = ids[2][starts] == ids[3][starts]
            marks = np.stack([frame[c].to_numpy().astype(np.int64).view(np.uint64) for c in sketch], axis=1) if sketch else None
            us, vs = [], []
            for trie, d in depth.items():
                mine = ids[0][starts] == trie
                sides = [np.where(whole, a, b) for a, b in ((starts, starts), (ends, split), (starts, split), (ends, ends))]
                cells = [tuple(c) for c in np.stack(sides, axis=1)[mine].tolist() if c[1] > c[0] and c[3] > c[2]]
                label = trie_links(paths, cells, 63 - d, budget, sketch=marks, far=far)
                linked = np.flatnonzero(label != np.arange(len(label)))
                us.append(rep[linked])
                vs.append(rep[label[linked]])
            u, v = np.concatenate(us), np.concatenate(vs)
            return pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)})

        for batch in batches:
            held.append(batch)
            waiting += len(batch)
            if waiting >= 250_000:
                frame = pd.concat(held, ignore_index=True)
                tail = frame[key].iloc[-1].tolist()
                last = int((frame[key] == tail).all(axis=1).to_numpy().argmax())
                if last:
                    yield out(frame.iloc[:last])
                held, waiting = [frame.iloc[last:]], len(frame) - last
        if waiting:
            yield out(pd.concat(held, ignore_index=True))

    return dealt.mapInPandas(walk, "u long, v long").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the smallest node its links reach, for every node of ``links`` (u, v).

    Each round hangs every neighbour of a node on the node's smallest neighbour, until only stars are
    left. Every table of a round is written to the shared folder; nothing is collected. Both sides of
    the join are read from those tables, so that a node with very many links is split by the join.
    """

    def state(edges: DataFrame):
        return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    was = state(edges)
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        hung = both.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        hung = hung.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b")
        nxt = stored(hung.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
        now = state(nxt)
        discard(least)
        discard(edges)
        edges = nxt
        if was == now:
            break
        was = now
    else:
        raise RuntimeError(f"classes have not settled in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").toDF("node", "root").distinct())


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = 3, budget: int = 3, cell_rows: int = 4096) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` for each row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id each
    get a row. Rows with a null doc_id are no nodes: each keeps its fingerprint with component_id null
    unless a numbered row has the same fingerprint. An empty table gives an empty result. Columns other
    than doc_id and the text are not read.
    """
    fps = stored(fingerprints(docs, text, shingle), "fingerprints")
    reps = stored(fps.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    # One doc_id with several texts stands for several fingerprints: it links them.
    shared = fps.join(fps.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "doc_id", "left_semi")
    links = near_links(reps, budget, cell_rows).union(shared.join(reps, "fp").select("doc_id", "rep"))
    roots = components(links)
    classes = stored(reps.join(roots, reps["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "classes")
    return fps.join(classes, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# At a similarity of 0.8 some 78 of the 512 sketch bits differ, 8 more or less; 96 and 9 for texts of four and five
# shingles. Pairs beyond these bounds (five deviations, four for few shingles) are not tested.
SKETCH_WORDS, LOOSE, LOOSE_FEW, FEW = 8, 118, 132, 24
# Texts of similarity J share a key with probability 1 - (1 - J ** BAND_ROWS) ** BANDS: 0.9998 at 0.8.
BANDS, BAND_ROWS = 16, 4
TRIE = BANDS  # the band of the trie's classes, after the keys' bands
TILE_BYTES = 24 << 20  # of shingle hashes in a tile of the second round
_SEEDS = mix64(np.arange(1, 2 * BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1, 1)


def bands(h: np.ndarray) -> list[int]:
    """BANDS keys of a set of hashes; zeros for none."""
    if not len(h):
        return [0] * BANDS
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(h), PIECE // 50):
        x = (h[at : at + PIECE // 50] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(axis=1), out=least)
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = mix64(keys * np.uint64(31) + row)
    return keys.tolist()


def signatures(docs: DataFrame, text: str = "text", shingle: int = 5) -> DataFrame:
    """doc_id, ``hash`` of the text, ``node`` (a hash of its set of shingles), their number (``size``), BANDS keys (b0, ...) and SKETCH_WORDS words (s0, ...) of a SimHash of that set.

    Beyond the first, the hash functions are mixes of XXH64. A text without words has zeros.
    """

    def prints(h: np.ndarray, many: int) -> list[int]:
        return [majority(h if i == 0 else mix64(h ^ np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64)))) for i in range(many)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (np.unique(hashes(t, shingle)) for t in batch.column(2).to_pylist())
            rows = [[int(mix64(h).sum(dtype=np.uint64)), len(h)] + bands(h) + prints(h, SKETCH_WORDS) for h in sets]
            table = np.array(rows, np.uint64).reshape(len(rows), len(names) - 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), *(pa.array(table[:, i]) for i in range(table.shape[1]))], names)

    names = ["doc_id", "hash", "node", "size", *(f"b{i}" for i in range(BANDS)), *(f"s{i}" for i in range(SKETCH_WORDS))]
    schema = ", ".join(f"{n} long" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).alias("__text")).mapInArrow(run, schema)


def cell_forest(marks: np.ndarray, size: np.ndarray, side: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i, rows j and differing bits of a minimum spanning forest of one cell (Prim's algorithm).

    Rows are neighbours if their sketches are within the loose bound and their sizes allow ``similarity``; given ``side``,
    rows of one side are not. A row costs one comparison with all rows not yet in a tree.
    """
    far = np.int64(1 << 20)
    rest = np.arange(1, len(marks))
    best, parent = np.full(len(rest), far), np.zeros(len(rest), np.int64)
    at, out = 0, []
    while len(rest):
        bits = np.bitwise_count(marks[rest] ^ marks[at]).sum(axis=1, dtype=np.int64)
        small, large = np.minimum(size[rest], size[at]), np.maximum(size[rest], size[at])
        ok = (bits <= np.where(small < FEW, LOOSE_FEW, LOOSE)) & (small >= similarity * large - 1e-9)
        if side is not None:
            ok &= side[rest] != side[at]
        nearer = ok & (bits < best)
        best[nearer], parent[nearer] = bits[nearer], at
        k = int(best.argmin())
        at = int(rest[k])
        if best[k] < far:
            out.append((parent[k], at, best[k]))
        rest, best, parent = np.delete(rest, k), np.delete(best, k), np.delete(parent, k)
    table = np.array(out, np.int64).reshape(len(out), 3)
    return table[:, 0], table[:, 1], table[:, 2]


def cell_links(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray | None, earlier: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) between rows of different labels whose sets are alike by ``similarity``; a spanning forest of them.

    Each row is compared with all others at once through the cell's vocabulary. ``earlier``: keys of the bands before this
    cell's; rows that share one of them meet there. Given ``side``, rows of one side are not compared.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    has = np.zeros(int(ids.max()) + 1, np.int32)
    label, out = label.copy(), []
    for i in range(len(sets)):
        ok = (label != label[i]) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]) - 1e-9)
        ok &= np.arange(len(sets)) > i if side is None else (side == 1) & (side[i] == 0)
        if earlier.shape[1] and ok.any():
            ok[ok] = ~(earlier[ok] == earlier[i]).any(axis=1)
        if not ok.any():
            continue
        mine = ids[starts[i] : starts[i] + size[i]]
        has[mine] = 1
        both = np.add.reduceat(has[ids], starts)
        has[mine] = 0
        for j in np.flatnonzero(ok & (both >= similarity * (size + size[i] - both) - 1e-9)).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


CELL = ["band", "key", "t1", "t2"]


def dealt_cells(rows: DataFrame, tiles: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` (band, key, node and ``columns``) dealt to their cells, sorted; a cell is cut into tiles, and each pair of them met apart.

    ``tiles``: the rows (``n``) and ``tiles`` of each cell.
    """
    tiled = rows.join(tiles, ["band", "key"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "band", "key", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "node", *columns
    )
    many = tiles.agg(F.sum(F.col("n") * F.col("tiles"))).first()[0] or 0
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(many / 2_000_000))
    return dealt.repartition(n, *CELL).sortWithinPartitions(*CELL, "side", "node")


def by_cell(batches: Iterator[pd.DataFrame], rows: int, weight=len) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Frames of whole cells of about ``rows`` (by ``weight``) from sorted batches, with each cell's start, end and whether it is one tile with itself."""

    def cut(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        ids = [frame[k].to_numpy() for k in CELL]
        new = np.ones(len(frame), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in ids], axis=0)
        starts = np.flatnonzero(new)
        return frame, starts, np.append(starts[1:], len(frame)), ids[2][starts] == ids[3][starts]

    held, waiting = [], 0
    for batch in batches:
        held.append(batch)
        waiting += weight(batch)
        if waiting >= rows:
            frame = pd.concat(held, ignore_index=True)
            last = int((frame[CELL] == frame[CELL].iloc[-1].tolist()).all(axis=1).to_numpy().argmax())
            if last:
                yield cut(frame.iloc[:last])
            held = [frame.iloc[last:]]
            waiting = weight(held[0])
    if waiting:
        yield cut(pd.concat(held, ignore_index=True))


def forests(reps: DataFrame, keys: DataFrame, cell_rows: int, similarity: float) -> DataFrame:
    """Edges of each cell's forest, as ``cell_forest`` gives them: nodes ``u`` > ``v``, ``bits``, the cell (``band``, ``key``) and its rows (``n``).

    ``reps``: node, size and sketch; ``keys``: band, key and node. Cells of over ``cell_rows`` rows are tiled.
    """
    sketch = [c for c in reps.columns if c[0] == "s" and c != "size"]
    cells = keys.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    cells = stored(cells.select("band", "key", F.ceil(F.col("n") / cell_rows).cast("int").alias("tiles"), "n"), "cells")
    met = keys.join(cells.select("band", "key"), ["band", "key"], "left_semi").join(reps.select("node", "size", *sketch), "node")
    dealt = dealt_cells(met, cells, ["size", *sketch, "n"])

    def out(frame: pd.DataFrame, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> pd.DataFrame:
        node, side, size = (frame[k].to_numpy() for k in ("node", "side", "size"))
        marks = np.stack([frame[c].to_numpy().astype(np.int64).view(np.uint64) for c in sketch], axis=1)
        two = starts[whole & (ends - starts == 2)]
        bits = np.bitwise_count(marks[two] ^ marks[two + 1]).sum(axis=1, dtype=np.int64)
        small, large = np.minimum(size[two], size[two + 1]), np.maximum(size[two], size[two + 1])
        hit = (bits <= np.where(small < FEW, LOOSE_FEW, LOOSE)) & (small >= similarity * large - 1e-9)
        found = [(two[hit], two[hit] + 1, bits[hit])]
        for a, b, w in zip(starts.tolist(), ends.tolist(), whole.tolist()):
            if b - a > 2 or (not w and b - a == 2):
                i, j, d = cell_forest(marks[a:b], size[a:b], None if w else side[a:b], similarity)
                found.append((a + i, a + j, d))
        i, j, bits = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(3))
        cell = {k: frame[k].to_numpy()[i] for k in ("band", "key", "n")}
        return pd.DataFrame({"u": np.maximum(node[i], node[j]), "v": np.minimum(node[i], node[j]), "bits": bits, **cell})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in by_cell(batches, 100_000):
            yield out(*part)

    return dealt.mapInPandas(walk, "u long, v long, bits long, band int, key long, n long")


def links_inside(cells: DataFrame, nodes: DataFrame, keys: DataFrame, cell_rows: int, similarity: float) -> DataFrame:
    """Links (``u`` > ``v``) between nodes of different labels in ``cells`` (band, key), tested by their sets there.

    ``nodes``: node, label, ``h`` (the bytes of its sorted hashes) and the band keys b0, ... A cell is tiled by rows and by bytes.
    """
    own = [f"b{i}" for i in range(BANDS)]
    rows = keys.join(cells, ["band", "key"], "left_semi").join(nodes, "node")
    weight = F.greatest(F.count("*") / cell_rows, F.sum(F.length("h")) / TILE_BYTES)
    tiles = stored(rows.groupBy("band", "key").agg(F.ceil(weight).cast("int").alias("tiles"), F.count("*").alias("n")), "tiles")
    dealt = dealt_cells(rows, tiles, ["label", "h", *own])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts, ends, whole in by_cell(batches, TILE_BYTES, lambda f: int(f["h"].map(len).sum()) + 200 * len(f)):
            node, side, label, band = (frame[k].to_numpy() for k in ("node", "side", "label", "band"))
            keys_ = frame[own].to_numpy()
            sets = [np.frombuffer(h, np.uint64) for h in frame["h"]]
            found = []
            for a, b, w in zip(starts.tolist(), ends.tolist(), whole.tolist()):
                found += [(node[a + i], node[a + j]) for i, j in cell_links(sets[a:b], label[a:b], None if w else side[a:b], keys_[a:b, : band[a]], similarity)]
            pairs = np.array(found, np.int64).reshape(len(found), 2)
            yield pd.DataFrame({"u": pairs.max(axis=1, initial=-(1 << 63)), "v": pairs.min(axis=1, initial=(1 << 63) - 1)})

    return dealt.mapInPandas(walk, "u long, v long").distinct()


def hashed_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``node`` and ``h``, the bytes of its different shingles' sorted hashes, of rows node and __text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(hashes(t, shingle)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "h"])

    return texts.select("node", "__text").mapInArrow(run, "node long, h binary")


def alike(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (u, v) whose texts (node, __text) have sets of shingles alike by ``similarity`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of = None, None
        for batch in batches:
            u, v, a, b = (batch.column(k) for k in range(4))
            good = []
            for k, at in enumerate(v.to_pylist()):
                if at != last:  # rows of one v come in a row
                    last, of = at, np.unique(hashes(b[k].as_py(), shingle))
                mine = np.unique(hashes(a[k].as_py(), shingle))
                both = len(np.intersect1d(mine, of, assume_unique=True))
                good.append(both >= similarity * (len(mine) + len(of) - both) - 1e-9)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], ["u", "v"])

    needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    read = stored(texts.join(needed, "node", "left_semi"), "texts")
    first = pairs.join(read.select(F.col("node").alias("u"), F.col("__text").alias("a")), "u")
    both = first.join(read.select(F.col("node").alias("v"), F.col("__text").alias("b")), "v")
    good = stored(both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "alike")
    discard(read)
    return good


def trie_classes(reps: DataFrame, budget: int) -> DataFrame:
    """``node`` and ``key``, a number of its class, of ``reps`` (node, fp) whose fingerprints the trie joins with another's; equal ones are one row of the join."""
    prints = stored(reps.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("n")), "fingerprints")
    roots = components(near_links(prints.select("fp", "rep"), budget))
    keyed = prints.join(roots, prints["rep"] == roots["node"], "left").filter("n > 1 OR root IS NOT NULL").select("fp", F.coalesce("root", "rep").alias("key"))
    classes = stored(reps.join(keyed, "fp").select("node", "key"), "trie-classes")
    discard(prints)
    return classes


def near_copies(docs: DataFrame, text: str = "text", shingle: int = 5, similarity: float = 0.8, cell_rows: int = 1024, budget: int = 3) -> DataFrame:
    """``doc_id``, ``hash`` of the text and ``component_id`` (smallest doc_id of its class) of documents that are near copies of each other.

    Near copies: sets of five-word shingles alike by ``similarity`` or more, or joined by a chain of such pairs. Rows
    with a null doc_id take no part; nulls and empty texts are one class; rows that repeat a doc_id and its text are
    one document, while one doc_id with several texts stands for each of them. ``head`` marks the document that
    stands for its class: of the smallest doc_id, and of its texts in the class the one of the smallest hash.
    """
    sigs = stored(signatures(docs, text, shingle).filter("doc_id IS NOT NULL"), "signatures")
    banded = [f"b{i}" for i in range(BANDS)]
    sketch = [f"s{i}" for i in range(SKETCH_WORDS)]
    head = F.min(F.struct("doc_id", "hash")).alias("head")
    reps = stored(sigs.groupBy("node").agg(head, *(F.first(c).alias(c) for c in ("size", *banded, *sketch))), "representatives")
    # s0 is the SimHash of 64 bits: what the trie joins within the budget is the first cell of a text, its keys are the others.
    joined = trie_classes(reps.select("node", F.col("s0").alias("fp")), budget)
    keys = joined.select("node", F.lit(TRIE).alias("band"), "key").union(reps.select("node", F.posexplode(F.array(*banded)).alias("band", "key")))
    where = reps.select("node", F.col("head.doc_id").alias("d"), F.col("head.hash").alias("h"))
    own = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("__text"))
    # The rows of one (doc_id, hash) hold one text.
    texts = own.join(where, ["d", "h"]).select("node", "__text").dropDuplicates(["node"])
    edges = stored(forests(reps.select("node", "size", *sketch), keys, cell_rows, similarity), "edges")
    tested = edges.groupBy("u").agg(F.min(F.struct("bits", "v")).alias("m")).select("u", F.col("m.v").alias("v"))
    tested = stored(tested, "tested")
    good = alike(tested, texts, shingle, similarity)
    roots = stored(components(good), "roots")

    def labelled(df: DataFrame, node: str, label: str) -> DataFrame:
        return df.join(roots.toDF(node, "__root"), node, "left").withColumn(label, F.coalesce("__root", node)).drop("__root")

    # Cells whose forest still joins two classes; one of two rows is done if its only pair has been tested.
    apart = labelled(labelled(edges, "u", "lu"), "v", "lv").filter("lu <> lv")
    apart = apart.join(tested.withColumn("done", F.lit(True)), ["u", "v"], "left").filter("done IS NULL OR n > 2")
    torn = stored(apart.select("band", "key").distinct(), "torn")
    asked = keys.join(torn, ["band", "key"], "left_semi").select("node").distinct()
    sets = stored(hashed_sets(texts.join(asked, "node", "left_semi"), shingle), "sets")
    nodes = labelled(sets.join(reps.select("node", *banded), "node"), "node", "label")
    more = stored(links_inside(torn, nodes, keys, cell_rows, similarity), "links-inside")
    discard(sets)
    roots = stored(components(good.union(more)), "roots")
    classes = labelled(reps.select("node", "head"), "node", "label")
    classes = stored(classes.join(classes.groupBy("label").agg(F.min("head").alias("first")), "label").select("node", "first"), "classes")
    for done in (edges, tested, good, more, torn, roots, joined, reps):
        discard(done)
    head = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash"))
    return sigs.select("doc_id", "hash", "node").distinct().join(classes, "node").select("doc_id", "hash", F.col("first.doc_id").alias("component_id"), head.alias("head"))
