"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the longest sequence are cut into pieces; whole pieces of that length fill a
sequence of their own. Packing looks at piece lengths only, so it runs on their histogram: at most one
number for each length, however many documents there are. Lengths go in descending order; a piece goes
to the open bin with the least room that holds it, of several to the fullest. If none does, bins are opened: all permitted lengths are weighed
together, each by what a bin of it would cost a word once filled, largest first, with the pieces still to be packed,
and shrunk to its contents; the cheapest is opened, as often as those pieces last, and counts on them from then on. In the end each bin shrinks to the
smallest permitted length that holds its contents. Opening always at one length, where it holds the piece, is tried
for each length too, and the cheapest outcome taken, so that weighing them jointly never costs more than any one.

Bins that look alike are one group with a count, so a plan has at most a few entries for each length.
Pieces then find their bins by their place among the pieces of their length, which is a place in a hash
bucket plus the sizes of the buckets before: no task holds all pieces of a length.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloft.llm.common import stored
from tallyloft.llm.mixing import placed

LENGTHS = (512, 1024, 2048)


def cost(length: int, fixed: int = 16) -> float:
    """What a sequence costs: its length and a little for being a sequence."""
    return length + fixed


def plan(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS, price: Callable[[int], float] = cost) -> tuple[list[tuple], list[tuple]]:
    """Entries (length, first, end, bin, each, offset) and bins (first, end, used, capacity), the cheapest of the joint plan and those of one preferred length.

    Pieces first..end-1 of a length go to bins from ``bin`` on, ``each`` to a bin, from ``offset`` inside it.
    """
    tried = [best_fit(histogram, lengths, None, price)] + [best_fit(histogram, lengths, prefer, price) for prefer in sorted(lengths)]
    return min(tried, key=lambda t: total_cost(t[1], price))


def total_cost(bins: list[tuple], price: Callable[[int], float] = cost) -> float:
    return sum((end - first) * price(capacity) for first, end, _, capacity in bins)


def best_fit(histogram: dict[int, int], lengths: tuple[int, ...], prefer: int | None, price: Callable[[int], float]):
    """A plan by best fit; with ``prefer``, bins are opened at that length where it holds the piece."""
    order = sorted(histogram)
    rest = dict(histogram)  # pieces still to be packed that no open bin counts on

    def filled(capacity: int, length: int) -> tuple[float, int, list[tuple[int, int]]]:
        """Cost a word of a bin opened for ``length`` and filled largest first, how many such bins the pieces last for, and a bin's pieces."""
        held, room, k = [], capacity, bisect.bisect_right(order, length)
        while k:
            k = bisect.bisect_right(order, room, 0, k) - 1
            if k >= 0 and (many := min(room // order[k], rest[order[k]])) > 0:
                held.append((order[k], many))
                room -= many * order[k]
            k = max(k, 0)
        return price(min(c for c in lengths if c >= capacity - room)) / (capacity - room), min(rest[x] // n for x, n in held), held

    entries: list[tuple] = []
    room: dict[int, list[tuple[int, int, int]]] = {}  # heaps of groups (-used, first bin, end) by the room they have left
    rooms: list[int] = []
    closed: list[tuple[int, int, int]] = []
    opened = 0

    def put(left: int, first: int, end: int, used: int) -> None:
        if left <= 0:
            closed.append((first, end, used))
            return
        if left not in room:
            room[left] = []
            bisect.insort(rooms, left)
        heapq.heappush(room[left], (-used, first, end))

    for length in reversed(order):
        at, left = 0, histogram[length]
        while left:
            rest[length] = left
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                free = rooms[k]
                used, first, end = heapq.heappop(room[free])
                used = -used
                if not room[free]:
                    del room[free]
                    rooms.pop(k)
            else:
                fits, times = [c for c in lengths if c >= length], left
                if prefer in fits:
                    free = prefer
                else:
                    (_, times, held), free = min(((filled(c, length), c) for c in fits), key=lambda x: (x[0][0], x[1]))
                    times = min(times, -(-left // (free // length)))
                    for x, n in held:
                        rest[x] -= n * times
                first, used = opened, 0
                end = first + min(times, -(-left // (free // length)))
                opened = end
            each = free // length
            full = min(end - first, left // each)
            if full:
                entries.append((length, at, at + full * each, first, each, used))
                put(free - each * length, first, first + full, used + each * length)
                at, left, first = at + full * each, left - full * each, first + full
            if left and first < end:
                entries.append((length, at, at + left, first, left, used))
                put(free - left * length, first, first + 1, used + left * length)
                at, left, first = at + left, 0, first + 1
            if first < end:
                put(free, first, end, used)
        rest[length] = 0
    bins = closed + [(first, end, -used) for groups in room.values() for used, first, end in groups]
    return entries, sorted((a, b, used, min(c for c in lengths if c >= used)) for a, b, used in bins)


def words(text: str = "text") -> Column:
    """The length of a text in words, runs of anything but white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0))


def pieces(docs: DataFrame, size: Column, longest: int) -> DataFrame:
    """doc_id, copy, start and length of each piece. Rows without length have none; copies of a doc_id are numbered by their hash."""
    rows = docs.select("doc_id", size.cast("long").alias("size")).filter("size > 0")
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / longest).cast("long")))
    return rows.withColumn("piece", cut).select("doc_id", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest), F.col("size") - F.col("piece") * longest).cast("long").alias("length"))


def pack(docs: DataFrame, size: Column | None = None, lengths: tuple[int, ...] = LENGTHS, price: Callable[[int], float] = cost) -> DataFrame:
    """Every piece with its place: doc_id, start, length, bin, offset, capacity (of the bin), used (of it).

    ``size``: the length of a document, by default its words. Null, empty and zero-length documents have no
    piece. Repeated rows are packed each; a null doc_id is packed as such. An empty table gives no piece.
    Other columns are not read.
    """
    spark = docs.sparkSession
    longest = max(lengths)
    cut = stored(pieces(docs, words() if size is None else size, longest), "pieces")
    # At most one row for each length up to the longest.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    entries, bins = plan(histogram, lengths, price)
    kind = "length long, first long, end long, bin0 long, each long, offset0 long"
    table = spark.createDataFrame(pd.DataFrame(entries, columns=["length", "first", "end", "bin0", "each", "offset0"]), kind) if entries else spark.createDataFrame([], kind)
    kind = "bin1 long, end1 long, used long, capacity long"
    groups = spark.createDataFrame(pd.DataFrame(bins, columns=["bin1", "end1", "used", "capacity"]), kind) if bins else spark.createDataFrame([], kind)
    counted = spark.createDataFrame(list(histogram.items()), "__g long, __rows long")
    ranked = placed(cut, "length", F.lit(1), (F.col("doc_id"), F.col("start")), counted)
    # A few entries for each length, as the plan's docstring says.
    hit = ranked.join(F.broadcast(table.withColumnRenamed("length", "l")), (F.col("length") == F.col("l")) & (F.col("__start") >= F.col("first")) & (F.col("__start") < F.col("end")))
    nth = F.col("__start") - F.col("first")
    hit = hit.select("doc_id", "start", "length", (F.col("bin0") + F.floor(nth / F.col("each"))).cast("long").alias("bin"), (F.col("offset0") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset"))
    # Groups are runs of bins: the one a bin belongs to is found by halving the array of their first bins.
    firsts = [b[0] for b in bins]
    if not firsts:
        return hit.select("*", F.lit(None).cast("long").alias("capacity"), F.lit(None).cast("long").alias("used"))
    steps = [1 << i for i in reversed(range(len(firsts).bit_length()))]
    held = "array(" + ", ".join(f"{b}L" for b in firsts) + ")"
    which = F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (at, s) -> if(at + s <= {len(firsts)} AND get({held}, at + s - 1) <= bin, at + s, at))")
    first = F.expr(f"get({held}, __which - 1)")
    hit = hit.withColumn("__which", which).withColumn("bin1", first).drop("__which")
    return hit.join(F.broadcast(groups), "bin1").select("doc_id", "start", "length", "bin", "offset", "capacity", "used")


def sequences(packed: DataFrame) -> DataFrame:
    """A row for each bin: bin, capacity, used, and its pieces by offset (doc_ids, starts, lengths); at most ``capacity`` pieces."""
    piece = F.struct("offset", "doc_id", "start", "length")
    rows = packed.groupBy("bin", "capacity", "used").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return rows.select("bin", "capacity", "used", F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.length").alias("lengths"))
