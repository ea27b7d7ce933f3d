"""Packing token sequences into bins of 1024 by linear grouping and best fit.

A document is its ids and the end id 2. A longer one is cut into pieces of 1024
tokens, of which the first may be shorter. Every full piece is a sequence of its own.
The others are packed:

1. Lengths above ``SMALL``, in descending order, are cut into groups of equal cardinality, and each length counts as its
   group's largest. There are at most 256 groups; each number in ``GROUPS`` is tried.
2. The few sizes are packed by a cutting-stock linear programme: configurations are generated by a knapsack over the dual
   prices, and the optimum is rounded.
3. The actual documents take the places of their group, configurations with most sequences first. The last place of a
   configuration goes to the longest document that has room there, which takes back what rounding up has cost. What is left over is
   grouped and solved again.
4. What then is left and all small lengths go, longest first, to the open sequence with the least sufficient room; a new sequence
   opens when none has room.
5. The worst filled sequences, a half of all down to a sixteenth, are emptied and solved again; a better plan for them replaces theirs.

The driver sees one histogram: how many pieces have each length, at most 1024 rows. A plan is a list of patterns, the lengths in a
sequence and how many sequences are filled so; it doesn't grow with the number of pieces. As a table of ranges it says that pieces number r
to r + q of length L go to sequences number s to s + q. Pieces are numbered within their length by a range partition, so no length
meets in one task, and look their range up in that table.

Defined results: a null text counts as empty, a document of the end id alone; a very long
text is cut like any other, and its ids are held as one array; rows that repeat a doc_id
are packed each; an empty table gives an empty result; other columns of any name are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, number_in_class, slices, small_batches
from .tokens import VOCABULARY, id_arrays

CAPACITY = 1024
END = 2
SMALL = 256
#: Numbers of groups to try, times that left over pieces are grouped again, and shares of the sequences that are solved again.
GROUPS, AGAIN, WORST = (128, 192, 256), 3, (1 / 2, 1 / 4, 1 / 8, 1 / 16)
#: Most entries into the basis of the linear programme for each size.
ROUNDS = 40

Step = tuple[int, int, int, int]  # length, first piece, how many, first sequence
Pattern = tuple[tuple[tuple[int, int], ...], int]  # (length, times) of a sequence, how many sequences


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row of ``docs`` (doc_id, text)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            rows: list[tuple] = []
            for doc_id, found in zip(b.column("doc_id").to_pylist(), id_arrays([t or "" for t in b.column("text").to_pylist()], vocabulary)):
                ids = np.append(found, np.array([END], "<u4"))
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        split, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class Knapsack:
    """The most valuable multiset of sizes (descending) that fits, for many prices.

    At most ``depth`` = capacity // smallest size items fit. Level j holds the best values of up to j items for those
    capacities that leave room for the items of later levels; the last level needs the whole capacity alone.
    """

    def __init__(self, sizes: list[int], capacity: int):
        self.s, self.capacity, least = np.array(sizes), capacity, min(sizes)
        self.depth = capacity // least
        self.levels = []
        for j in range(2, self.depth):
            room = np.arange(2 * least, capacity - (self.depth - j) * least + 1)
            first = int(np.searchsorted(-self.s, -(room[-1] - least)))  # larger sizes leave no room for another
            rest = room[:, None] - self.s[None, first:]
            self.levels.append((room, first, np.maximum(rest, 0), np.where(rest < 0, -np.inf, 0.0)))
        self.reach = len(sizes) - np.searchsorted(self.s[::-1], np.arange(capacity + 1), "right")  # the first that fits

    def best(self, price: np.ndarray) -> tuple[float, list[int]]:
        """(value, how many of each size)."""
        tail = np.maximum.accumulate(price[::-1])[::-1]  # the best price from a size on
        is_best = np.where(price >= tail, np.arange(len(price)), len(price))
        item = np.minimum.accumulate(is_best[::-1])[::-1]
        some = self.reach < len(price)
        at = np.minimum(self.reach, len(price) - 1)
        one = np.where(some & (tail[at] > 0), tail[at], 0.0)
        picks = [(0, np.where(one > 0, item[at], -1))]
        value = one
        for room, first, rest, short in self.levels:
            gain = value[rest] + price[None, first:]
            gain += short
            pick = gain.argmax(1)
            top = gain[np.arange(len(room)), pick]
            better = top > one[room]
            value = one.copy()
            value[room] = np.where(better, top, one[room])
            picks.append((int(room[0]), np.where(better, pick + first, picks[0][1][room])))
        column, c, total = [0] * len(self.s), self.capacity, float(one[-1])
        if self.depth > 1:
            last = np.where(self.s <= c, price + value[np.maximum(c - self.s, 0)], -1.0)
            i = int(last.argmax())
            if last[i] > total:
                total, c = float(last[i]), c - int(self.s[i])
                column[i] += 1
            else:
                picks = picks[:1]
        for least, pick in reversed(picks):
            if least <= c < least + len(pick):
                if pick[c - least] >= 0:
                    i = int(pick[c - least])
                    column[i] += 1
                    c -= int(self.s[i])
        return total, column


def configurations(sizes: list[int], demand: list[int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(how many of each size, how many bins): the linear optimum of the cutting-stock problem, rounded.

    Column generation: a basis of as many configurations as sizes; the knapsack over
    the dual prices finds a configuration to enter until none gains. Two entries a size
    were enough in all measurements; more than ``ROUNDS`` are an error.
    """
    m = len(sizes)
    if not m:
        return []
    d = np.array(demand, float)
    knapsack = Knapsack(sizes, capacity)
    basis = [[capacity // sizes[i] if i == j else 0 for i in range(m)] for j in range(m)]
    inverse = np.diag([1 / (capacity // x) for x in sizes])
    for _ in range(ROUNDS * m):
        gain, column = knapsack.best(inverse.sum(0))
        if gain <= 1 + 1e-7:
            break
        x = np.maximum(inverse @ d, 0)
        u = inverse @ np.array(column, float)
        ratio = np.divide(x, u, out=np.full(m, np.inf), where=u > 1e-9)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        row = inverse[r] / u[r]
        some = np.flatnonzero(u)
        inverse[some] -= u[some, None] * row
        inverse[r] = row
        basis[r] = column
    else:
        raise ArithmeticError(f"the linear programme of {m} sizes didn't end after {ROUNDS * m} entries")
    # rounded down, then up where the demand still allows a whole configuration, the largest fractions first
    left, out = list(demand), [0] * m
    exact = np.maximum(inverse @ d, 0)
    whole = np.floor(exact + 1e-6)
    for up, i in [*((0, i) for i in range(m)), *((1, i) for i in np.argsort(whole - exact, kind="stable").tolist())]:
        own = [(g, a) for g, a in enumerate(basis[i]) if a]
        n = min([1 if up else int(whole[i]), *(left[g] // a for g, a in own)])
        if n:
            out[i] += n
            for g, a in own:
                left[g] -= n * a
    return [(column, n) for column, n in zip(basis, out) if n]


def group_sizes(counts: dict[int, int], small: int, groups: int) -> dict[int, int]:
    """{largest length of a group: pieces} of the lengths above ``small``; neighbouring groups of the same largest length count as one."""
    order = sorted((x for x in counts if x > small), reverse=True)
    last = np.cumsum([counts[x] for x in order])
    total = int(last[-1]) if order else 0
    bounds = sorted({round(total * g / groups) for g in range(groups + 1)})
    out: dict[int, int] = {}
    for a, b in zip(bounds, bounds[1:]):
        x = order[int(np.searchsorted(last, a, "right"))]
        out[x] = out.get(x, 0) + b - a
    return out


def place_groups(counts: dict[int, int], capacity: int, small: int, groups: int) -> list[Pattern]:
    """Steps 1 to 3 once: patterns; their pieces are taken from ``counts``."""
    sizes = group_sizes(counts, small, groups)
    names = sorted(sizes, reverse=True)
    lengths = sorted(x for x in counts if x > small)
    out: list[Pattern] = []
    for column, n in sorted(configurations(names, [sizes[x] for x in names], capacity), key=lambda c: -c[1]):
        places = [names[g] for g, a in enumerate(column) for _ in range(a)]
        while n:
            room, used = capacity, {}
            for size in places[:-1] + [capacity]:
                i = bisect_right(lengths, min(size, room)) - 1
                while i >= 0 and counts[lengths[i]] <= used.get(lengths[i], 0):
                    i -= 1
                if i >= 0:
                    used[lengths[i]] = used.get(lengths[i], 0) + 1
                    room -= lengths[i]
            if not used:
                break
            q = min([n, *(counts[x] // k for x, k in used.items())])
            n -= q
            out.append((tuple(used.items()), q))
            _take(counts, out[-1:])
            lengths = [x for x in lengths if x in counts] if any(x not in counts for x in used) else lengths
    return out


def _take(counts: dict[int, int], patterns: list[Pattern]) -> None:
    for own, q in patterns:
        for x, k in own:
            counts[x] -= k * q
            if not counts[x]:
                del counts[x]


def load(pattern: Pattern) -> int:
    return sum(x * k for x, k in pattern[0])


def fill(patterns: list[Pattern], counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Step 4: ``patterns`` with the pieces of ``counts`` added by best fit, and more patterns of them alone."""
    open_: dict[int, list[Pattern]] = {}
    places: list[int] = []

    def put(pattern: Pattern) -> None:
        r = capacity - load(pattern)
        if r not in open_:
            insort(places, r)
            open_[r] = []
        open_[r].append(pattern)

    for p in patterns:
        put(p)
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            i = bisect_left(places, x)
            r = places[i] if i < len(places) else capacity
            layers = min(r // x, n)  # a sequence stays the best fit until it can't hold another
            own, there = open_[r].pop() if i < len(places) else ((), n)
            q = min(there, max(1, n // (r // x)))
            if i < len(places):
                if q < there:
                    open_[r].append((own, there - q))
                if not open_[r]:
                    del open_[r]
                    places.pop(i)
            put(((*own, (x, layers)), q))
            n -= q * layers
    return [p for r in sorted(open_) for p in open_[r]]


def total(patterns: list[Pattern]) -> int:
    return sum(q for _, q in patterns)


def solve(counts: dict[int, int], capacity: int, small: int, groups: int) -> list[Pattern]:
    """Steps 1 to 4."""
    left, out = dict(counts), []
    for _ in range(AGAIN):
        more = place_groups(left, capacity, small, groups)
        out += more
        if not more:
            break
    return fill(out, left, capacity)


def emptied(patterns: list[Pattern], share: float) -> tuple[list[Pattern], dict[int, int], int]:
    """(the better filled patterns, {length: pieces} of the others, how many sequences those are)."""
    n = want = max(1, round(total(patterns) * share))
    kept, counts = [], {}
    for own, q in sorted(patterns, key=load):
        k = min(q, n)
        n -= k
        for x, times in own if k else ():
            counts[x] = counts.get(x, 0) + times * k
        if q > k:
            kept.append((own, q - k))
    return kept, counts, want


def patterns(counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: tuple[int, ...] = GROUPS) -> list[Pattern]:
    """All five steps; ends early where no plan could need fewer sequences."""
    bound = -(-sum(x * n for x, n in counts.items()) // capacity)
    plans = []
    for g in groups:
        best = solve(counts, capacity, small, g)
        for share in WORST:
            if total(best) > bound:
                kept, again, n = emptied(best, share)
                best = min(best, *(kept + solve(again, capacity, small, h) for h in groups), key=total)
        plans.append(best)
    return min(plans, key=total)


def plan(counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: tuple[int, ...] = GROUPS) -> tuple[list[Step], int]:
    """(steps, sequences used)."""
    steps: list[Step] = []
    done, used = dict.fromkeys(counts, 0), 0
    for own, q in patterns(counts, capacity, small, groups):
        for x, times in own:
            for _ in range(times):
                steps.append((x, done[x], q, used))
                done[x] += q
        used += q
    return steps, used


def _look_up(df: DataFrame, steps: list[Step], total: int, capacity: int) -> DataFrame:
    """``df`` (length, rank, ...) with sequence_id: as the plan says, and after its ``total`` sequences the full pieces."""
    steps = sorted(steps)
    keys = np.array([(x << 40) + lo for x, lo, *_ in steps] or [0], np.int64)
    firsts = np.array([s[3] for s in steps] or [0], np.int64)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            key = (length << 40) + rank
            at = np.maximum(np.searchsorted(keys, key, "right") - 1, 0)
            yield b.append_column("sequence_id", pa.array(np.where(length == capacity, total + rank, firsts[at] + key - keys[at])))

    return df.mapInArrow(find, df.select("*", F.lit(None).cast("long").alias("sequence_id")).schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs`` (doc_id, text)."""
    scratch = Scratch()
    with small_batches(docs.sparkSession):
        pieces = scratch.save(token_pieces(docs, capacity, vocabulary), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts.pop(capacity, None)  # a full piece is a sequence of its own
    steps, total = plan(counts, capacity)
    numbered = number_in_class(pieces, "length", ["doc_id", "piece"])
    scratch.drop()
    before = (
        Window.partitionBy("sequence_id")
        .orderBy(F.col("length").desc(), "doc_id", "piece", "ids_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )  # a sequence has at most ``capacity`` pieces
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return _look_up(numbered, steps, total, capacity).withColumn("offset", offset).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
