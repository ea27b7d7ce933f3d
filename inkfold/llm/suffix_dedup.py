"""Removing repeated passages by longest-previous-factor arrays.

Every byte that is covered by a string of ``LEAST`` bytes which also starts in a document with a smaller doc_id is
removed; matches never cross documents, overlaps count, and strings are judged on the input. So of a repeated passage the
copy in the document with the smallest doc_id stays.

Method. A suffix array of all positions would be fifty times the text, so suffixes meet where they can match at all:

1. Every window of ``LEAST`` bytes names one anchor, the leftmost of its 27 strings of ``GRAM`` bytes with the smallest
   hash. Equal windows have equal anchors at equal places, and an anchor serves a run of windows.
2. Anchors are counted by slot (38 to 52 bits of their hash). Counts travel as sorted arrays by bucket, four bytes an anchor,
   combined on the map side. Only anchors whose slot several documents have are looked at again.
3. An anchor's neighbourhood is all that its windows can see, 76 bytes at most. Where a smaller doc_id has the same one,
   all its windows are repeated. Slots with more than ``HOT`` of all anchors (at most 1 / ``HOT``) are settled by an aggregate and a
   join, which Spark can split; all others by windows over their slot.
4. Slots with several different neighbourhoods (where passages begin, end or change) give the bytes of the first document
   of each. The suffixes at their windows are sorted, adjacent ones compared, and the nearest suffixes before and after of
   a smaller doc_id give the longest previous factor; where it reaches ``LEAST`` the window is repeated.
5. Removed runs of a document are joined and cut out of its text. Texts are shuffled only for that, and only where
   something goes.

Whole texts that are equal are folded first, so groups of copies cost one text. Neighbourhoods are told apart by 64 bits
within a slot, texts by sha256.

Defined results: a null text is empty; texts of fewer than ``LEAST`` bytes keep all; a null doc_id has no order: nothing is
removed from its rows and they remove nothing; rows that repeat a doc_id don't remove each other's bytes, and each is judged by
its own text; very long texts are scanned in overlapping parts, whole; an empty table gives an empty result; other columns of
any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import runs
from .common import Scratch, mark_probable, save, slices, small_batches

LEAST = 50
GRAM = 24
#: Strings of ``GRAM`` bytes in a window, and bytes before an anchor that its windows can see.
SPAN = LEAST - GRAM + 1
#: Share of all anchors above which a slot is settled by an aggregate and a join.
HOT = 1e-5
#: Bytes that are scanned at a time, anchors that a task counts at a time, and mean anchors of a bucket.
PART, COUNTED, BUCKET = 1 << 17, 1 << 20, 1 << 18
#: Windows that are sorted at a time.
SORTED = 1 << 18

_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(50).integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


_ROOM = 2 * PART + 256
_UP, _DOWN = _powers(_MULTIPLIER, _ROOM), _powers(pow(_MULTIPLIER, -1, 1 << 64), _ROOM)
#: The upper bits of a product with it depend on all bits; only upper bits of a gram's hash are used.
_SPREAD, _PLACES = _DOWN * np.uint64(0xD6E8FEB86659FD93), np.arange(_ROOM, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    k = 1
    while 2 * k <= n:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def _parts(text: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(first byte, end, first own window, end) of overlapping parts: all that the anchors of a part's own windows see is in it."""
    n = len(text) - LEAST + 1
    for a in range(0, n, PART):
        b = min(n, a + PART)
        yield max(0, a - SPAN), min(len(text), b + SPAN + LEAST), a, b


class Part:
    """Neighbouring bytes of several texts and the anchors of their windows, as arrays over anchors.

    ``row``: whose text; ``low`` and ``high``: its first and last window, as places in the text; ``gram`` and ``hood``: hashes of the
    anchor and its neighbourhood. ``at``: the first window in ``data``.
    """

    def __init__(self, pieces: list[tuple[int, bytes, int, int, int]]):
        start = np.cumsum([0, *(len(p[1]) for p in pieces)])
        self.data = data = np.frombuffer(b"".join(p[1] for p in pieces), np.uint8)
        n = len(data)
        whole = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * _UP[:n], out=whole[1:])
        gram = whole[GRAM:] - whole[:-GRAM]
        gram *= _SPREAD[: len(gram)]
        best = gram & ~_PLACE
        best |= _PLACES[: len(gram)]
        best = _sliding_min(best, SPAN)
        base = np.array([p[2] for p in pieces])
        own = np.zeros(len(best) + 1, np.int8)
        first = start[:-1] + np.array([p[3] for p in pieces]) - base
        np.add.at(own, first, 1)
        np.add.at(own, np.minimum(first + np.array([p[4] - p[3] for p in pieces]), len(best)), -1)
        window = np.flatnonzero(np.cumsum(own[:-1]))
        anchor = (best[window] & _PLACE).astype(np.int64)
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)))
        at, to, anchor = window[new], window[np.append(new[1:], True)], anchor[new]
        piece = np.searchsorted(start, at, "right") - 1
        left, right = np.maximum(anchor - SPAN + 1, start[piece]), np.minimum(anchor + LEAST, start[piece + 1])
        sides = ((anchor - left) << 8 | (right - anchor)).astype(np.uint64)
        hood = _mix((whole[right] - whole[left]) * _DOWN[left] + sides * np.uint64(_MULTIPLIER))
        gram = gram[anchor]
        # anchors that follow each other and are alike, as in a run of one character, count as one
        new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (hood[1:] != hood[:-1]) | (piece[1:] != piece[:-1]) | (at[1:] != to[:-1] + 1)))
        keep = np.flatnonzero(new)
        self.at, to, piece = at[keep], to[np.append(keep[1:], len(at)) - 1], piece[keep]
        self.gram, self.hood = gram[keep], hood[keep]
        self.row = np.array([p[0] for p in pieces])[piece]
        self.low = self.at - start[piece] + base[piece]
        self.high = self.low + to - self.at

    def windows(self) -> tuple[pa.Array, np.ndarray]:
        """(the bytes from each anchor's first window on, the anchors in their order).

        As many bytes as the longest neighbourhood has, copied as rows of one width; anchors of longer runs come last, with all of theirs.
        """
        width, size = SPAN + LEAST - 1, self.high - self.low + LEAST
        short, long_ = np.flatnonzero(size <= width), np.flatnonzero(size > width)
        padded = np.concatenate((self.data, np.zeros(width, np.uint8)))
        rows = np.lib.stride_tricks.sliding_window_view(padded, width)[self.at[short]]
        more = [self.data[a : a + n] for a, n in zip(self.at[long_], size[long_])]
        ends = np.cumsum(np.concatenate(([0], np.full(len(short), width), size[long_])))
        data = np.concatenate((rows.ravel(), *more))
        found = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        return found, np.concatenate((short, long_))


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Part]]:
    """The anchors of the texts of each batch (text binary), in parts of about ``PART`` bytes."""
    for b in slices(batches):
        held, size = [], 0
        for row, text in enumerate(b.column("text")):
            text = text.as_py()
            for low, end, a, e in _parts(text):
                held.append((row, text[low:end], low, a, e))
                size += end - low
                if size >= PART:
                    yield b, Part(held)
                    held, size = [], 0
        if held:
            yield b, Part(held)


def _slot_bits(n_bytes: int) -> int:
    """Bits of a bucket's name: buckets of about ``BUCKET`` anchors, 2^6 to 2^20 of them."""
    return min(20, max(6, (2 * n_bytes // (SPAN + 1) // BUCKET).bit_length()))


def _slots(gram: np.ndarray, bits: int) -> np.ndarray:
    return gram >> np.uint64(32 - bits)


def shared_slots(texts: DataFrame, bits: int, at_once: int = COUNTED) -> DataFrame:
    """slot, n of the slots that several documents of ``texts`` (text binary) have; a few others share one by chance."""

    def pack(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        slot, n = np.unique(np.concatenate(held), return_counts=True)
        cut = np.searchsorted(slot, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
        low = slot.astype(np.uint32)
        rows = []
        for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            own, many = low[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]]
            some = many > 1
            rows.append((k, own[~some].tobytes(), own[some].tobytes(), many[some].astype(np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "once", "many", "times"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, part in scan(batches):
            slot = _slots(part.gram, bits)
            # a document counts once
            _, one = np.unique(slot * np.uint64(_MULTIPLIER) + part.row.astype(np.uint64), return_index=True)
            held.append(slot[one])
            size += len(one)
            if size >= at_once:
                yield from pack(held)
                held, size = [], 0
        if held:
            yield from pack(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["bucket"]):
            once, many, times = (b"".join(t.column(c).to_pylist()) for c in ("once", "many", "times"))
            low = np.frombuffer(once + many, np.uint32)
            weight = np.concatenate((np.ones(len(once) // 4, np.int64), np.frombuffer(times, np.int64)))
            order = np.argsort(low, kind="stable")
            low, weight = low[order], weight[order]
            new = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            n = np.add.reduceat(weight, new)
            slot = (t.column("bucket")[0].as_py() << 32) + low[new].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot[n > 1]), pa.array(n[n > 1])], ["slot", "n"])

    packed = texts.mapInArrow(count, "bucket long, once binary, many binary, times binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "slot long, n long")


def anchors(texts: DataFrame, bits: int, windows: bool = False) -> DataFrame:
    """doc_id, key, slot, hood, low, high, and if asked the bytes from the first window on, of every anchor of ``texts`` (doc_id, key, text binary)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, part in scan(batches):
            data, order = part.windows() if windows else (None, slice(None))
            row = pa.array(part.row[order])
            cols = [b.column("doc_id").take(row), b.column("key").take(row)]
            cols += [pa.array(x[order]) for x in (_slots(part.gram, bits).astype(np.int64), part.hood.view(np.int64), part.low, part.high)]
            names = ["doc_id", "key", "slot", "hood", "low", "high"]
            yield pa.RecordBatch.from_arrays([*cols, data] if windows else cols, [*names, "bytes"] if windows else names)

    schema = "doc_id long, key long, slot long, hood long, low long, high long" + ", bytes binary" * windows
    return texts.mapInArrow(find, schema)


def smaller_before(doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller ``doc``, but none before ``first``; -1 if there is none.

    All places between a place and its pointer have no smaller one, so a pointer that isn't smaller goes on to where its own points.
    """
    p = np.arange(len(doc)) - 1
    p[p < first] = -1
    while True:
        bad = np.flatnonzero(p >= 0)
        bad = bad[doc[p[bad]] >= doc[bad]]
        if not len(bad):
            return p
        p[bad] = p[p[bad]]


def longest_previous(windows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor reaches the whole window: ``windows`` are suffixes cut to ``LEAST`` bytes.

    In suffix order, the suffixes next before and after with a smaller doc are looked up; a common prefix of all between is one of the two.
    """
    order = np.argsort(windows, kind="stable")
    own, d = windows[order], doc[order]
    n = np.arange(len(d))
    new = np.concatenate(([True], own[1:] != own[:-1]))  # the common prefix with the suffix before is shorter
    first = np.maximum.accumulate(np.where(new, n, 0))
    last = np.append(np.flatnonzero(new)[1:], len(d))[np.cumsum(new) - 1] - 1
    before = smaller_before(d, first)
    after = smaller_before(d[::-1], (len(d) - 1 - last)[::-1])[::-1]
    out = np.empty(len(d), bool)
    out[order] = (before >= 0) | (after >= 0)
    return out


def _windows(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the text, bytes) of every window of ``t`` (low, high, bytes)."""
    low, high = t.column("low").to_numpy(), t.column("high").to_numpy()
    n = high - low + 1
    found = t.column("bytes").to_pylist()
    data = np.frombuffer(b"".join(found), np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    size = np.array([len(x) for x in found])
    text = np.cumsum(size) - size
    found = np.lib.stride_tricks.sliding_window_view(data, LEAST)[text[row] + nth]
    return row, low[row] + nth, np.ascontiguousarray(found).view(f"S{LEAST}").ravel()  # of one length, so zero bytes at an end count


def repeated_windows(rows: DataFrame, at_once: int = SORTED) -> DataFrame:
    """doc_id, key, start, stop of the windows of ``rows`` (doc_id, key, slot, low, high, bytes) that a smaller doc_id also has.

    Rows of a slot arrive together by rising doc_id, and about ``at_once`` windows are settled at a time: those of whole slots, or a stretch
    of one slot that goes on. Of that its different windows are carried, as of each the first has the smallest doc_id.
    """

    def settle(own: pa.Table, carried: tuple[np.ndarray, np.ndarray] | None):
        row, place, windows = _windows(own)
        doc = own.column("doc_id").to_numpy()[row]
        old = 0
        if carried:
            old = len(carried[1])
            windows, doc = np.concatenate((carried[0], windows)), np.concatenate((carried[1], doc))
        hit = longest_previous(windows, doc)
        found = np.flatnonzero(hit[old:])
        start = place[found]
        r = row[found]
        new = np.concatenate(([True], (r[1:] != r[:-1]) | (start[1:] != start[:-1] + 1))) if len(r) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        stop = start[np.append(at[1:], len(r)) - 1] + LEAST if len(r) else start
        take = pa.array(r[at])
        batch = pa.RecordBatch.from_arrays(
            [own.column("doc_id").combine_chunks().take(take), own.column("key").combine_chunks().take(take), pa.array(start[at]), pa.array(stop)],
            ["doc_id", "key", "start", "stop"],
        )
        return batch, (windows[~hit], doc[~hit])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, carried, whose = 0, None, None
        for b in slices(batches, max(1, at_once // SPAN)):
            held.append(pa.Table.from_batches([b]))
            size += int(pc.sum(pc.subtract(b.column("high"), b.column("low"))).as_py() or 0) + b.num_rows
            if size < at_once:
                continue
            t = pa.concat_tables(held)
            slot = t.column("slot").to_numpy()
            cut = int(np.flatnonzero(slot != slot[-1])[-1]) + 1 if slot[0] != slot[-1] else t.num_rows
            out, rest = settle(t.slice(0, cut), carried if whose == slot[0] else None)
            yield out
            carried, whose = (rest, slot[0]) if cut == t.num_rows else (None, None)
            held = [t.slice(cut)] if cut < t.num_rows else []
            size = int((held[0].column("high").to_numpy() - held[0].column("low").to_numpy() + 1).sum()) if held else 0
        if held:
            yield settle(pa.concat_tables(held), carried if whose == held[0].column("slot")[0].as_py() else None)[0]

    return (
        rows.repartition("slot").sortWithinPartitions("slot", "doc_id").mapInArrow(find, "doc_id long, key long, start long, stop long")
    )


def _first_documents(found: DataFrame, slots: DataFrame, n_anchors: float) -> DataFrame:
    """``found`` (doc_id, slot, hood, ...) with ``first``, the smallest doc_id of its neighbourhood, and ``one``, whether its slot has no other."""
    hot = F.broadcast(slots.where(F.col("n") > n_anchors * HOT).select("slot"))  # at most 1 / HOT rows
    rest = found.join(hot, "slot", "left_anti").repartition("slot")
    by_slot = Window.partitionBy("slot")
    rest = rest.withColumn("first", F.min("doc_id").over(Window.partitionBy("slot", "hood"))).withColumn(
        "one", F.min("hood").over(by_slot) == F.max("hood").over(by_slot)
    )
    hot = found.join(hot, "slot", "left_semi")
    hoods = hot.groupBy("slot", "hood").agg(F.min("doc_id").alias("first"))
    some = hoods.groupBy("slot").agg((F.min("hood") == F.max("hood")).alias("one"))
    return rest.unionByName(hot.join(hoods.join(some, "slot"), ["slot", "hood"]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of texts (binary) without their spans."""
    for b in slices(batches):
        rows = []
        for doc_id, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("spans").to_pylist()):
            text = text.as_py()
            kept, end, n = hashlib.sha256(), 0, 0
            for s in sorted(spans, key=lambda x: x["start"]):
                if s["start"] > end or not n:
                    kept.update(text[end : s["start"]])
                    n += 1
                end = max(end, s["stop"])
            kept.update(text[end:])
            rows.append((doc_id, len(text), _covered(spans), n, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _covered(spans: list[dict]) -> int:
    total, end = 0, 0
    for s in sorted(spans, key=lambda x: x["start"]):
        total += max(0, s["stop"] - max(end, s["start"]))
        end = max(end, s["stop"])
    return total


def repeated_spans(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(one row for each of ``docs`` (doc_id, text), the spans to remove from those that aren't copies).

    Rows: doc_id, key, digest, n_bytes, copy. Spans: doc_id, key, spans (array of start, stop; they may overlap).
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    rows = save(docs.select("doc_id", "key", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "lpf-rows")
    long_ = rows.where((F.col("n_bytes") >= LEAST) & F.col("doc_id").isNotNull())
    first = long_.groupBy("digest").agg(F.min("doc_id").alias("first"))
    rows = save(rows.join(first, "digest", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first"), "lpf-copies")
    total = long_.agg(F.sum("n_bytes")).first()[0] or 0
    bits = _slot_bits(total)
    copies = rows.where("copy").select("doc_id")
    # rows that aren't copies but look so in the bitmap are in a second one, so that only copies are left out
    doubt = scratch.save(mark_probable(rows.where("not copy and doc_id is not null"), "doc_id", copies).where("_probable").select("doc_id"), "lpf-doubt")
    texts = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LEAST))
    texts = mark_probable(texts, "doc_id", copies).withColumnRenamed("_probable", "_copy")
    texts = mark_probable(texts, "doc_id", doubt).where("not _copy or _probable").select("doc_id", "key", "text")
    with small_batches(docs.sparkSession):
        slots = scratch.save(shared_slots(texts, bits), "lpf-slots")
        found = mark_probable(anchors(texts, bits), "slot", slots.select("slot")).where("_probable").drop("_probable")
        found = scratch.save(found, "lpf-anchors")  # read three times
        said = _first_documents(found, slots, 2 * total / (SPAN + 1)).withColumn("repeated", F.col("doc_id") > F.col("first"))
        said = said.where("repeated or not one").select(
            "doc_id", "key", "low", "high", "repeated", *[F.when(~F.col("repeated"), F.col(c)).alias(c) for c in ("slot", "hood")]
        )
        said = scratch.save(said, "lpf-said")
        mark = F.xxhash64("slot", "hood", "doc_id")
        first = said.where("not repeated")
        open_ = mark_probable(anchors(texts, bits, True), "slot", first.select("slot").distinct()).where("_probable").drop("_probable")
        open_ = mark_probable(open_.withColumn("_mark", mark), "_mark", first.select(mark.alias("_mark")))
        spans = repeated_windows(open_.where("_probable").select("doc_id", "key", "slot", "low", "high", "bytes"))
        spans = said.where("repeated").select("doc_id", "key", F.col("low").alias("start"), (F.col("high") + LEAST).alias("stop")).unionByName(spans)
        spans = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # no more than a text has anchors
        spans = save(spans, "lpf-spans")
    return rows, spans.join(rows.where("copy").select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text)."""
    scratch = Scratch()
    rows, spans = repeated_spans(docs, scratch)
    spans = scratch.save(spans, "lpf-own-spans")
    text = F.coalesce("text", F.lit("")).cast("binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    some = mark_probable(texts, "doc_id", spans.select("doc_id").distinct()).where("_probable").withColumn("key", F.xxhash64("text"))
    with small_batches(docs.sparkSession):
        cut = some.join(spans, ["doc_id", "key"]).select("doc_id", "text", "spans")
        cut = save(cut.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "lpf-cut")
    rest = rows.join(spans.select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    rest = save(
        rest.select(
            "doc_id", "n_bytes", F.when(F.col("copy"), F.col("n_bytes")).otherwise(0).alias("n_removed"), F.col("copy").cast("long").alias("n_spans"),
            F.when(F.col("copy"), F.sha2(F.lit(b""), 256)).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"),
        ),
        "lpf-rest",
    )
    scratch.drop()
    return rest.unionByName(cut)


SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
b AS (SELECT doc_id, h, n, unnest(range(n)) AS i FROM d),
w AS (SELECT doc_id, i, CASE WHEN i + {LEAST} <= n THEN substr(h, 2 * i + 1, {2 * LEAST}) END AS s, substr(h, 2 * i + 1, 2) AS x FROM b),
f AS (SELECT s, min(doc_id) AS first FROM w WHERE s IS NOT NULL GROUP BY s HAVING min(doc_id) < max(doc_id)),
m AS (SELECT w.doc_id, w.i, w.x, coalesce(max(CASE WHEN f.first < w.doc_id THEN 1 ELSE 0 END) OVER (
        PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {LEAST - 1} PRECEDING AND CURRENT ROW), 0) AS gone
      FROM w LEFT JOIN f ON f.s = w.s),
r AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS starts FROM m),
k AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (WHERE starts) AS BIGINT) AS n_spans,
             sha256(unhex(coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE gone = 0), ''))) AS kept_sha256
      FROM r GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
