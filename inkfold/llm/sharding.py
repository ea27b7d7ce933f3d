"""Sharding by longest-processing-time scheduling (law ``bytes``: shard sizes near equal).

Rows with equal texts form a group and stay together (null counts as empty). A row's
size is the UTF-8 bytes of its text plus 8, a group's the sum of its rows'. Groups,
largest first, go to the shard with the least load, taken from a heap.

Groups of one size are alike, so the driver schedules over a histogram: (size, number
of groups). It holds fewer than sqrt(2 * all bytes) rows, since the sizes differ: 14
million at 100 TB. A run of equal groups is dealt through the heap, in whole rounds
where it is long, and each shard takes a range of their numbers. Groups are numbered
within their size by a range partition and look their range up in the plan, a written
table of at most (rows of the histogram) * ``shards`` entries, and never more than
groups; Spark broadcasts it only below its threshold. The driver writes it in pieces of
``PIECE`` entries, so it holds 16 bytes for each size and one piece. The result is that of
one heap over all groups.

Slots number the rows of a shard from 0 in the order of doc_id; a range partition on
(shard, doc_id) spreads a shard over many tasks. grown_shard is null, as the law is
not ``key``. Defined results: an empty table gives an empty result; a row that
repeats a doc_id has a slot of its own, rows without doc_id come first; a very long
text is a group of its own size, whole; other columns of any name are ignored.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import remove, shared_folder
from .common import Scratch, number_in_class

#: Shards, and entries of the plan that are held at a time.
SHARDS, PIECE = 24, 1 << 20


def deal(sizes: np.ndarray, counts: np.ndarray, shards: int, piece: int = PIECE) -> Iterator[np.ndarray]:
    """Longest processing time over ``counts`` groups of each of the descending ``sizes``; ties go to the lower shard.

    Yields ranges as rows (size, first number, last number + 1, shard), at most about ``piece`` at a time.
    """
    heap = [(0, s) for s in range(shards)]
    out = array("q")
    for i in range(len(sizes)):
        size, n = int(sizes[i]), int(counts[i])
        if len(out) >= 4 * piece:
            yield np.frombuffer(out, np.int64).reshape(-1, 4)
            out = array("q")
        if n == 1:
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            out.extend((size, 0, 1, s))
            continue
        got = dict.fromkeys(range(shards), 0)
        if n > shards * 4:
            # whole rounds at once: every shard below the level that so many groups reach for certain
            low, high = 0, n
            top = max(heap)[0]
            while low < high:  # the most rounds k after which no more than n groups are placed below top + k * size
                k = (low + high + 1) // 2
                if sum((top + k * size - load) // size for load, _ in heap) <= n:
                    low = k
                else:
                    high = k - 1
            for k, (load, s) in enumerate(heap):
                q = (top + low * size - load) // size if low else 0
                got[s], n = q, n - q
                heap[k] = (load + q * size, s)
            heapq.heapify(heap)
        for _ in range(n):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            got[s] += 1
        at = 0
        for s, q in got.items():
            if q:
                out.extend((size, at, at + q, s))
                at += q
    yield np.array(out, np.int64).reshape(-1, 4)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    scratch = Scratch()
    rows = scratch.save(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("group"),
        ),
        "shard-rows",
    )
    groups = scratch.save(rows.groupBy("group").agg(F.sum("size").alias("group_size")), "shard-groups")
    counts = groups.groupBy("group_size").agg(F.count(F.lit(1)).alias("n")).toArrow()
    sizes, n = counts.column("group_size").to_numpy(), counts.column("n").to_numpy()
    order = np.argsort(-sizes)
    path = shared_folder(spark, "shard-plan")
    for part in deal(sizes[order], n[order], shards):
        columns = {c: part[:, i] for i, c in enumerate(("group_size", "_from", "_to", "_shard"))}
        spark.createDataFrame(pa.table(columns)).write.mode("append").parquet(path)
    plan = spark.read.schema("group_size long, _from long, _to long, _shard long").parquet(path)
    # a size may have any share of all groups, and a group any share of all rows: both joins can be split
    numbered = number_in_class(groups, "group_size", ["group"], scratch=scratch)
    within = (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))
    placed = scratch.save(
        numbered.join(plan, "group_size").where(within).select("group", F.col("_shard").cast("int").alias("shard")), "shard-placed"
    )
    dealt = scratch.save(rows.join(placed, "group").select("doc_id", "size", "text_crc32", "shard"), "shard-dealt")
    slots = number_in_class(dealt, "shard", ["doc_id"], "slot")
    remove(spark, path)
    scratch.drop()
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: The heap as a recursion over the groups, largest first; groups of one size take its places in the order of their digests.
SQL = f"""
WITH RECURSIVE
crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, sha256(coalesce(text, '')) AS grp FROM documents),
c AS (SELECT doc_id, size, grp, xor(list_reduce(range(CAST(length(h) // 2 AS BIGINT)), lambda v, i: xor(v >> 8, t[1 + (xor(v, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) & 255)]),
  CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM d, crc_table),
g AS (SELECT grp, CAST(sum(size) AS BIGINT) AS gs FROM d GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY gs DESC, grp) AS n, row_number() OVER (PARTITION BY gs ORDER BY grp) AS k FROM g),
lpt(n, gs, shard, loads) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS INTEGER), list_transform(range({SHARDS}), lambda i: CAST(0 AS BIGINT))
  UNION ALL
  SELECT o.n, o.gs, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER),
         list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + o.gs ELSE x END)
  FROM lpt JOIN o ON o.n = lpt.n + 1),
placed AS (SELECT gs, shard, row_number() OVER (PARTITION BY gs ORDER BY shard, n) AS k FROM lpt WHERE n > 0)
SELECT c.doc_id, c.size, c.text_crc32, 'bytes' AS law, p.shard, row_number() OVER (PARTITION BY p.shard ORDER BY c.doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM c JOIN o ON o.grp = c.grp JOIN placed p ON p.gs = o.gs AND p.k = o.k
"""
