"""Comparing the members of candidate buckets in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most elements (hashes of a set, components of a vector) in a block, but for a member that has more by itself.
ELEMENTS = 1 << 20


def drop_repeated_buckets(rows: DataFrame, bucket: str, member: str, size: str) -> DataFrame:
    """Of buckets with the same members, the rows of one. Buckets of one member go.

    Adds ``bucket_size``, the sum of ``size`` over its members as ``bucket_elements``, and the smallest member, as
    ``pivot``. Buckets count as the same when size, smallest member and a 128-bit sum of hashes agree. All aggregates are
    of fixed width, so they are hashed, not sorted.
    """
    marks = (
        rows.groupBy(bucket)
        .agg(
            F.count(F.lit(1)).alias("bucket_size"),
            F.sum(size).cast("long").alias("bucket_elements"),
            F.min(member).alias("_low"),
            F.bit_xor(F.xxhash64(member)).alias("_h1"),
            F.bit_xor(F.xxhash64(F.lit(1), member)).alias("_h2"),
        )
        .where("bucket_size > 1")
    )
    chosen = marks.groupBy("bucket_size", "bucket_elements", "_low", "_h1", "_h2").agg(F.min(bucket).alias(bucket))
    return rows.join(chosen.select(bucket, "bucket_size", "bucket_elements", F.col("_low").alias("pivot")), bucket)


def block_pairs(rows: DataFrame, bucket: str, member: str, block: int, elements: int | None = None) -> DataFrame:
    """``rows`` (with bucket_size and bucket_elements) dealt to the pairs of blocks of their bucket: own_block, first_block, second_block.

    A bucket is split by hash into blocks of about ``block`` members and about ``elements`` elements, whichever is less;
    each member goes to every pair that its block is in. Rows of one pair of blocks arrive together and sorted, never
    more than about two blocks of them.
    """
    blocks = F.ceil(F.greatest(F.col("bucket_size") / block, F.col("bucket_elements") / (elements or ELEMENTS))).cast("int")
    return (
        rows.withColumn("own_block", F.pmod(F.xxhash64(F.lit(3), member), blocks).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("first_block", F.least("own_block", "_other"))
        .withColumn("second_block", F.greatest("own_block", "_other"))
        .drop("_other")
        .repartition(bucket, "first_block", "second_block")
        .sortWithinPartitions(bucket, "first_block", "second_block")
    )


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal integer keys, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(x).to_numpy(zero_copy_only=False) for x in keys], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for a, e in zip(cuts, cuts[1:]):
            now = tuple(k[a])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, e - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Of the rows (u, v) of ``pairs``, enough to connect what they connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for u, v in pairs.tolist():
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((u, v))
    return out
