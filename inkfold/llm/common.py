"""Shared helpers: tables in the shared folder, numbering rows, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.tables import remove, shared_folder, spread

#: Rows of whole texts in an Arrow batch. Spark bounds a batch by 10,000 rows and 64 MB, which is tens of MB on both sides of a worker.
TEXT_ROWS = 500


BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def set_small_batches(spark: SparkSession) -> None:
    """From now on this session hands at most ``TEXT_ROWS`` rows to a Python worker at a time. For whole applications."""
    if not 0 < int(spark.conf.get(BATCH_KEY)) <= TEXT_ROWS:
        spark.conf.set(BATCH_KEY, TEXT_ROWS)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While a table is written, the session hands at most ``TEXT_ROWS`` rows to a Python worker at a time."""
    before = spark.conf.get(BATCH_KEY)
    set_small_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def slices(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what a worker makes of a batch stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


class Saved:
    """A table written to the shared folder: it cuts lineage and outlives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = shared_folder(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only when nothing reads ``df`` any more."""
        remove(self.spark, self.path)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read again."""
    return Saved(df, name).df


class Scratch:
    """Tables that are needed only until the next ones are written."""

    def __init__(self) -> None:
        self.tables: list[Saved] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(Saved(df, name))
        return self.tables[-1].df

    def drop(self) -> None:
        for t in self.tables:
            t.drop()
        self.tables.clear()


def _run_places(df: DataFrame, cls: str) -> DataFrame:
    """``df`` with _i: a row's place in its run of equal ``cls`` (long, not null) inside its partition, from 0."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(cls).to_numpy(zero_copy_only=False)
            new = np.concatenate(([k[0] != last], k[1:] != k[:-1]))
            n = np.arange(len(k))
            i = n - np.maximum.accumulate(np.where(new, n, -done))
            last, done = k[-1], int(i[-1]) + 1
            yield b.append_column("_i", pa.array(i))

    return df.mapInArrow(place, StructType([*df.schema.fields, StructField("_i", LongType())]))


def number_in_class(df: DataFrame, cls: str, order: list[str], out: str = "rank", scratch: Scratch | None = None) -> DataFrame:
    """Number the rows of each class (long) from 0 without gaps, in the given order.

    A class may hold any share of all rows: rows are range partitioned on (class, order) and
    their number in the table, which tells rows apart that are equal in all else. They are
    numbered inside their partition and shifted by the count of the class in earlier
    partitions. Only a class that goes on from one partition to the next needs a shift, so
    the broadcast table has at most one row per partition.
    ``df`` is read twice (range bounds are sampled), so pass a saved table.
    """
    by = [cls, *order, "_row"]
    placed = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")
    placed = (scratch.save if scratch else save)(_run_places(placed.withColumn("_pid", F.spark_partition_id()), cls), "numbered")
    runs = placed.groupBy("_pid", cls).agg(F.count(F.lit(1)).alias("_n"))
    ends = runs.groupBy("_pid").agg(F.min(cls).alias("_a"), F.max(cls).alias("_b"))
    # the first and the last class of each partition: two rows per partition
    ends = runs.join(ends, "_pid").where((F.col(cls) == F.col("_a")) | (F.col(cls) == F.col("_b")))
    before = Window.partitionBy(cls).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = ends.select("_pid", cls, F.sum("_n").over(before).alias("_shift")).where("_shift is not null")
    return (
        placed.join(F.broadcast(shift), ["_pid", cls], "left")
        .withColumn(out, F.col("_i") + F.coalesce("_shift", F.lit(0)))
        .drop("_pid", "_i", "_shift")
    )


#: Most bits of a membership bitmap (64 MB), and bits for each id below that.
MOST_BITS, BITS_PER_ID = 1 << 29, 16


def mark_probable(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``df`` with ``_probable``: true where its id (long) is in ``ids`` (one long column), and for a few other rows.

    ``df`` isn't shuffled. A bitmap of hashed ids is broadcast: ``BITS_PER_ID`` bits an id, but never more than
    ``MOST_BITS`` in all. With more ids than that it marks more other rows; it never misses one.
    """
    n = ids.count()
    bits = 1 << 15
    while bits < min(MOST_BITS, BITS_PER_ID * n):
        bits *= 2
    spot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    chunk, place = lambda s: F.shiftright(s, 15), lambda s: s.bitwiseAND(F.lit(32767))
    table = ids.groupBy(chunk(spot(ids.columns[0])).alias("_chunk")).agg(
        F.bitmap_construct_agg(place(spot(ids.columns[0]))).alias("_bits")
    )
    at = place(spot(column))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8 + 1).cast("int"))
    return (
        df.withColumn("_chunk", chunk(spot(column)))
        .join(F.broadcast(table), "_chunk", "left")
        .withColumn("_probable", F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False)))
        .drop("_chunk", "_bits")
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node is both centre and leaf, and every leaf (u) has one centre (v)."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    ends = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return ends.where("leaf > 1 or leaf = 1 and centre = 1").isEmpty()


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) of every node of ``edges`` (u long, v long); component: smallest reachable id.

    Alternates large-star and small-star rounds until the edges are stars around
    their smallest node. Minima come from partial aggregation; they are dealt anew before
    the join, whose two sides then have exchanges of their own, so that adaptive execution
    can split the rows of a node with very many neighbours. Every round is written to the
    shared folder.
    """
    now = Saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while not _are_stars(now.df):
        # large star: each larger neighbour of u goes to the smallest of u's neighbourhood
        both = now.df.union(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
        big = Saved(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name
        )
        # small star: u and its smaller neighbours go to the smallest of them
        low = big.df.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
        small = big.df.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = Saved(small.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
        big.drop()
        now.drop()
        now = after
    stars = now.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
