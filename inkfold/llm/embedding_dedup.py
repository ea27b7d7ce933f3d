"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosines, connected components.

Only vectors with equal, non-null labels (and equally many components) are compared.
A vector that is null, empty or zero, or holds a null or non-finite component, links
with nothing.

1. Vectors with equal label and components are one class, with its number of copies and
   a number of its own, whatever ids its rows have.
2. Each class has a key in each of several tables: the signs of random projections, with
   the label and the dimension. The number of signs grows with the logarithm of the
   label's own number of classes, so that unrelated vectors of a label share about one
   bucket in sixteen tables at any size; the number of tables is then what keeps the chance
   that a pair at the least cosine shares none at ``MISS``. Classes with a key in common
   are candidates.
3. Only keys are exploded; of buckets with the same members one is kept, and vectors are
   joined to the members of those that have more than one. Those are compared in blocks of bounded size by matrix products in double
   precision. A pair counts in the first table whose key both share, so links are counted
   once; a block hands back sums per member and a forest of links.
4. Components come from the distributed star algorithm over those forests.

There is no cap on buckets or partners; work inside a bucket grows with the square of
the number of its different vectors over the block size.

Defined results: excluded vectors have n_links 0 and their own vec_id as component;
rows that repeat a vec_id count as separate rows, each with its own vector; a component has
the smallest vec_id of its rows, or null where none has one, and the rows kept are those of
that vec_id and of one class that has it; a vector of any length is compared whole; an empty
table gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from . import blocks
from .common import Scratch, connected_components, save

#: Signs of a key, at least and at most; chance that a pair at the least cosine shares no key.
BITS, MOST_BITS, MISS = 12, 32, 1e-6
#: Bits of a key for the number of its table.
TABLE_BIT = 16
#: Members and components in a block.
BLOCK, ELEMENTS = 2048, 1 << 19
_odd = np.random.default_rng(5).integers(1, 1 << 62, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signs(classes: Column) -> Column:
    """Signs of a key for a label of so many different vectors."""
    return F.least(F.lit(MOST_BITS), F.greatest(F.lit(BITS), F.ceil(F.log2(F.greatest(F.lit(2), classes))).cast("int") + 4))


@lru_cache(maxsize=64)
def tables_for(bits: int, least: float) -> int:
    """Tables of keys of so many signs for pairs at cosine ``least``."""
    alike = 1 - math.acos(min(1.0, max(-1.0, least))) / math.pi  # chance of one sign to agree
    return max(1, math.ceil(math.log(MISS) / math.log1p(-(alike**bits)))) if alike < 1 else 1


@lru_cache(maxsize=8)
def _planes(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([11, dim]).standard_normal((n, dim)).T


def table_codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The signs of each row of ``x`` in each table, as unsigned 32-bit numbers."""
    out = np.empty((len(x), tables), np.uint32)
    for i in range(0, len(x), 256):
        signs = (x[i : i + 256] @ _planes(x.shape[1], bits * tables) > 0).reshape(-1, tables, bits)
        out[i : i + 256] = (signs * (np.uint32(1) << np.arange(bits, dtype=np.uint32))).sum(2, dtype=np.uint32)
    return out


def table_keys(codes: np.ndarray, labels: np.ndarray, dim: int) -> np.ndarray:
    """Keys (as int64) of codes: the table in the upper bits, then 48 bits of a hash of code, table, label and dimension."""
    tag = labels.astype(np.uint64) * _odd[0] + np.array([dim], np.uint64) * _odd[1]
    k = (codes.astype(np.uint64) + np.uint64(1)) * _odd[2] + np.arange(codes.shape[1], dtype=np.uint64) * _odd[3] + tag[:, None]
    k = (k ^ (k >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    k = (k ^ (k >> np.uint64(33))) >> np.uint64(TABLE_BIT)
    return (k | np.arange(codes.shape[1], dtype=np.uint64) << np.uint64(64 - TABLE_BIT)).view(np.int64)


def _components(vector: bytes, kind: type) -> np.ndarray:
    """A vector in double precision; one of doubles is scaled by a power of two, so that no product is out of range."""
    x = np.frombuffer(vector, kind).astype(np.float64)
    return x if kind is np.float32 else np.ldexp(x, -np.frexp(np.abs(x).max())[1])


def _checked(rows: DataFrame, kind: type) -> DataFrame:
    """vec_id, label, digest, vector (components of ``kind`` as bytes) of every row; the last two are null where it can't link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col, label = b.column("embedding"), b.column("label")
            values = col.values.to_numpy(zero_copy_only=False).astype(kind)  # a null component becomes NaN
            offsets, there = col.offsets.to_numpy(), col.is_valid().to_numpy(zero_copy_only=False)
            names = label.to_pylist()
            digests: list[bytes | None] = []
            vectors: list[bytes | None] = []
            for i, y in enumerate(names):
                v = values[offsets[i] : offsets[i + 1]]
                if there[i] and y is not None and len(v) and np.isfinite(v).all() and v.any():
                    vectors.append((v + kind(0)).tobytes())  # -0.0 counts as 0.0
                    digests.append(hashlib.blake2b(vectors[-1], digest_size=16, salt=int(y).to_bytes(8, "little", signed=True)).digest())
                else:
                    vectors.append(None)
                    digests.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), label, pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())],
                ["vec_id", "label", "digest", "vector"],
            )

    return rows.mapInArrow(check, "vec_id long, label long, digest binary, vector binary")


def _keyed(classes: DataFrame, kind: type, least: float) -> DataFrame:
    """node, dim, codes (of all tables, as bytes), keys of every class (node, label, vector, bits)."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors, labels = b.column("vector").to_pylist(), b.column("label").to_numpy()
            kinds = list(zip(map(len, vectors), b.column("bits").to_pylist()))
            codes: list[bytes] = [b""] * len(vectors)
            dim = [0] * len(vectors)
            keys = [np.empty(0, np.int64)] * len(vectors)
            for n, bits in set(kinds):
                at = [i for i, k in enumerate(kinds) if k == (n, bits)]
                x = np.stack([_components(vectors[i], kind) for i in at])
                found = table_codes(x, bits, tables_for(bits, least))
                for i, c, k in zip(at, found, table_keys(found, labels[at], x.shape[1])):
                    codes[i], dim[i], keys[i] = c.tobytes(), x.shape[1], k
            offsets = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), pa.array(dim, pa.int32()), pa.array(codes, pa.binary()), pa.ListArray.from_arrays(offsets, flat)],
                ["node", "dim", "codes", "keys"],
            )

    return classes.select("node", "label", "vector", "bits").mapInArrow(key, "node long, dim int, codes binary, keys array<long>")


def _compare(rows: DataFrame, least: float, kind: type) -> DataFrame:
    """a, n: class a has n more links; a, b: classes a and b are connected. The other column is null."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks.runs(batches, ["bucket", "first_block", "second_block"]):
            x = np.stack([_components(v, kind) for v in t.column("vector").to_pylist()])
            norm = np.linalg.norm(x, axis=1)
            codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint32).reshape(len(x), -1)
            table, own = t.column("bucket")[0].as_py() >> (64 - TABLE_BIT), t.column("own_block").to_numpy()
            two = t.column("first_block")[0].as_py() != t.column("second_block")[0].as_py()
            node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
            n, found = np.zeros(len(x), np.int64), []
            for lo in range(0, len(x), 256):
                i, j = np.nonzero(x[lo : lo + 256] @ x.T / norm[lo : lo + 256, None] / norm[None, :] >= least)
                i += lo
                keep = (i < j) & ((own[i] != own[j]) if two else True)
                i, j = i[keep], j[keep]
                new = codes[i, table] == codes[j, table]
                for k in range(0, table, 8):
                    at = np.flatnonzero(new)
                    new[at] = (codes[i[at], k : min(k + 8, table)] != codes[j[at], k : min(k + 8, table)]).all(1)
                i, j = i[new], j[new]
                if len(i):
                    np.add.at(n, i, copies[j])
                    np.add.at(n, j, copies[i])
                    found = blocks.forest(np.concatenate((np.array(found, np.int64).reshape(-1, 2), np.stack([node[i], node[j]], 1))))
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*node[some].tolist(), *(p[0] for p in found)], pa.int64()),
                        pa.array([*[None] * len(some), *(p[1] for p in found)], pa.int64()),
                        pa.array([*n[some].tolist(), *[None] * len(found)], pa.int64()),
                    ],
                    ["a", "b", "n"],
                )

    return rows.mapInArrow(compare, "a long, b long, n long")


def near_duplicate_vectors(embeddings: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings`` (vec_id, embedding, label)."""
    single = embeddings.schema["embedding"].dataType == ArrayType(FloatType(), embeddings.schema["embedding"].dataType.containsNull)
    kind = np.float32 if single else np.float64
    own = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"),
    )
    scratch = Scratch()
    rows = save(_checked(own, kind), "vectors")
    grouped = rows.where("digest is not null").groupBy("digest").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    # written with its numbers, so that all branches see the same ones
    classes = scratch.save(grouped.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    # a row for each label; a label may hold any share of the classes, and the join can be split
    per_label = scratch.save(classes.groupBy("label").agg(signs(F.count(F.lit(1))).alias("bits")), "vector-labels")
    keyed = scratch.save(_keyed(classes.join(per_label, "label"), kind, least), "vector-keys")
    # of buckets with the same members the one in the first table stays, which is the first that any two of them share
    buckets = keyed.select("node", "dim", F.explode("keys").alias("bucket"))
    members = blocks.drop_repeated_buckets(buckets, "bucket", "node", "dim").drop("dim", "pivot")
    held = classes.select("node", "vector", "copies").join(keyed.select("node", "codes"), "node")
    members = blocks.block_pairs(members.join(held, "node"), "bucket", "node", BLOCK, ELEMENTS)
    found = scratch.save(_compare(members, least, kind), "vector-links")
    links = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    answer = save(
        classes.select("node", "rep", "digest", "copies")
        .join(links, "node", "left")
        .join(components, "node", "left")
        .select(
            "node", "rep", "digest",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        ),
        "vector-answer",
    )
    scratch.drop()
    # of the classes of a component, the one with the smallest id, then digest
    best = answer.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "digest")).alias("best"))
    answer = answer.join(best.hint("rebalance"), "component", "left").select(
        "digest", "n_links", F.col("best.rep").alias("component_id"), (F.col("digest") == F.col("best.digest")).alias("_stays")
    )
    linked = rows.where("digest is not null").join(answer, "digest").select("vec_id", "n_links", "component_id", "_stays")
    alone = rows.where("digest is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("_stays")
    )
    kept = F.col("_stays") & F.col("vec_id").eqNullSafe(F.col("component_id"))
    return linked.unionByName(alone).withColumn("kept", kept).drop("_stays")


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.98),
r(vec_id, id) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.w FROM r JOIN l ON l.u = r.id)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.u = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT vec_id, min(id) AS component_id FROM r GROUP BY vec_id) c ON c.vec_id = e.vec_id
"""
