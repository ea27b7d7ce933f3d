"""A Merkle tree over the documents of each language, with proofs looked up by coordinates.

A document is a leaf: the hash of doc_id, source, lang, n_chars and text, each ``-`` if null, else its UTF-8 byte count, ``:`` and the
value. The leaves of a language ascend by doc_id; of every level, two consecutive nodes (the last may be alone) become one
of the next, until one is left, the subroot. Subroots in the order of their languages give the root in the same way.

Method. The nodes are a written table (tree, level, place, hash). A leaf's proof follows from its place and the size of its tree
alone: it explodes the coordinates of its siblings, which join the table of nodes; they are put in order, joined and hashed,
and folded into the leaf to give a root again. Trees are cut into blocks of 2^``BLOCK`` places: a task builds all levels of a
block at once, and the blocks' tops are the leaves of the next stretch of levels, so a tree of 3 * 10^10 leaves takes three
rounds. Proofs are looked up by stretches as well: a leaf asks for the siblings inside its block, a block for those above it, a
language for those between languages. So no node is asked for by more than 2^``BLOCK`` rows, and no tree is held in one task.

Defined results: null doc_ids come first, and rows that repeat a doc_id are put in the order of their leaves; equal rows are leaves of
their own; null and empty values differ (``-`` and ``0:``), very long texts are hashed whole inside their scan; an empty table gives
an empty result; a null n_chars or doc_id isn't tampered with; other columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import runs
from .common import Scratch, number_in_class, save

#: Levels that a task builds at once, of at most 2^BLOCK places.
BLOCK = 12
NONE = "cast(array() as array<struct<level:int,left:boolean,hash:string>>)"
#: One of so many leaves is tampered with.
TAMPERED = 7


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column) -> Column:
    """The hash of a document with that ``n_chars``."""
    parts = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return F.sha2(F.concat(*[_field(c) for c in parts]), 256)


def levels(batches: Iterator[pa.RecordBatch], up: int) -> Iterator[pa.RecordBatch]:
    """All nodes above the rows of a block of 2^up places (tree, size, block, place, hash), up to ``up`` levels or the top of the tree."""
    for t in runs(batches, ["tree", "block"]):
        tree, size, block = (t.column(c)[0].as_py() for c in ("tree", "size", "block"))
        now, out, first = t.column("hash").to_pylist(), [], block << up
        for level in range(1, up + 1):
            if size == 1:
                break
            now = [_h(*now[i : i + 2]) for i in range(0, len(now), 2)]
            size, first = (size + 1) // 2, first // 2
            out += [(level, first + i, x) for i, x in enumerate(now)]
        if out:
            n = len(out)
            level, place, found = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, tree)), pa.array(level, pa.int32()), pa.array(place, pa.int64()), pa.array(found)], ["tree", "level", "place", "hash"]
            )


def build(leaves: DataFrame, up: int, scratch: Scratch) -> list[tuple[DataFrame, DataFrame]]:
    """Stretches of ``up`` levels, lowest first, as (leaves, nodes).

    ``leaves`` (tree long, size, place, hash): places from 0 without gaps to size. The nodes (tree, level, place, hash) of a stretch
    count their levels from its leaves at 0; the leaves of the next are its top nodes. A tree whose top is reached has no leaves above.
    """
    out = []
    while not leaves.isEmpty():
        own = leaves.select("tree", "size", F.shiftright("place", up).alias("block"), "place", "hash")
        own = own.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
        above = own.mapInArrow(partial(levels, up=up), "tree long, level int, place long, hash string")
        nodes = scratch.save(leaves.select("tree", F.lit(0).alias("level"), "place", "hash").unionByName(above), "merkle-nodes")
        out.append((leaves, nodes))
        # trees of at most 2^up leaves end in this stretch
        sizes = leaves.where("place = 0").select("tree", F.expr(f"shiftright(size + {(1 << up) - 1}, {up})").alias("size"))
        tops = nodes.where(F.col("level") == up).select("tree", "place", "hash")
        leaves = scratch.save(tops.join(sizes.where("size > 1"), "tree").select("tree", "size", "place", "hash"), "merkle-tops")
    return out


def proofs(asked: DataFrame, nodes: DataFrame, up: int) -> DataFrame:
    """``asked`` (tree, size, place, hash) with ``siblings``: of each of at most ``up`` levels, lowest first, whether it is left, and its hash or null.

    Coordinates follow from place and size: at level l the sibling of p is (p >> l) ^ 1, if there are so many nodes.
    """
    level = F.explode(F.expr(f"sequence(0, {up - 1})")).alias("level")
    wanted = asked.select("tree", "size", "place", level).where("shiftright(size - 1, level) > 0")
    sibling = F.expr("shiftright(place, level)").bitwiseXOR(F.lit(1).cast("long")).alias("sibling")
    wanted = wanted.select("tree", "place", "level", sibling)
    found = wanted.join(nodes.select("tree", "level", F.col("place").alias("sibling"), "hash"), ["tree", "level", "sibling"], "left")
    each = F.struct("level", (F.col("sibling") % 2 == 0).alias("left"), "hash")
    found = found.groupBy("tree", "place").agg(F.sort_array(F.collect_list(each)).alias("siblings"))
    return asked.join(found, ["tree", "place"], "left").withColumn("siblings", F.coalesce("siblings", F.expr(NONE)))


def fold(start: Column, siblings: Column) -> Column:
    """The hash that ``start`` and its siblings give, level by level."""
    return F.aggregate(
        siblings, start, lambda acc, s: F.sha2(F.when(s["hash"].isNull(), acc).when(s["left"], F.concat(s["hash"], acc)).otherwise(F.concat(acc, s["hash"])), 256)
    )


def prove(leaves: DataFrame, up: int, scratch: Scratch) -> DataFrame:
    """``leaves`` (tree, size, place, hash) with the ``siblings`` of all levels up to the top of their tree."""
    above = None
    for own, nodes in reversed(build(leaves, up, scratch)):
        found = proofs(own, nodes, up)
        if above is not None:
            # the block of a leaf is its place among the leaves of the stretch above
            upper = above.select("tree", F.col("place").alias("block"), F.col("siblings").alias("_upper"))
            found = found.withColumn("block", F.shiftright("place", up)).join(upper, ["tree", "block"], "left").drop("block")
            found = found.withColumn("siblings", F.when(F.col("_upper").isNull(), F.col("siblings")).otherwise(F.concat("siblings", "_upper"))).drop("_upper")
        above = scratch.save(found, "merkle-proofs")
    return above if above is not None else leaves.withColumn("siblings", F.expr(NONE))


def manifest(docs: DataFrame, up: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs`` (doc_id, source, lang, n_chars, text)."""
    scratch = Scratch()
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    rows = scratch.save(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf(F.col("n_chars").cast("long")).alias("hash"),
            F.when(tampered, leaf(F.col("n_chars").cast("decimal(20,0)") + 1)).alias("shown"),
        ),
        "merkle-leaves",
    )
    # languages are numbered in their order, null first; the table has a row for each
    langs = scratch.save(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size")).withColumn("one", F.lit(0).cast("long")), "merkle-langs")
    langs = scratch.save(number_in_class(langs, "one", ["lang"], "tree", scratch), "merkle-trees")
    named = rows.join(langs, rows["lang"].eqNullSafe(langs["lang"])).select("tree", "size", "doc_id", "hash", "shown")
    placed = scratch.save(number_in_class(scratch.save(named, "merkle-named"), "tree", ["doc_id", "hash"], "place", scratch), "merkle-placed")
    below = prove(placed.select("tree", "size", "place", "hash"), up, scratch)
    # a language's subroot is what its first leaf folds to
    n = langs.count()
    subroots = below.where("place = 0").select(
        F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("size"), F.col("tree").alias("place"), fold(F.col("hash"), F.col("siblings")).alias("hash")
    )
    upper = prove(scratch.save(subroots, "merkle-subroots"), up, scratch)
    upper = upper.select(
        F.col("place").alias("tree"), F.col("hash").alias("subroot"), fold(F.col("hash"), F.col("siblings")).alias("root"), F.col("siblings").alias("_upper")
    )
    whole = placed.join(below.select("tree", "place", "siblings"), ["tree", "place"]).join(upper, "tree")
    whole = whole.withColumn("siblings", F.concat("siblings", "_upper"))
    known = F.filter("siblings", lambda s: s["hash"].isNotNull())
    folded = fold(F.coalesce("shown", "hash"), F.col("siblings"))
    out = whole.select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", "root",
        F.sha2(F.array_join(F.transform(known, lambda s: s["hash"]), ""), 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    out = save(out.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle-manifest")
    scratch.drop()
    return out


_ENC = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"


def _leaf_sql(n_chars: str) -> str:
    parts = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return "sha256(" + " || ".join(_ENC.format(p) for p in parts) + ")"


SQL = f"""
WITH RECURSIVE
crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
c AS (SELECT *, hex(encode(CAST(doc_id AS VARCHAR))) AS h FROM documents),
d AS (SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('n_chars + 1')} AS other, n_chars IS NOT NULL AND
  xor(list_reduce(range(CAST(length(h) // 2 AS BIGINT)), lambda v, i: xor(v >> 8, t[1 + (xor(v, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) & 255)]),
  CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % {TAMPERED} = 0 AS tampered FROM c, crc_table),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS place, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree FROM d),
nodes(tree, level, place, hash, n) AS (
  SELECT tree, 0, place, leaf, count(*) OVER (PARTITION BY tree) FROM p
  UNION ALL
  SELECT tree, min(level) + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (min(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, place // 2),
sub AS (SELECT tree, hash FROM nodes WHERE n = 1),
tops(level, place, hash, n) AS (
  SELECT 0, tree, hash, count(*) OVER () FROM sub
  UNION ALL
  SELECT min(level) + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (min(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY place // 2),
heights AS (SELECT tree, max(level) AS height FROM nodes GROUP BY tree),
every AS (SELECT tree, level, place, hash FROM nodes UNION ALL SELECT -1, level, place, hash FROM tops),
fold(doc_id, tree, height, place, level, acc, proof) AS (
  SELECT p.doc_id, p.tree, height, p.place, 0, CASE WHEN tampered THEN other ELSE leaf END, '' FROM p JOIN heights USING (tree)
  UNION ALL
  SELECT f.doc_id, f.tree, f.height, f.place, f.level + 1,
    CASE WHEN s.hash IS NULL THEN sha256(acc) WHEN s.place < x.at THEN sha256(s.hash || acc) ELSE sha256(acc || s.hash) END, proof || coalesce(s.hash, '')
  FROM fold f
  CROSS JOIN LATERAL (SELECT CASE WHEN f.level < f.height THEN f.tree ELSE -1 END AS t, CASE WHEN f.level < f.height THEN f.level ELSE f.level - f.height END AS l,
                             CASE WHEN f.level < f.height THEN f.place >> f.level ELSE f.tree >> (f.level - f.height) END AS at) x
  LEFT JOIN every s ON s.tree = x.t AND s.level = x.l AND s.place = xor(x.at, 1)
  WHERE f.level < f.height + (SELECT max(level) FROM tops))
SELECT p.doc_id, p.leaf, sub.hash AS subroot, (SELECT hash FROM tops WHERE n = 1) AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root,
       f.acc = (SELECT hash FROM tops WHERE n = 1) AS verified
FROM p JOIN sub USING (tree) JOIN fold f ON f.doc_id = p.doc_id AND f.level = f.height + (SELECT max(level) FROM tops)
"""
