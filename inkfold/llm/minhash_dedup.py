"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard, connected components.

1. One pass over the texts writes, per row, the size of its shingle set, a 128-bit
   digest of the set and ``BANDS`` band keys of ``ROWS`` circulant MinHash coordinates
   each. Rows with equal sets are one class from here on, with a number of its own,
   whatever ids its rows have.
2. Classes with equal band keys share a bucket. Of buckets with the same members one
   is kept.
3. The texts are not shuffled: a second pass over them makes the sets of those documents
   that share a bucket, told by a broadcast bitmap of bounded size. Every member is first held against its bucket's smallest member, on full
   sets; the links give components.
4. A bucket whose members are all in one component can link nothing more. In all
   others every pair of members in different components is held against each other,
   again on full sets, in blocks of about ``BLOCK`` members and at most about
   ``blocks.ELEMENTS`` shingles. A pair of blocks is one unit of work and hands back a
   forest of links, never all pairs.

There is no cap on buckets, partners or candidates. Each pair at the similarity asked
for shares a bucket but for a chance of (1 - s**ROWS)**BANDS: 7e-6 at 0.8, 2e-8 at
0.85 if coordinates were independent; README has the measured recall. Sets are joined by class, so copies are
not expanded. Work on the members of a bucket that stays split grows with the square of
its size over BLOCK.

Defined results: a null, empty or white-space text has an empty set, links with
nothing and is kept; a text of fewer than five words is one shingle; a component has the
smallest doc_id of its rows, or null where none has one, and the rows kept are those of
that doc_id and of one class that has it; rows that repeat a doc_id with the same set share
one answer, and with different sets have one each; a very long text is hashed in parts and
its set held whole; an empty table gives an empty result; other columns of any name are ignored
by :func:`near_duplicates` and pass through :func:`keep_one_of_each`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, shingles
from .common import Scratch, connected_components, mark_probable, save, slices, small_batches

ROWS = 5
BANDS = 30
#: Members in a block.
BLOCK = 256
#: Elements of sets compared at a time inside a block.
CHUNK = 1 << 20


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _summaries(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark (as given), n_shingles, digest (null for an empty set) and band keys of each row."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, digest, keys = [], [], []
            for s in shingles.shingle_sets(b.column("text").to_pylist(), width):
                n.append(len(s))
                digest.append(_digest(s))
                keys.append(shingles.band_keys(shingles.signature(s, ROWS * BANDS), BANDS, ROWS) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("mark"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "mark", "n_shingles", "digest", "bands"],
            )

    return docs.mapInArrow(summarise, "doc_id long, mark binary, n_shingles long, digest binary, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """rep (never null), digest, shingles (sorted 64-bit hashes as bytes) of each row."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = shingles.shingle_sets(b.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(map(_digest, found), pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())],
                ["doc_id", "digest", "shingles"],
            )

    return docs.mapInArrow(sets, "doc_id long, digest binary, shingles binary").select(_some("doc_id"), "digest", "shingles")


def _mark(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _some(doc_id: str) -> Column:
    """An id that is never null; with the digest it still tells a class from all others."""
    return F.coalesce(doc_id, F.lit(-(1 << 63))).alias("rep")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(edges: DataFrame, percent: int) -> DataFrame:
    """u, v of the rows (u, v, su, sv) of ``edges`` whose sets are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            good = [
                _linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(b.column("su").to_pylist(), b.column("sv").to_pylist())
            ]
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return edges.mapInArrow(verify, "u long, v long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of different sets, by products of incidence matrices over ranges of hashes."""
    m, total = len(sets), sum(map(len, sets))
    out = np.zeros((m, m), np.float64)
    bounds = np.linspace(0, 2.0**64, max(1, -(-total // CHUNK)) + 1)[1:-1].astype(np.uint64)
    cuts = [np.concatenate(([0], np.searchsorted(s, bounds), [len(s)])) for s in sets]
    for c in range(len(bounds) + 1):
        part = [s[k[c] : k[c + 1]] for s, k in zip(sets, cuts)]
        row = np.repeat(np.arange(m), [len(p) for p in part])
        values, column, count = np.unique(np.concatenate(part), return_inverse=True, return_counts=True)
        shared = count > 1
        place = np.cumsum(shared) - 1
        keep = shared[column]
        row, column = row[keep], place[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(shared.sum()), 4096):
            lo, hi = np.searchsorted(column, [at, at + 4096])
            x = np.zeros((m, 4096), np.float32)
            x[row[lo:hi], column[lo:hi] - at] = 1
            out += x @ x.T
    return out


def _block_links(rows: DataFrame, percent: int) -> DataFrame:
    """u, v (components) linked by some pair of members in a pair of blocks."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks.runs(batches, ["bucket", "first_block", "second_block"]):
            comp = t.column("component").to_numpy()
            if (comp == comp[0]).all():
                continue
            block = t.column("own_block").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            n = np.array([len(s) for s in sets], np.float64)
            both = intersections(sets)
            link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
            link &= comp[:, None] < comp[None, :]
            if t.column("first_block")[0].as_py() != t.column("second_block")[0].as_py():
                link &= block[:, None] != block[None, :]
            i, j = np.nonzero(link)
            if len(i):
                pairs = blocks.forest(np.unique(np.stack([comp[i], comp[j]], 1), axis=0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"]
                )

    return rows.mapInArrow(compare, "u long, v long")


def _decisions(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, mark (digest of the text), n_shingles, digest (of the set, null for an empty one), component_id, kept for every
    row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark(text).alias("mark"), text.alias("text"))
    scratch = Scratch()
    with small_batches(docs.sparkSession):
        rows = save(_summaries(own, width), "minhash-rows")
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    # written with its numbers, so that all branches see the same ones
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    members = scratch.save(
        blocks.drop_repeated_buckets(classes.select("node", "n", F.explode("bands").alias("bucket")), "bucket", "node", "n"),
        "minhash-members",
    )
    # sets of the classes in some bucket, each from the rows of one doc_id
    asked = scratch.save(
        classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "rep", "digest"), "minhash-asked"
    )
    held = mark_probable(own, "doc_id", asked.select("rep")).where("_probable")
    sets = _sets(held.select("doc_id", "text"), width).dropDuplicates(["rep", "digest"])
    with small_batches(docs.sparkSession):
        sets = scratch.save(
            sets.join(asked.select(_some("rep"), "digest", "node"), ["rep", "digest"]).select("node", "shingles"), "minhash-sets"
        )
    alike = 100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")
    star = members.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v"), "n").distinct()
    star = star.join(classes.select(F.col("node").alias("v"), F.col("n").alias("_n")), "v").where(alike).select("u", "v")
    star = star.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v"
    )
    with small_batches(docs.sparkSession):
        first = scratch.save(connected_components(_verified(star.select("u", "v", "su", "sv"), percent)), "minhash-first")
    placed = members.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = scratch.save(
        placed.groupBy("bucket")
        .agg(F.min("component").alias("_a"), F.max("component").alias("_b"))
        .where("_a <> _b")
        .select("bucket"),
        "minhash-open",
    )
    # a bucket of two has had its only pair held against each other
    rest = placed.where("bucket_size > 2").join(open_, "bucket", "left_semi").select(
        "bucket", "node", "component", "bucket_size", "bucket_elements"
    )
    links = _block_links(blocks.block_pairs(rest.join(sets, "node"), "bucket", "node", BLOCK), percent)
    with small_batches(docs.sparkSession):
        second = connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("_final"))
    # left joins, in which a component of very many classes can be split
    answer = save(
        classes.select("digest", "rep", "node")
        .join(first, "node", "left")
        .select("digest", "rep", F.coalesce("component", "node").alias("component"))
        .join(second.hint("rebalance"), "component", "left")
        .select("digest", "rep", F.coalesce("_final", "component").alias("component")),
        "minhash-answer",
    )
    scratch.drop()
    # of the classes of a component, the one with the smallest id, then digest
    best = answer.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "digest")).alias("best"))
    answer = answer.join(best.hint("rebalance"), "component", "left").select(
        "digest", F.col("best.rep").alias("component_id"), (F.col("digest") == F.col("best.digest")).alias("_stays")
    )
    own = ["doc_id", "mark", "n_shingles", "digest"]
    kept = F.col("_stays") & F.col("doc_id").eqNullSafe(F.col("component_id"))
    some = rows.where("digest is not null").select(*own).join(answer, "digest").withColumn("kept", kept).drop("_stays")
    none = rows.where("digest is null").select(*own, F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return some.select(*own, "component_id", "kept").union(none)


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = shingles.WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents are linked when 100 * intersection >= percent * union of their shingle sets.
    """
    return _decisions(docs, percent, width).drop("digest", "mark")


def keep_one_of_each(docs: DataFrame, percent: int = 80, width: int = shingles.WIDTH) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; of rows equal in doc_id and shingle set, one."""
    said = save(_decisions(docs, percent, width).where("digest is not null").select("doc_id", "mark", "digest", "kept"), "minhash-decisions")
    # texts of one id with the same set: the one with the least mark stays
    texts = said.groupBy("doc_id", "digest", "mark").agg(F.count(F.lit(1)).alias("_n"), F.first("kept").alias("_kept"))
    least = F.col("mark") == F.min("mark").over(Window.partitionBy("doc_id", "digest"))
    texts = texts.select("doc_id", "mark", "_n", (F.col("_kept") & least).alias("_kept"))
    # what goes, or has several rows; all other rows stay where they are
    open_ = texts.where("_n > 1 or not _kept")
    open_ = save(open_.select(F.col("doc_id").alias("_open"), F.col("mark").alias("_open_mark"), "_kept"), "minhash-open-rows")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    rows = rows.withColumn("_id", F.col("_row.doc_id").cast("long"))
    marked = mark_probable(rows, "_id", open_.select("_open"))
    same = F.col("_id").eqNullSafe(F.col("_open")) & (F.col("_mark") == F.col("_open_mark"))
    mark = _mark(F.coalesce(F.col("_row.text"), F.lit(""))).alias("_mark")
    # only rows that may go are shuffled
    out = marked.where("not _probable").select("_row.*")
    out = out.union(marked.where("_probable").select("_row", "_id", mark).join(open_, same, "left_anti").select("_row.*"))
    again = open_.where("_kept")
    if again.isEmpty():
        return out
    again_rows = mark_probable(rows, "_id", again.select("_open")).where("_probable").select("_row", "_id", mark)
    return out.union(again_rows.join(again, same, "left_semi").dropDuplicates(["_id", "_mark"]).select("_row.*"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [list_aggregate(words, 'string_agg', ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: list_aggregate(words[i:i + 4], 'string_agg', ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * shared >= 85 * (nu.n + nv.n - shared)),
r(doc_id, id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(id) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""
