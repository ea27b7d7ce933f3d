"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

Texts are equal when they are identical after deleting every white-space character
of ``[\\x20\\x09-\\x0D]``; a null text counts as empty. Of equal texts the row with
the most code points in the original text stays, then the one with the smallest
doc_id.

Method: one pass writes (doc_id, digest, length) to the shared folder. Misra-Gries
counters (Spark's frequent-items aggregate) propose every digest with more than
``support`` of all rows; there are at most 1/support of them. The exact winner and
size of each proposed digest come from a partial aggregation, and are broadcast, so
rows of hot groups are settled map-side. All other digests, each of which has at
most ``support`` of the rows, are shuffled once for their winners, combined map-side,
and once to meet them; no group is held in memory.

Defined results: an empty table gives an empty result; null and empty and
white-space-only texts form one group; very long texts are hashed whole, inside their
scan; rows that repeat a doc_id each say whether their doc_id is the one kept; a null
doc_id stays only where all of its group, or all of the group's longest, have none; any
doc_id of a long is allowed; extra columns of any name are ignored by
:func:`exact_duplicates` and pass through :func:`drop_exact_duplicates`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mark_probable, save

#: Digests above this share of all rows are settled by broadcast; bounds it to 1/SUPPORT rows.
SUPPORT = 0.001


def _marks(doc_id: str, text: str) -> list[Column]:
    whole = F.coalesce(text, F.lit(""))
    return [
        F.col(doc_id).cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "").cast("binary"), 256)).alias("digest"),
        F.length(whole).alias("n_cp"),
    ]


def exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, keep_chars for every row of ``docs`` (doc_id, text)."""
    rows = save(docs.select(*_marks("doc_id", "text")), "digests")
    # written, as the counters depend on the order in which partitions meet and both branches must see the same digests
    names = rows.select(F.hex("digest").alias("name"))  # the counters tell strings apart, but not binaries
    frequent = names.stat.freqItems(["name"], support).select(F.explode("name_freqItems").alias("name"))
    proposed = save(frequent.select(F.unhex("name").alias("digest")), "frequent-digests")

    def winners(of: DataFrame) -> DataFrame:
        best = F.min(F.struct((-F.col("n_cp")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id"))
        return of.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))

    hot = rows.join(F.broadcast(proposed), "digest", "left_semi")
    rest = rows.join(F.broadcast(proposed), "digest", "left_anti")
    hot = hot.join(F.broadcast(winners(hot)), "digest")  # at most 1 / support digests
    rest = rest.join(winners(rest), "digest")
    keep_id = F.col("best.doc_id")
    return hot.unionByName(rest).select(
        "doc_id", keep_id.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), (-F.col("best.less")).alias("keep_chars"),
    )


def drop_exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row of each group of equal texts, with all the columns of ``docs`` (of any name); of rows equal in doc_id and length, one."""
    said = save(exact_duplicates(docs, support), "exact-decisions")
    # ids of which some row goes, or that several rows have; all other rows stay where they are
    open_ = said.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.bool_and("kept").alias("_all"))
    open_ = save(open_.where("_n > 1 or not _all").select("doc_id"), "exact-open")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    rows = mark_probable(rows.withColumn("_id", F.col("_row.doc_id").cast("long")), "_id", open_)
    kept = said.where("kept").select(
        F.col("doc_id").alias("_kept"), F.unhex("text_sha256").alias("_sha"), F.col("keep_chars").alias("_n")
    )
    held = rows.where("_probable").select("_row", *_marks("_row.doc_id", "_row.text"))
    same = held["doc_id"].eqNullSafe(kept["_kept"]) & (held["digest"] == kept["_sha"]) & (held["n_cp"] == kept["_n"])
    held = held.join(kept, same, "left_semi").dropDuplicates(["doc_id", "digest"])
    return rows.where("not _probable").select("_row.*").union(held.select("_row.*"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256,
         length(coalesce(text, '')) AS n_cp
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
       text_sha256,
       max(CAST(n_cp AS INTEGER)) OVER (PARTITION BY text_sha256) AS keep_chars
FROM d
"""
