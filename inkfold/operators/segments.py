"""A sparse index that grows by segments: new, changed and deleted documents without a rebuild.

A batch of documents becomes a segment, a partition ``batch=N`` of four Parquet tables in one folder:

- ``chunks`` (doc_id, window, chunk_id, content, dl),
- ``postings`` (doc_id, window, dl, term, tf), clustered by term,
- ``terms`` (term, df): how many chunks of the segment have a term,
- ``versions`` (doc_id, version, deleted, n_chunks, n_words): a row for each document of the batch.

Of the rows of a document the one with the largest (version, batch) is live; it hides all others, and with ``deleted`` itself.
Nothing is rewritten: a search leaves out the postings of hidden rows, and statistics are merged, the sum over the segments less
what the hidden rows count. Writing a batch again replaces its own partition with the same rows, so a batch that is
replayed after a failure changes nothing.

Defined results: a row without doc_id is left out; of rows of one batch with the same doc_id the one with the largest version
counts, then the longest text, then the last in the order of texts; a null text is a document without chunks; a null version is
the smallest; an empty batch writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_counts
from ..sources.tables import files_for, stored
from .chunking import split_text
from .retrieval import SparseIndex, weighted_terms

SCHEMAS = {
    "chunks": "doc_id long, window int, chunk_id string, content string, dl int, batch long",
    "postings": "doc_id long, window int, dl int, term string, tf long, batch long",
    "terms": "term string, df long, batch long",
    "versions": "doc_id long, version long, deleted boolean, n_chunks long, n_words long, batch long",
}


def create(spark: SparkSession, store: str) -> None:
    """Makes the tables that aren't there; those that are stay as they are."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(f"{store}/{name}")


def read(spark: SparkSession, store: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{store}/{name}")


def _put(df: DataFrame, store: str, name: str, batch: int) -> None:
    names = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    out = df.withColumn("batch", F.lit(batch).cast("long")).select(*names)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{store}/{name}")


def write_segment(docs: DataFrame, store: str, batch: int, size: int = 1200, overlap: int = 150, files: int = 4) -> None:
    """``docs`` (doc_id, text, version, deleted) as the segment ``batch``; its postings go to ``files`` files, or as many as their number asks for.

    A text is cut and tokenized once; only the newest row of each document of the batch meets others by a shuffle.
    """
    own = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("version").cast("long").alias("version"), F.coalesce("deleted", F.lit(False)).alias("deleted")
    )
    newest = F.struct("version", F.length("text").alias("n"), "text", "deleted")
    own = stored(own.groupBy("doc_id").agg(F.max(newest).alias("_r")).select("doc_id", "_r.*"), "segment-rows")
    pieces = split_text(own.where("not deleted").select("doc_id", "text"), size=size, overlap=overlap)
    pieces = pieces.select("doc_id", "window", F.col("piece").alias("content"), word_counts(F.col("piece")).alias("_w"))
    chunk_id = F.concat(F.col("doc_id").cast("string"), F.lit(":c"), F.col("window").cast("string"))
    pieces = stored(pieces.select("doc_id", "window", chunk_id.alias("chunk_id"), "content", F.col("_w.dl").alias("dl"), F.col("_w.t").alias("_t")), "segment-chunks")
    postings = pieces.select("doc_id", "window", "dl", F.inline("_t"))
    postings = postings.select("doc_id", "window", "dl", F.col("value").alias("term"), F.col("n").cast("long").alias("tf"))
    counts = pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("dl").alias("n_words"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    versions = own.join(counts, "doc_id", "left").select("doc_id", "version", "deleted", zero("n_chunks"), zero("n_words"))
    _put(pieces.drop("_t"), store, "chunks", batch)
    n = pieces.agg(F.coalesce(F.sum(F.size("_t")), F.lit(0))).first()[0]
    _put(postings.repartitionByRange(files_for(n, files), "term").sortWithinPartitions("term"), store, "postings", batch)
    _put(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), store, "terms", batch)
    _put(versions, store, "versions", batch)  # last: a segment without versions has no live row


def _with_newest(spark: SparkSession, store: str) -> DataFrame:
    """The rows of ``versions`` with ``_live``: whether a row is the newest of its document and isn't deleted."""
    rows = read(spark, store, "versions")
    place = F.struct("version", "batch")
    newest = rows.groupBy("doc_id").agg(F.max(place).alias("_newest"))
    return rows.join(newest, "doc_id").withColumn("_live", (place == F.col("_newest")) & ~F.col("deleted"))


def live_versions(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, version, n_chunks, n_words, batch of the documents that are there."""
    return _with_newest(spark, store).where("_live").select("doc_id", "version", "n_chunks", "n_words", "batch")


def hidden(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, batch whose rows don't count any more: as many as there were changes, which is why they, not the live ones, are looked up."""
    return _with_newest(spark, store).where("not _live").select("doc_id", "batch")


def live_chunks(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, window, chunk_id, content, dl, batch of the documents that are there. A chunk whose segment has no versions yet isn't."""
    known = live_versions(spark, store).select("doc_id", "batch")
    return read(spark, store, "chunks").join(known, ["doc_id", "batch"], "left_semi")


def index(spark: SparkSession, store: str) -> SparseIndex:
    """The live rows as an index for :func:`retrieval.search_sparse`; ``ord`` is the pair of document and window.

    Document frequencies come from the segments' own tables of terms, less the postings of hidden rows; numbers of chunks and words from
    the live versions. So statistics read each segment's terms, not its postings.
    """
    gone = stored(hidden(spark, store), "segment-hidden")
    ord_ = F.struct("doc_id", "window").alias("ord")
    postings = read(spark, store, "postings")
    lost = postings.join(gone, ["doc_id", "batch"], "left_semi").select("term", F.lit(-1).cast("long").alias("df"))
    df = read(spark, store, "terms").select("term", "df").unionByName(lost).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    totals = live_versions(spark, store).agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_docs"), F.sum("n_words").alias("_w"))
    stats = stored(totals.select("n_docs", F.try_divide("_w", "n_docs").alias("avgdl")), "segment-stats")
    return SparseIndex(
        postings.join(gone, ["doc_id", "batch"], "left_anti").select(ord_, "dl", "term", "tf"), weighted_terms(stored(df, "segment-terms"), stats), stats,
        live_chunks(spark, store).select(ord_, "chunk_id"),
    )


def compact(spark: SparkSession, store: str, to: str, files: int = 4) -> int:
    """The live rows of ``store`` as one segment of the new folder ``to``; returns its batch, the largest one so far.

    The old folder stays as it is, so searches on it go on; a writer continues on ``to`` with larger batches.
    """
    batch = read(spark, store, "versions").agg(F.max("batch")).first()[0]
    create(spark, to)
    if batch is None:
        return -1
    gone = stored(hidden(spark, store), "segment-hidden")
    postings = read(spark, store, "postings").join(gone, ["doc_id", "batch"], "left_anti")
    _put(live_chunks(spark, store), to, "chunks", batch)
    _put(postings.repartitionByRange(files_for(postings.count(), files), "term").sortWithinPartitions("term"), to, "postings", batch)
    _put(read(spark, to, "postings").groupBy("term").agg(F.count(F.lit(1)).alias("df")), to, "terms", batch)
    _put(live_versions(spark, store).withColumn("deleted", F.lit(False)), to, "versions", batch)
    return batch
