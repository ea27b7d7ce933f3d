"""Takes new files of documents into a sparse index that is always ready to be searched.

    python jobs/ingest_documents.py --input DOCS --store STORE --checkpoint STATE [--config FILE]

A run works off the Parquet files of ``--input`` that no run has taken yet, in micro-batches of ``files_per_batch`` files, and ends. Each
batch becomes a segment of the index (see ``inkfold.operators.segments``); what was read is remembered in the stream's
checkpoint. A document may come again in a later file: the row with the larger ``version`` column counts, or without such a column
the later one; a true ``deleted`` column takes it out. A run that fails is started again: its last batch is read again as it was and
replaces its own partition of the store, so nothing is lost or counted twice. A run that finds nothing new writes nothing.

Written, each partitioned by batch: ``chunks``, ``postings``, ``terms``, ``versions`` and ``runs`` (rows read and written of a batch).
"""

from __future__ import annotations

import logging
import sys
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from inkfold.operators import segments
from inkfold.sources import tables
from inkfold.streaming.pipelines import file_stream
from jobs import config

log = logging.getLogger("ingest_documents")
CONFIG = Path(__file__).with_suffix(".json")
DEFAULTS = {"files_per_batch": 8, "size": 1200, "overlap": 150, "id": "doc_id", "text": "text", "version": None, "deleted": None}
RUNS = "rows_read long, documents long, chunks long, postings long, batch long"


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str, settings: dict | None = None) -> int:
    """Works off the new files of ``source``; returns how many batches it wrote."""
    s = DEFAULTS | (settings or {})
    segments.create(spark, store)
    schema = spark.read.parquet(source).schema
    source = source.rstrip("/")
    # as a pattern that only fits itself, as a stream takes folders or patterns, but no path of one file
    stream = file_stream(spark, f"{source[:-1]}[{source[-1]}]", schema, s["files_per_batch"])
    named = stream.select(
        F.col(s["id"]).alias("doc_id"), F.col(s["text"]).alias("text"), F.col(s["version"]).cast("long").alias("version") if s["version"] else F.lit(0).cast("long").alias("version"),
        F.col(s["deleted"]).cast("boolean").alias("deleted") if s["deleted"] else F.lit(False).alias("deleted"),
    )
    written = []

    def take(docs: DataFrame, batch: int) -> None:
        own = docs.sparkSession
        segments.write_segment(docs, store, batch, s["size"], s["overlap"])
        n = {t: segments.read(own, store, t).where(F.col("batch") == batch).count() for t in ("versions", "chunks", "postings")}
        row = [(docs.count(), n["versions"], n["chunks"], n["postings"], batch)]
        out = own.createDataFrame(row, RUNS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("batch").parquet(f"{store}/runs")
        log.info("batch %d: read %d rows of %s; wrote %d documents, %d chunks, %d postings to %s", batch, row[0][0], source, *row[0][1:4], store)
        written.append(batch)

    query = named.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%d new batches from %s", len(written), source)
    return len(written)


def job1_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the store after two runs over the whole documents, with what the postings say of each."""
    folder = f"{tables.root(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        ingest(spark, f"{sf_dir}/documents.parquet", f"{folder}/store", f"{folder}/checkpoint")
    chunks = segments.live_chunks(spark, f"{folder}/store")
    known = segments.live_versions(spark, f"{folder}/store").select("doc_id", "batch")
    counts = segments.read(spark, f"{folder}/store", "postings").join(known, ["doc_id", "batch"], "left_semi")
    counts = counts.groupBy("doc_id", "window").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_counted"))
    return chunks.join(counts, ["doc_id", "window"], "left").select("chunk_id", "doc_id", "window", "content", "dl", "n_terms", "n_counted")


def main() -> None:
    args = config.arguments(__doc__.split("\n")[0], CONFIG, input="folder of Parquet files", store="folder of the index", checkpoint="folder of the stream's state")
    settings = config.load(args.config, DEFAULTS)
    spark = config.session("ingest_documents")
    try:
        ingest(spark, args.input, args.store, args.checkpoint, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
