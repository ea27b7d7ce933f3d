"""Evaluates hybrid search under several fusion weights, to choose the one to run with.

    python jobs/sweep_fusion.py --documents DOCS --questions QUESTIONS --output OUT [--config FILE]

Documents (doc_id, text) are cut into chunks and indexed; a question (item_id, text) has as gold the chunks that hold its whole text, and
is unanswerable without any. Both lists of hits are made once, ``depth`` deep, and fused again for each weight of the dense list in
``alphas``; recall and reciprocal rank are taken at ``k``.

Written: ``cases``, partitioned by alpha (query_id, answerable, n_gold, recall, rr, best_id), and ``summary`` (alpha, n_cases, n_answerable,
recall, mrr), one row for each weight. A run replaces both as a whole, so it can be started again at any time with the same result.
"""

from __future__ import annotations

import logging
import sys
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from inkfold.operators import evaluate, retrieval
from inkfold.operators.chunking import split_text
from inkfold.sources import tables
from jobs import config

log = logging.getLogger("sweep_fusion")
CONFIG = Path(__file__).with_suffix(".json")
DEFAULTS = {"alphas": [0.0, 0.3, 0.5, 0.7, 0.9, 1.0], "k": 5, "depth": 10}


def sweep(spark: SparkSession, documents: str, questions: str, output: str, settings: dict | None = None) -> None:
    """Writes ``cases`` and ``summary`` under ``output``."""
    s = DEFAULTS | (settings or {})
    docs = spark.read.parquet(documents).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunk_id = F.concat(F.col("doc_id").cast("string"), F.lit(":c"), F.col("window").cast("string")).alias("chunk_id")
    # blocked products name rows by a number, in the order of the documents; those are sorted, not their chunks, which are then written once
    pieces = split_text(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id"))
    chunks = tables.stored(pieces.select(chunk_id, F.monotonically_increasing_id().alias("ord"), F.col("piece").alias("content")), "sweep-corpus")
    asked = tables.stored(spark.read.parquet(questions).select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), "sweep-questions")
    log.info("read %d chunks of %s and %d questions of %s", chunks.count(), documents, asked.count(), questions)
    gold = evaluate.gold_by_passage(chunks, asked).groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("gold"))
    cases = tables.stored(asked.join(gold, "query_id", "left").select("query_id", F.coalesce("gold", F.array().cast("array<string>")).alias("gold")), "sweep-cases")
    dense = tables.stored(retrieval.search_hashed(chunks, asked, s["depth"]), "sweep-dense")
    sparse = tables.stored(retrieval.search_sparse(retrieval.build_sparse(chunks), asked, s["depth"]), "sweep-sparse")

    def under(alpha: float) -> DataFrame:
        hits = retrieval.fuse(dense, sparse, s["k"], alpha)
        return hits.select("query_id", "rank", "chunk_id").withColumn("alpha", F.lit(float(alpha)))

    hits = reduce(DataFrame.unionByName, map(under, s["alphas"]))
    found = hits.groupBy("alpha", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda h: h["chunk_id"]).alias("ids"))
    every = spark.createDataFrame([(float(a),) for a in s["alphas"]], "alpha double").join(cases, F.lit(True))
    rows = every.join(found, ["alpha", "query_id"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    rows = rows.select(
        "alpha", "query_id", (F.size("gold") > 0).alias("answerable"), F.size("gold").alias("n_gold"), evaluate.recall_at(F.col("ids"), F.col("gold"), s["k"]).alias("recall"),
        evaluate.reciprocal_rank(F.col("ids"), F.col("gold")).alias("rr"), F.get("ids", F.lit(0)).alias("best_id"),
    )
    rows.repartition("alpha").write.mode("overwrite").partitionBy("alpha").parquet(f"{output}/cases")
    means = spark.read.parquet(f"{output}/cases").groupBy("alpha").agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_if("answerable").alias("n_answerable"), F.avg("recall").alias("recall"), F.avg(F.when(F.col("answerable"), F.col("rr"))).alias("mrr")
    )
    means.coalesce(1).write.mode("overwrite").parquet(f"{output}/summary")  # a row for each weight
    for r in spark.read.parquet(f"{output}/summary").orderBy("alpha").collect():
        log.info("wrote %d cases to %s/cases/alpha=%s: recall %s, MRR %s", r.n_cases, output, r.alpha, r.recall, r.mrr)


def job2_sweep_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases under all weights after two runs over the whole tables."""
    output = f"{tables.root(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        sweep(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", output)
    rows = spark.read.parquet(f"{output}/cases").withColumn("alpha", F.col("alpha").cast("double"))
    return rows.select("alpha", "query_id", "answerable", "n_gold", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"), "best_id")


def main() -> None:
    args = config.arguments(__doc__.split("\n")[0], CONFIG, documents="Parquet files of documents", questions="Parquet files of questions", output="folder to write")
    settings = config.load(args.config, DEFAULTS)
    spark = config.session("sweep_fusion")
    try:
        sweep(spark, args.documents, args.questions, args.output, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
