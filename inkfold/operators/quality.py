"""Data-quality flags, distributions and the report object of a chunk corpus (chunk_id, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.modality import modality_of_id, paper_of_id

MODALITIES = ("text", "figure", "table", "formula")
#: Share of odd characters, shortest chunk, longest formula-like fragment, edges of the histograms.
GARBLED_ABOVE, FRAGMENT_BELOW, FORMULA_LIKE_BELOW = 0.3, 50, 300
EDGES_4, EDGES_5 = (100, 500, 1200), (100, 500, 1200, 2000)


def garbled(c: Column, empty: bool = True) -> Column:
    """More than 30 % of the characters aren't ASCII; an empty text counts as ``empty``."""
    odd = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    return F.when(F.length(c) == 0, F.lit(empty)).otherwise(odd / F.length(c) > GARBLED_ABOVE)


def fragment(c: Column) -> Column:
    return F.length(c) < FRAGMENT_BELOW


def formula_like(c: Column) -> Column:
    marks = F.array(*[F.lit(m) for m in ("^{", "_{", r"\frac", r"\sum")])
    return F.exists(marks, lambda m: F.contains(c, m)) & (F.length(c) < FORMULA_LIKE_BELOW)


def odd_paper_id(paper_id: Column) -> Column:
    return ~F.startswith(paper_id, F.lit("2"))


def modality_distribution(chunks: DataFrame) -> DataFrame:
    """modality, n, share for the four modalities, those without chunks too."""
    counts = chunks.groupBy(modality_of_id(F.col("chunk_id")).alias("modality")).agg(F.count(F.lit(1)).alias("n"))
    fixed = chunks.sparkSession.createDataFrame([(m,) for m in MODALITIES], "modality string")
    rows = fixed.join(counts, "modality", "left")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_all"))
    return rows.join(F.broadcast(whole), F.lit(True)).select(
        "modality", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), "_all"), F.lit(0.0)).alias("share")
    )


def per_paper(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(paper_of_id(F.col("chunk_id")).alias("paper_id")).agg(F.count(F.lit(1)).alias("n_chunks"))


def per_paper_stats(chunks: DataFrame) -> DataFrame:
    n = F.col("n_chunks")
    return per_paper(chunks).agg(
        F.count(F.lit(1)).alias("n_papers"), F.avg(n).alias("avg_chunks"), F.max(n).alias("max_chunks"), F.min(n).alias("min_chunks")
    )


def length_stats(chunks: DataFrame, text_only: bool = True) -> DataFrame:
    """n, min_len, max_len and the floor of the mean length."""
    rows = chunks.where(modality_of_id(F.col("chunk_id")) == "text") if text_only else chunks
    n = F.length("content")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.min(n).alias("min_len"), F.max(n).alias("max_len"),
        F.when(F.count(F.lit(1)) > 0, F.floor(F.sum(n) / F.count(F.lit(1)))).cast("long").alias("avg_len"),
    )


def length_histogram(chunks: DataFrame, edges: tuple[int, ...] = EDGES_4) -> DataFrame:
    """bucket (from 0), n: chunks by length, empty buckets too."""
    n = F.length("content")
    bucket = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        bucket = F.when(n < edges[i], i).otherwise(bucket)
    counts = chunks.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    all_ = chunks.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bucket"))
    return all_.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def report(chunks: DataFrame) -> DataFrame:
    """One row: totals, anomalies, and the modality distribution as a map."""
    c = F.col("content")
    totals = chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct(paper_of_id(F.col("chunk_id"))).alias("n_papers"),
        F.count_if(garbled(c)).alias("n_garbled"), F.count_if(fragment(c)).alias("n_fragments"),
        F.count_if(formula_like(c)).alias("n_formula_like"),
        F.count_if(odd_paper_id(paper_of_id(F.col("chunk_id")))).alias("n_odd_ids"),
    )
    by = modality_distribution(chunks).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("modality", "n")))).alias("modalities"))
    return totals.join(F.broadcast(by), F.lit(True)).select(
        F.struct("n_chunks", "n_papers").alias("totals"), "modalities",
        F.struct("n_garbled", "n_fragments", "n_formula_like", "n_odd_ids").alias("anomalies"),
    )


def head_sample(chunks: DataFrame, n: int = 5, cut: int = 300) -> DataFrame:
    """chunk_id, length, head of the first n chunks, for a look at them."""
    first = chunks.orderBy("ord").limit(n)
    return first.select("chunk_id", F.length("content").alias("length"), F.substring("content", 1, cut).alias("head"))
