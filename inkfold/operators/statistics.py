"""Corpus statistics that merge: kept for each batch of chunks, and added up without another look at the chunks.

Counts, extremes and histograms are exact. Quantiles of lengths are KLL sketches and numbers of papers HyperLogLog sketches, both
Spark's own: the rank of a quantile is off by less than 2 % of the chunks, a number of papers by less than 5 %, whatever the number of batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.modality import modality_of_id, paper_of_id
from .quality import EDGES_5

#: Accuracy of the sketches: k of KLL, log2 of the registers of HyperLogLog.
KLL_K, HLL_BITS = 400, 14
RANK_ERROR, PAPER_ERROR = 0.02, 0.05


def _bucket(n, edges: tuple[int, ...]):
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(n < edges[i], i).otherwise(out)
    return out


def of_batch(chunks: DataFrame, *by: str, edges: tuple[int, ...] = EDGES_5) -> DataFrame:
    """One row for each modality of a batch of chunks (chunk_id, content): modality, n_chunks, n_chars, min_len, max_len, histogram, lengths,
    papers. With columns ``by``, of each of the batches that they tell apart."""
    n = F.length(F.coalesce("content", F.lit(""))).cast("long")
    rows = chunks.select(*by, modality_of_id(F.col("chunk_id")).alias("modality"), paper_of_id(F.col("chunk_id")).alias("_paper"), n.alias("_n"))
    return rows.groupBy(*by, "modality").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("_n").alias("n_chars"), F.min("_n").alias("min_len"), F.max("_n").alias("max_len"),
        F.array(*[F.count_if(_bucket(F.col("_n"), edges) == i) for i in range(len(edges) + 1)]).alias("histogram"),
        F.kll_sketch_agg_bigint("_n", F.lit(KLL_K)).alias("lengths"), F.hll_sketch_agg("_paper", F.lit(HLL_BITS)).alias("papers"),
    )


def merged(batches: DataFrame) -> DataFrame:
    """The rows of any number of batches as one for each modality; a merged row merges again."""
    width = len(EDGES_5) + 1
    add = lambda i: F.sum(F.get("histogram", F.lit(i)))
    return batches.groupBy("modality").agg(
        F.sum("n_chunks").alias("n_chunks"), F.sum("n_chars").alias("n_chars"), F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"),
        F.array(*[add(i) for i in range(width)]).alias("histogram"), F.kll_merge_agg_bigint("lengths", F.lit(KLL_K)).alias("lengths"),
        F.hll_union_agg("papers").alias("papers"),
    )


def estimates(rows: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """The exact columns of :func:`merged` rows, avg_len, an estimated n_papers, and quantiles (an array in the order asked)."""
    return rows.select(
        "modality", "n_chunks", "n_chars", "min_len", "max_len", "histogram", F.floor(F.col("n_chars") / F.col("n_chunks")).alias("avg_len"),
        F.hll_sketch_estimate("papers").alias("n_papers"), F.array(*[F.kll_sketch_get_quantile_bigint("lengths", F.lit(q)) for q in quantiles]).alias("quantiles"),
    )
