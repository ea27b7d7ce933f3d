"""Mixing sources to target weights by hash-seeded Poisson replication.

Every source s has a mean repetition rate: its target share of the output's bytes,
times the corpus bytes, over the bytes it has. Each document gets a uniform number
from a hash of (seed, doc_id), inverts the Poisson distribution of its source's rate
with it, and is exploded into that many copies; the copies are then shuffled
globally by a hash of (seed, doc_id, copy). The same seed gives the same mixture
whatever the partitioning.

Only the per-source statistics are aggregated (partial sums, one row a source), and
written. Their size is then known: up to ``MOST_CELLS`` numbers they are broadcast, so
texts move once, in the global shuffle; beyond that they meet the documents in an
ordinary join, in which adaptive execution splits a hot source's partition.

Defined results: null source is a source of its own; a source without bytes, or with
weight 0, gives no copies; a null text counts as empty; a null doc_id hashes as the
empty string; rows that repeat a doc_id are repeated alike; a very long text weighs its
bytes and passes through whole; an empty table gives an empty result; other columns pass
through, but for those named like one of the four that are added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

SEED = 17
#: Most numbers in the broadcast table of sources (32 MB).
MOST_CELLS = 1 << 22
#: Without explicit weights, a source's target weight is its bytes to this power.
TEMPERATURE = 0.5


def _cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... of a Poisson variable until double precision holds no more."""
    out, total, k, log_fact = [], 0.0, 0, 0.0
    last = rate + 12 * math.sqrt(rate) + 40
    while k <= last:
        total += math.exp(k * math.log(rate) - rate - log_fact)
        out.append(total)
        k += 1
        log_fact += math.log(k)
    return out


def uniform(key: Column) -> Column:
    """A number in [0, 1) with 52 bits from the md5 of a string."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """_source, rate, cdf: one row a source. ``size``: bytes of output for each byte of input."""
    by = docs.groupBy(F.col("source").alias("_source")).agg(
        F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).alias("_bytes")
    )
    if weights is None:
        weight = F.pow(F.col("_bytes").cast("double"), F.lit(TEMPERATURE))
    else:
        weight = F.lit(0.0)
        for k, w in weights.items():
            weight = F.when(F.col("_source") == k, F.lit(float(w))).otherwise(weight)
    by = by.withColumn("_w", weight)
    by = save(by, "sources")
    all_w, all_bytes = by.agg(F.sum("_w"), F.sum("_bytes")).first()
    rate = F.col("_w") / F.lit(float(all_w or 1)) * F.lit(int(all_bytes or 0)) * F.lit(float(size)) / F.col("_bytes")
    rates = by.where("_bytes > 0 and _w > 0").select("_source", rate.alias("rate"))

    def tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(cdf=[_cdf(r) for r in f["rate"]])

    return rates.mapInPandas(tables, "_source string, rate double, cdf array<double>")


def _replicated(docs: DataFrame, weights: dict[str, float] | None, size: float, seed: int) -> DataFrame:
    """_row (the columns of ``docs`` as one struct), rate, copy, n_copies, shuffle_key in shuffled order."""
    rates = save(source_rates(docs, weights, size), "source-rates")
    cells = rates.agg(F.sum(F.size("cdf") + 8)).first()[0] or 0
    rates = F.broadcast(rates) if cells <= MOST_CELLS else rates
    own = F.coalesce(F.col("_row.doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    joined = rows.join(rates, F.col("_row.source").eqNullSafe(F.col("_source"))).drop("_source")
    u = uniform(F.concat(F.lit(f"{seed}:"), own))
    copies = (
        joined.withColumn("_u", u)
        .withColumn("n_copies", F.size(F.filter("cdf", lambda c: c <= F.col("_u"))))
        .where("n_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
        .drop("_u", "cdf")
        .withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}:"), own, F.lit(":"), F.col("copy").cast("string")).cast("binary")))
    )
    return copies.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key").select(
        "_row", F.round("rate", 6).alias("rate"), "copy", "n_copies", "shuffle_key"
    )


OWN = ("rate", "copy", "n_copies", "shuffle_key")


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: int = SEED
) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, source, ...) and rate, copy (from 0), n_copies, shuffle_key, in shuffled order.

    A column of ``docs`` with the name of one of these four gives way to it.
    """
    return _replicated(docs, weights, size, seed).select(*[f"_row.`{c}`" for c in docs.columns if c not in OWN], *OWN)


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: int = SEED) -> DataFrame:
    """The mixture with the columns of ``docs`` alone: a document stands there once for each of its copies."""
    return _replicated(docs, weights, size, seed).select("_row.*")


SQL = f"""
WITH s AS (SELECT source, sum(strlen(coalesce(text, ''))) AS b FROM documents GROUP BY source),
t AS (SELECT sum(pow(CAST(b AS DOUBLE), {TEMPERATURE})) AS aw, CAST(sum(b) AS DOUBLE) AS ab FROM s),
r AS (SELECT source, pow(CAST(b AS DOUBLE), {TEMPERATURE}) / aw * ab / b AS rate FROM s, t WHERE b > 0),
c AS (SELECT source, rate, list_transform(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT)),
        lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(i * ln(rate) - rate - lgamma(i + 1))))) AS cdf FROM r),
d AS (SELECT d.*, c.rate, c.cdf, CAST('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
      FROM documents d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
n AS (SELECT *, CAST(len(list_filter(cdf, lambda x: x <= u)) AS INTEGER) AS n_copies FROM d),
e AS (SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS rate, n_copies, unnest(range(0, n_copies)) AS k FROM n WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, rate, CAST(k AS INTEGER) AS copy, n_copies,
       md5('{SEED}:' || CAST(doc_id AS VARCHAR) || ':' || CAST(k AS VARCHAR)) AS shuffle_key
FROM e
"""
