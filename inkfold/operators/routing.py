"""Which parser a document goes to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Pages looked at, characters a page of a scan has at most, and the formula share that calls for the formula parser.
SAMPLE_PAGES, SCANNED_BELOW, FORMULA_ABOVE = 3, 50, 0.05
MARKS = (r"\frac", r"\sum", "_{", "^{", r"\int")


def route(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """paper_id, scanned, formula_density, parser from (paper_id) and pages (paper_id, page_no from 0, text).

    One aggregation over the first pages; a document without pages counts as scanned.
    """
    marked = lambda line: F.exists(F.array(*[F.lit(m) for m in MARKS]), lambda m: F.contains(line, m))
    in_lines = F.aggregate(
        F.filter(F.split("text", "\n"), marked), F.lit(0).cast("long"), lambda s, line: s + F.length(line)
    )
    first = pages.where(F.col("page_no") < SAMPLE_PAGES).groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("_pages"), F.sum(F.length(strip(F.col("text")))).alias("_stripped"),
        F.sum(in_lines).alias("_marked"), F.sum(F.length("text")).alias("_all"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    scanned = zero("_stripped") / F.greatest(zero("_pages"), F.lit(1)) < SCANNED_BELOW
    density = zero("_marked") / F.greatest(zero("_all"), F.lit(1))
    parser = F.when(F.col("scanned"), "surya").when(F.col("formula_density") > FORMULA_ABOVE, "mineru").otherwise("docling")
    return (
        docs.select("paper_id")
        .join(first, "paper_id", "left")
        .select("paper_id", scanned.alias("scanned"), density.alias("formula_density"))
        .withColumn("parser", parser)
    )
