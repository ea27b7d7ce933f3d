"""From the records of different parsers to one table of elements."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formula import is_formula
from ..functions.text import strip

#: Shortest merged block, shortest formula and text, largest gap between lines of one formula.
MERGE_LENGTH, LEAST_FORMULA, LEAST_TEXT, FORMULA_GAP = 300, 10, 5, 30


def markdown_elements(docs: DataFrame) -> DataFrame:
    """paper_id, ord, text, section from (paper_id, markdown): paragraphs under the last heading block before them."""
    blocks = (
        docs.select("paper_id", F.posexplode(F.split("markdown", "\n\n")).alias("pos", "block"))
        .withColumn("block", strip(F.col("block")))
        .where("block <> ''")
    )
    by_place = Window.partitionBy("paper_id").orderBy("pos")
    heading = F.startswith("block", F.lit("#"))
    name = strip(F.regexp_replace("block", "^#+", ""))
    marked = blocks.withColumn("_heading", heading).withColumn(
        "section", F.last(F.when(heading, name), ignorenulls=True).over(by_place.rowsBetween(Window.unboundedPreceding, 0))
    )
    return marked.where("not _heading").select(
        "paper_id", (F.row_number().over(by_place) - 1).alias("ord"), F.col("block").alias("text"), "section"
    )


def structured_elements(docs: DataFrame) -> DataFrame:
    """paper_id, kind, ord, element_id, text from (paper_id, texts, tables, pictures): arrays of a structured parser.

    Blank texts go; a picture has an empty caption.
    """

    def part(kind: str, column: str, prefix: str) -> DataFrame:
        rows = docs.select("paper_id", F.posexplode(column).alias("pos", "text"))
        if kind == "text":
            rows = rows.where(strip(F.coalesce("text", F.lit(""))) != "")
        n = F.row_number().over(Window.partitionBy("paper_id").orderBy("pos")) - 1
        text = F.lit("") if kind == "figure" else F.col("text")
        return rows.select(
            "paper_id", F.lit(kind).alias("kind"), n.alias("ord"), F.concat(F.lit(prefix), n.cast("string")).alias("element_id"),
            text.alias("text"),
        )

    return part("text", "texts", "c").unionByName(part("table", "tables", "t")).unionByName(part("figure", "pictures", "fig"))


def _numbered_groups(marks: DataFrame, least: int) -> DataFrame:
    """``marks`` (paper_id, ord, length, alone) with _group, numbered from 0 in each paper.

    A running sum that starts anew is no window function: rows pass by in order, and a task holds the sum of the group that is open.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paper, group, size = object(), 0, 0
        for b in batches:
            out = []
            for p, n, alone in zip(*(b.column(c).to_pylist() for c in ("paper_id", "length", "alone"))):
                if p != paper:
                    paper, group, size = p, 0, 0
                if alone:
                    group += size > 0
                    out.append(group)
                    group, size = group + 1, 0
                else:
                    out.append(group)
                    size += n + 1
                    if size >= least:
                        group, size = group + 1, 0
            yield pa.RecordBatch.from_arrays([b.column("paper_id"), b.column("ord"), pa.array(out, pa.int64())], ["paper_id", "ord", "_group"])

    rows = marks.repartition("paper_id").sortWithinPartitions("paper_id", "ord")
    schema = T.StructType([marks.schema["paper_id"], marks.schema["ord"], T.StructField("_group", T.LongType())])
    return rows.mapInArrow(number, schema)


def merge_short_blocks(blocks: DataFrame, least: int = MERGE_LENGTH) -> DataFrame:
    """paper_id, ord, text, fonts, page, y0, y1, merged from (paper_id, ord, text, fonts, page, y0, y1).

    Short blocks of a paper are joined until they reach ``least`` characters; formulas and long blocks stand alone and
    end a run. Groups are numbered by lengths alone, in time linear in the blocks of a paper, however long a run is. Joined blocks have no page and no box.
    """
    kept = blocks.withColumn("text", strip(F.col("text"))).where("text <> ''")
    kept = kept.withColumn("_alone", is_formula(F.col("text"), F.col("fonts")) | (F.length("text") >= least))
    groups = _numbered_groups(kept.select("paper_id", "ord", F.length("text").alias("length"), F.col("_alone").alias("alone")), least)
    alone = F.max("_alone")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    one = lambda c, zero: F.when(alone, F.max(c)).otherwise(zero)
    return (
        kept.join(groups, ["paper_id", "ord"])
        .groupBy("paper_id", "_group")
        .agg(
            F.array_join(F.transform(ordered, lambda b: b["text"]), " ").alias("text"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("fonts")))).alias("fonts"),
            one("page", F.lit(0)).alias("page"), one("y0", F.lit(0.0)).alias("y0"), one("y1", F.lit(0.0)).alias("y1"),
            (~alone).alias("merged"),
        )
        .select("paper_id", F.col("_group").alias("ord"), "text", "fonts", "page", "y0", "y1", "merged")
    )


def formula_islands(blocks: DataFrame) -> DataFrame:
    """paper_id, ord, text, is_formula: neighbouring formula blocks of one page with a small gap become one.

    Gaps and islands: a row that doesn't continue the one before starts an island.
    """
    by_place = Window.partitionBy("paper_id").orderBy("ord")
    df = blocks.withColumn("text", strip(F.col("text"))).withColumn("is_formula", is_formula(F.col("text"), F.col("fonts")))
    lag = lambda c: F.lag(c).over(by_place)
    joins = (
        F.col("is_formula") & F.coalesce(lag("is_formula"), F.lit(False)) & (lag("page") == F.col("page"))
        & (F.abs(F.col("y0") - lag("y1")) < FORMULA_GAP)
    )
    df = df.withColumn("_starts", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    df = df.withColumn("_island", F.sum("_starts").over(by_place))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return df.groupBy("paper_id", "_island").agg(
        F.min("ord").alias("ord"), F.array_join(F.transform(ordered, lambda b: b["text"]), " ").alias("text"),
        F.max("is_formula").alias("is_formula"),
    ).drop("_island")


def without_fragments(islands: DataFrame) -> DataFrame:
    """paper_id, kind, ord, element_id, text: short formulas and texts go, then each kind is numbered."""
    text = strip(F.col("text"))
    kept = islands.select("paper_id", "ord", text.alias("text"), F.when(F.col("is_formula"), "formula").otherwise("text").alias("kind"))
    kept = kept.where(F.length("text") >= F.when(F.col("kind") == "formula", LEAST_FORMULA).otherwise(LEAST_TEXT))
    n = F.row_number().over(Window.partitionBy("paper_id", "kind").orderBy("ord")) - 1
    prefix = F.when(F.col("kind") == "formula", "f").otherwise("c")
    return kept.select("paper_id", "kind", n.alias("ord"), F.concat(prefix, n.cast("string")).alias("element_id"), "text")


def markdown_line_elements(docs: DataFrame) -> DataFrame:
    """paper_id, kind, ord, element_id, text from (paper_id, markdown), line by line: a formula line ends a run of text."""
    rows = (
        docs.select("paper_id", F.posexplode(F.split("markdown", "\n")).alias("pos", "line"))
        .withColumn("line", strip(F.col("line")))
        .where("line <> ''")
        .withColumn("_f", is_formula(F.col("line")))
    )
    by_place = Window.partitionBy("paper_id").orderBy("pos")
    rows = rows.withColumn("_run", F.sum(F.col("_f").cast("int")).over(by_place))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    grouped = rows.groupBy("paper_id", "_run", "_f").agg(
        F.min("pos").alias("pos"), F.array_join(F.transform(ordered, lambda b: b["line"]), " ").alias("text")
    )
    n = F.row_number().over(Window.partitionBy("paper_id", "_f").orderBy("pos")) - 1
    kind = F.when(F.col("_f"), "formula").otherwise("text")
    return grouped.select(
        "paper_id", kind.alias("kind"), n.alias("ord"), F.concat(F.when(F.col("_f"), "f").otherwise("c"), n.cast("string")).alias("element_id"), "text"
    )


def font_block_elements(blocks: DataFrame) -> DataFrame:
    """The whole path for blocks with fonts: merge, classify, join formulas, drop fragments."""
    return without_fragments(formula_islands(merge_short_blocks(blocks)))


def passed_through(figures: DataFrame, tables: DataFrame) -> DataFrame:
    """paper_id, kind, element_id, text, page of figures (.., fig_id, caption, page) and tables (.., table_id, markdown, page)."""
    return figures.select("paper_id", F.lit("figure").alias("kind"), F.col("fig_id").alias("element_id"), F.col("caption").alias("text"), "page").unionByName(
        tables.select("paper_id", F.lit("table").alias("kind"), F.col("table_id").alias("element_id"), F.col("markdown").alias("text"), "page")
    )


def ocr_elements(ocr: DataFrame, layout: DataFrame) -> DataFrame:
    """paper_id, kind, ord, element_id, text, page from text lines (paper_id, page_idx, line_no, text) and regions
    (paper_id, page_idx, region_no, label). Pages count only where both sides have them; labels must be exact."""
    pages = ocr.select("paper_id", "page_idx").distinct().join(layout.select("paper_id", "page_idx").distinct(), ["paper_id", "page_idx"])
    texts = ocr.join(pages, ["paper_id", "page_idx"], "left_semi").where(strip(F.col("text")) != "")
    regions = layout.join(pages, ["paper_id", "page_idx"], "left_semi").where(F.col("label").isin("Figure", "Table"))
    rows = texts.select("paper_id", F.lit("text").alias("kind"), "page_idx", F.col("line_no").alias("_no"), "text").unionByName(
        regions.select("paper_id", F.lower("label").alias("kind"), "page_idx", F.col("region_no").alias("_no"), F.lit("").alias("text"))
    )
    n = F.row_number().over(Window.partitionBy("paper_id", "kind").orderBy("page_idx", "_no")) - 1
    prefix = F.when(F.col("kind") == "text", "c").when(F.col("kind") == "figure", "fig").otherwise("t")
    return rows.select(
        "paper_id", "kind", n.alias("ord"), F.concat(prefix, n.cast("string")).alias("element_id"), "text", (F.col("page_idx") + 1).alias("page")
    )


def page_elements(parts: DataFrame) -> DataFrame:
    """paper_id, kind, ord, element_id, text, section of the elements of web pages (paper_id, kind, ord, text, section).

    Paragraphs, list items and loose text are text under their last heading, images are figures; titles, headings, cells and links are left out.
    """
    kinds = {"text": "text", "item": "text", "loose": "text", "image": "figure"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("kind"))
    rows = parts.where(F.col("kind").isin(*kinds)).withColumn("kind", kind)
    n = F.row_number().over(Window.partitionBy("paper_id", "kind").orderBy("ord")) - 1
    prefix = F.when(F.col("kind") == "figure", "fig").otherwise("c")
    return rows.select("paper_id", "kind", n.alias("ord"), F.concat(prefix, n.cast("string")).alias("element_id"), "text", "section")


ADAPTERS = {
    "mineru": markdown_elements, "docling": structured_elements, "pymupdf": font_block_elements, "surya": ocr_elements, "html": page_elements,
}


def adapt(records: dict[str, tuple[DataFrame, ...]]) -> DataFrame:
    """The elements of the tables of several parsers, by tag; an unknown tag is an error."""
    unknown = set(records) - set(ADAPTERS)
    if unknown:
        raise ValueError(f"unknown parser: {sorted(unknown)}")
    parts = [ADAPTERS[tag](*tables).withColumn("parser", F.lit(tag)) for tag, tables in sorted(records.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
