"""Page layout: columns, reading order, captions and regions.

Blocks are rows (paper_id, page_no, block_no, text, x0, y0, x1, y1); a page is
(paper_id, page_no), and every join and window here is keyed by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

PAGE = ["paper_id", "page_no"]
CAPTION = r"(?i)^\s*(?:figure|fig\.?|table|tab\.?)\s*(\d+)[.:\s]"
#: Least bytes of an image, furthest distance of a caption, its longest text.
LEAST_IMAGE_BYTES, CAPTION_DISTANCE, CAPTION_LENGTH = 5000, 250, 800


def page_blocks(spans: DataFrame) -> DataFrame:
    """Blocks from spans (paper_id, page_no, block_no, span_no, kind, text, font, x0..y1): the text blocks that aren't blank.

    ``text`` joins the spans with a space for layout; ``font_text`` joins them without, for font rules, with distinct ``fonts``.
    """
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("span_no", c))), lambda s: s[c])
    return (
        spans.where("kind = 0")
        .groupBy(*PAGE, "block_no")
        .agg(
            strip(F.array_join(ordered("text"), " ")).alias("text"),
            strip(F.array_join(ordered("text"), "")).alias("font_text"),
            F.array_sort(F.collect_set(F.when(F.col("font") != "", F.col("font")))).alias("fonts"),
            *[F.max(c).alias(c) if c in ("x1", "y1") else F.min(c).alias(c) for c in ("x0", "y0", "x1", "y1")],
        )
        .where("text <> ''")
    )


def two_column_pages(blocks: DataFrame, width: str = "width", bins: int = 20) -> DataFrame:
    """paper_id, page_no, n_blocks, two_column: a histogram of block centres with two peaks and a valley.

    A centre left of the page counts in the first bin.
    """
    center = (F.col("x0") + F.col("x1")) / 2
    place = F.greatest(F.lit(0), F.least((center / F.col(width) * bins).cast("int"), F.lit(bins - 1)))
    by_bin = blocks.withColumn("_bin", place).groupBy(*PAGE, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    at = lambda a, b: F.when(F.col("_bin").between(a, b), F.col("_n"))
    half = bins // 2
    left = F.coalesce(F.max(at(0, half - 3)), F.lit(0))
    right = F.coalesce(F.max(at(half + 2, bins - 1)), F.lit(0))
    middle = F.coalesce(F.sum(at(half - 2, half + 1)), F.lit(0)) / 4
    peaks = F.when(F.col("_m") == 0, (F.col("_l") > 0) & (F.col("_r") > 0)).otherwise(
        (F.col("_l") > 2 * F.col("_m")) & (F.col("_r") > 2 * F.col("_m"))
    )
    return (
        by_bin.groupBy(*PAGE)
        .agg(F.sum("_n").alias("n_blocks"), left.alias("_l"), right.alias("_r"), middle.alias("_m"))
        .select(*PAGE, "n_blocks", ((F.col("n_blocks") >= 4) & peaks).alias("two_column"))
    )


def reading_order(blocks: DataFrame, width: str = "width") -> DataFrame:
    """``blocks`` with two_column, zone (0 top, 1 middle, 2 left, 3 right, 4 bottom; 0 on one-column pages) and order (from 0)."""
    pages = two_column_pages(blocks, width).select(*PAGE, "two_column")
    page = Window.partitionBy(*PAGE)
    center, mid = (F.col("x0") + F.col("x1")) / 2, F.col(width) / 2
    side = F.when(F.col("x1") - F.col("x0") > F.col(width) * 0.6, "span").when(center < mid, "left").otherwise("right")
    df = blocks.join(pages, PAGE).withColumn("_side", side)
    left = lambda f, c: f(F.when(F.col("_side") == "left", F.col(c))).over(page)
    above = F.coalesce(left(F.min, "y0"), F.lit(0.0))
    below = F.coalesce(left(F.max, "y1"), F.lit(float("inf")))
    zone = (
        F.when(~F.col("two_column"), 0)
        .when(F.col("_side") == "left", 2)
        .when(F.col("_side") == "right", 3)
        .when(F.col("y1") < above, 0)
        .when(F.col("y0") > below, 4)
        .otherwise(1)
    )
    line = F.when(F.col("two_column"), F.col("y0")).otherwise(F.bround(F.col("y0") / 10))
    across = F.when(F.col("two_column"), F.lit(0.0)).otherwise(F.col("x0").cast("double"))
    df = df.withColumn("zone", zone).withColumn("_line", line).withColumn("_across", across)
    order = Window.partitionBy(*PAGE).orderBy("zone", "_line", "_across", "block_no")
    return df.withColumn("order", F.row_number().over(order) - 1).drop("_side", "_line", "_across")


def page_texts(ordered: DataFrame) -> DataFrame:
    """paper_id, page_no, text: the blocks of a page in reading order, joined by newlines."""
    blocks = F.array_sort(F.collect_list(F.struct("order", "text")))
    return ordered.groupBy(*PAGE).agg(F.array_join(F.transform(blocks, lambda b: b["text"]), "\n").alias("text"))


def large_images(images: DataFrame) -> DataFrame:
    return images.where(F.col("n_bytes") > LEAST_IMAGE_BYTES)


def _band(y: Column) -> Column:
    return F.floor(y / CAPTION_DISTANCE)


def captions_below(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """paper_id, page_no, img_idx, caption, distance: the nearest caption block under a rectangle of the image.

    images: one row per rectangle (paper_id, page_no, img_idx, rect_no, ix0, iy0, ix1, iy1). Pages are cut into bands as high as the
    largest distance: a rectangle looks into the two bands that a caption below it can begin in, a block is in one, so each pair
    meets once, and a page of very many blocks is many keys. The geometry is the residual condition; ties go to the first (rectangle, block).
    """
    texts = blocks.where(F.col("text").rlike(CAPTION)).select(*PAGE, _band(F.col("y0")).alias("_band"), "block_no", "text", "x0", "y0", "x1")
    images = images.withColumn("_band", F.explode(F.array(_band(F.col("iy1")), _band(F.col("iy1")) + 1)))
    near = (
        (F.col("y0") >= F.col("iy1")) & (F.col("y0") - F.col("iy1") <= CAPTION_DISTANCE)
        & (F.col("x1") >= F.col("ix0")) & (F.col("x0") <= F.col("ix1"))
    )
    first = F.min(F.struct((F.col("y0") - F.col("iy1")).alias("d"), "rect_no", "block_no", "text"))
    return (
        images.join(texts, [*PAGE, "_band"])
        .where(near)
        .groupBy(*PAGE, "img_idx")
        .agg(first.alias("_c"))
        .select(*PAGE, "img_idx", strip(F.substring("_c.text", 1, CAPTION_LENGTH)).alias("caption"), F.col("_c.d").alias("distance"))
    )


def caption_in_text(page_text: Column, multiline: bool = False) -> Column:
    """The caption at the start of a page's text (of any line with ``multiline``) up to the line's end; '' without one."""
    pattern = CAPTION.replace("(?i)", "(?im)") if multiline else CAPTION
    start = F.regexp_instr(page_text, F.lit(pattern)) if multiline else F.lit(1)
    snippet = F.substr(page_text, start, F.lit(CAPTION_LENGTH))
    line = F.get(F.split(snippet, "\n"), F.lit(0))
    return F.when(page_text.rlike(pattern), strip(line)).otherwise("")


def figure_captions(images: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """paper_id, page_no, img_idx, caption: the nearest caption below, else the one that opens the page's text."""
    keys = images.select(*PAGE, "img_idx").distinct()
    below = captions_below(images, blocks)
    return (
        keys.join(below, [*PAGE, "img_idx"], "left")
        .join(pages.select(*PAGE, F.col("text").alias("_text")), PAGE, "left")
        .select(
            *PAGE, "img_idx",
            F.coalesce(F.nullif("caption", F.lit("")), caption_in_text(F.coalesce("_text", F.lit("")))).alias("caption"),
        )
    )


def region_texts(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """paper_id, page_no, region_no, n_lines, text: lines whose centre lies in the region's box, top to bottom.

    regions (.., region_no, rx0, ry0, rx1, ry1); lines (.., line_no, text, x0, y0, x1, y1). A line may lie in several regions. A
    region looks into all bands of the page that it reaches, a line is in that of its centre.
    """
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = cx.between(F.col("rx0"), F.col("rx1")) & cy.between(F.col("ry0"), F.col("ry1"))
    found = F.array_sort(F.collect_list(F.struct("y0", "line_no", "text")))
    hits = (
        regions.where("ry0 <= ry1").withColumn("_band", F.explode(F.sequence(_band(F.col("ry0")), _band(F.col("ry1")))))
        .join(lines.withColumn("_band", _band(cy)), [*PAGE, "_band"])
        .where(inside)
        .groupBy(*PAGE, "region_no")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(found, lambda s: s["text"]), " ").alias("text"))
    )
    return regions.select(*PAGE, "region_no").join(hits, [*PAGE, "region_no"], "left").select(
        *PAGE, "region_no", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("text", F.lit("")).alias("text")
    )
