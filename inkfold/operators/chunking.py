"""Cutting text into overlapping chunks, and documents into chunks of every modality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.modality import table_rows
from ..functions.text import SPACE, let, strip, trimmed

#: Shortest content by modality for the optional fragment filter.
LEAST = {"text": 50, "figure": 5, "table": 10, "formula": 5}


def _steps(text: Column, size: int, overlap: int) -> Column:
    """What each window adds to the text: all of it but its last ``overlap`` characters, and all of the last window.

    One pass of a pattern over the text. Where more than ``size`` characters are left, a window ends at the last space of its
    final ``overlap`` characters, if there is one, and the next starts ``overlap`` characters before that end.
    """
    if size <= 2 * overlap:
        raise ValueError("a window must be longer than two overlaps")
    end = f".{{{size - 2 * overlap},{size - overlap - 1}}}(?=.{{{overlap}}} )|.{{{size - overlap}}}" if overlap else f".{{{size}}}"
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=.{{{size + 1}}})(?:{end})|.{{1,{size}}}"), 0)


def _sums_before(n: Column, block: int = 256) -> Column:
    """The sum of the numbers before each one: in blocks, so that no long array is copied for each of its elements."""

    def running(xs: Column, value: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("before"))
        add = lambda s, x: F.struct((s["sum"] + value(x)).alias("sum"), F.concat(s["before"], F.array(s["sum"])).alias("before"))
        return F.aggregate(xs, start, add)

    places = F.sequence(F.lit(0), F.greatest(F.floor((F.size(n) - 1) / block), F.lit(0)).cast("int"))
    parts = F.transform(places, lambda i: running(F.slice(n, i * block + 1, F.lit(block)), lambda x: x))

    def whole(p: Column) -> Column:
        first = running(p, lambda x: x["sum"])["before"]
        return F.flatten(F.zip_with(p, first, lambda x, f: F.transform(x["before"], lambda b: b + f)))

    return let(parts, whole)


def spans(text: Column, n: Column, size: int = 1200, overlap: int = 150) -> Column:
    """array<struct<s, e>> of the windows over ``text`` of ``n`` characters (0-based, end exclusive), in time linear in the text."""

    def placed(lengths: Column) -> Column:
        last = F.size(lengths) - 1
        end = lambda s, i: s + F.get(lengths, i) + F.when(i < last, overlap).otherwise(0)
        return F.transform(_sums_before(lengths), lambda s, i: F.struct(s.alias("s"), end(s, i).alias("e")))

    one = F.array(F.struct(F.lit(0).alias("s"), n.alias("e")))
    return F.when(n <= size, one).otherwise(let(F.transform(_steps(text, size, overlap), F.length), placed))


def split_text(df: DataFrame, text: str = "text", size: int = 1200, overlap: int = 150) -> DataFrame:
    """``df`` with one row per piece: ``window`` (its number in the row), ``start``, ``end``, ``piece``. Blank pieces go.

    A text that fits is kept as it is; pieces of a longer one are stripped. Nothing is shuffled, and a text is walked once.
    """
    whole = F.col("_text")

    def cut(steps: Column) -> Column:
        more = lambda i: F.coalesce(F.left(F.get(steps, i + 1), F.lit(overlap)), F.lit(""))
        begins = let(F.transform(steps, F.length), lambda n: _sums_before(n))
        piece = lambda s, t: F.struct(s.alias("s"), (s + F.length(t)).alias("e"), trimmed(t).alias("p"))
        joined = F.transform(steps, lambda t, i: F.concat(t, more(i)))
        return F.zip_with(begins, joined, piece)

    one = F.when(whole.rlike(f"[^{SPACE}]"), F.array(F.struct(F.lit(0).alias("s"), F.length(whole).alias("e"), whole.alias("p"))))
    several = F.filter(let(_steps(whole, size, overlap), cut), lambda x: x["p"] != "")
    pieces = F.when(F.length(whole) <= size, one).otherwise(several)
    return df.select("*", F.col(text).alias("_text")).select("*", F.posexplode(pieces).alias("window", "_w")).select(
        *df.columns, "window", F.col("_w.s").alias("start"), F.col("_w.e").alias("end"), F.col("_w.p").alias("piece")
    )


def text_chunks(elements: DataFrame) -> DataFrame:
    """Chunks of text elements (paper_id, ord, text, section): ids number the pieces of a paper from 0."""
    pieces = split_text(elements.select("paper_id", "ord", "text", "section"))
    n = F.row_number().over(Window.partitionBy("paper_id").orderBy("ord", "window")) - 1
    return pieces.select(
        F.concat_ws(":", "paper_id", F.concat(F.lit("c"), n.cast("string"))).alias("chunk_id"), "paper_id",
        F.lit("text").alias("modality"), F.col("piece").alias("content"), "section", F.lit(None).cast("string").alias("image_uri"),
    )


def _chunk(kind: str, suffix: Column, content: Column, image: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    return [
        F.concat_ws(":", "paper_id", suffix).alias("chunk_id"), F.col("paper_id"), F.lit(kind).alias("modality"),
        content.alias("content"), none.alias("section"), (none if image is None else image).alias("image_uri"),
    ]


def document_chunks(
    texts: DataFrame, figures: DataFrame, tables: DataFrame, formulas: DataFrame, drop_fragments: bool = False
) -> DataFrame:
    """All chunks of documents: text pieces, figures, table rows and formulas.

    texts (paper_id, ord, text, section); figures (paper_id, fig_id, caption, image_uri);
    tables (paper_id, table_id, markdown, caption); formulas (paper_id, formula_id, latex).
    """
    caption = F.when(F.coalesce("caption", F.lit("")) == "", F.concat(F.lit("Figure "), "fig_id")).otherwise(F.col("caption"))
    rows = tables.select("paper_id", "table_id", F.posexplode(table_rows(F.col("markdown"), F.col("caption"))).alias("i", "row"))
    out = (
        text_chunks(texts)
        .unionByName(figures.select(*_chunk("figure", F.col("fig_id"), caption, F.col("image_uri"))))
        .unionByName(rows.select(*_chunk("table", F.concat("table_id", F.lit(":r"), F.col("i").cast("string")), F.col("row"))))
        .unionByName(formulas.select(*_chunk("formula", F.col("formula_id"), F.col("latex"))))
    )
    return without_fragments(out) if drop_fragments else out


def without_fragments(chunks: DataFrame) -> DataFrame:
    """The chunks that are long enough for their modality."""
    least = F.lit(20)
    for kind, n in LEAST.items():
        least = F.when(F.col("modality") == kind, n).otherwise(least)
    return chunks.where(F.length(strip(F.col("content"))) >= least)
