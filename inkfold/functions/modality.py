"""Text for embedding by modality, and the modality that an identifier tells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, lines, squeeze, strip

# Commands and their words, replaced in this order.
LATEX_WORDS = {
    r"\frac": "divided by", r"\sum": "sum of", r"\int": "integral of", r"\alpha": "alpha", r"\beta": "beta",
    r"\gamma": "gamma", r"\delta": "delta", r"\lambda": "lambda", r"\mu": "mu", r"\sigma": "sigma", r"\theta": "theta",
    r"\pi": "pi", r"\infty": "infinity", r"\partial": "partial", r"\nabla": "gradient", r"\approx": "approximately equal to",
    r"\leq": "less than or equal to", r"\geq": "greater than or equal to", r"\neq": "not equal to", r"\times": "times",
    r"\cdot": "dot", r"\pm": "plus or minus", r"\rightarrow": "yields", r"\Rightarrow": "implies",
}


def formula_words(latex: Column) -> Column:
    """A LaTeX formula in words."""
    t = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(f" {kv[1]} ")), LATEX_WORDS.items(), latex)
    t = F.regexp_replace(t, r"\^\{([^}]+)\}", " to the power of $1")
    t = F.regexp_replace(t, r"(?U)\^(\w)", " to the power of $1")
    t = F.regexp_replace(t, r"_\{([^}]+)\}", " subscript $1")
    t = F.regexp_replace(t, r"(?U)_(\w)", " subscript $1")
    t = squeeze(F.translate(t, "{}", "  "))
    return F.concat(F.when(t.rlike("[a-zA-Z]{3,}"), "formula: ").otherwise("mathematical formula: "), t)


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.trim(line, F.lit("|")), "\\|"), strip)


def table_rows(markdown: Column, caption: Column | None = None) -> Column:
    """A pipe table as one text per row, each with its header names; anything else as one text. Lines, header and cells are made
    once, so the work is linear in the table."""
    caption = F.coalesce(caption, F.lit("")) if caption is not None else F.lit("")
    whole = F.array(strip(F.concat(F.lit("table: "), caption, F.lit(" "), markdown)))
    prefix = F.when(caption != "", F.concat(F.lit("table ("), caption, F.lit("): "))).otherwise(F.lit("table: "))

    def row(header: Column, cells: Column) -> Column:
        n = F.least(F.size(header), F.size(cells))
        named = F.zip_with(F.slice(header, F.lit(1), n), F.slice(cells, F.lit(1), n), lambda h, c: F.when(c != "", F.concat(h, F.lit("="), c)))
        return F.array_join(F.array_compact(named), ", ")

    def texts(ls: Column) -> Column:
        skip = F.when((F.size(ls) > 2) & F.contains(F.get(ls, F.lit(1)), F.lit("---")), 3).otherwise(2)
        cells = F.transform(F.filter(F.slice(ls, skip, F.size(ls)), lambda x: F.startswith(x, F.lit("|"))), _cells)
        rows = let(_cells(F.get(ls, F.lit(0))), lambda header: F.transform(cells, lambda c: row(header, c)))
        return F.transform(F.filter(rows, lambda r: r != ""), lambda r: F.concat(prefix, r))

    is_table = lambda ls: (F.size(ls) >= 2) & F.startswith(F.get(ls, F.lit(0)), F.lit("|"))
    rows = let(lines(markdown), lambda ls: F.when(is_table(ls), texts(ls)))
    return let(rows, lambda r: F.when(F.size(r) > 0, r).otherwise(whole))


def figure_text(caption: Column, label: Column | None = None, ocr: Column | None = None) -> Column:
    """Label, caption and recognised text of a figure: the first two joined by ``: ``."""

    def given(c: Column | None, head: str) -> Column:
        return F.lit(None).cast("string") if c is None else F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))

    parts = F.array_compact(F.array(given(label, "figure "), given(caption, ""), given(ocr, "figure content: ")))
    third = F.when(F.size(parts) > 2, F.concat(F.lit(" "), F.get(parts, F.lit(2)))).otherwise("")
    return F.when(F.size(parts) == 0, "figure").otherwise(F.concat(F.array_join(F.slice(parts, 1, 2), ": "), third))


def embedding_text(modality: Column, content: Column, clean_tables: bool = False) -> Column:
    """What is embedded for a chunk. A table row passes through the table rule a second time unless ``clean_tables``."""
    table = content if clean_tables else F.get(table_rows(content), F.lit(0))
    return (
        F.when(modality == "formula", formula_words(content))
        .when(modality == "table", table)
        .when(modality == "figure", figure_text(content))
        .otherwise(content)
    )


def modality_of_id(chunk_id: Column, rule: str = "report") -> Column:
    """The modality from the part after the last colon. Rules: ``report``; ``builder`` (with words anywhere in the
    id as a last resort); ``stats`` (without table rows)."""
    s = F.substring_index(chunk_id, ":", -1)
    c = F.when(F.startswith(s, F.lit("fig")), "figure").when(F.startswith(s, F.lit("tbl")), "table")
    if rule != "stats":
        c = c.when(s.rlike("^r[0-9]+$"), "table")
    c = c.when(s.rlike("^f[0-9]+$"), "formula")
    if rule == "builder":
        low = F.lower(chunk_id)
        c = (
            c.when(s.rlike("^c[0-9]+$"), "text")
            .when(F.contains(low, F.lit("fig")), "figure")
            .when(F.contains(low, F.lit("tbl")) | F.contains(low, F.lit("table")), "table")
        )
    return c.otherwise("text")


def paper_of_id(chunk_id: Column) -> Column:
    return F.substring_index(chunk_id, ":", 1)
