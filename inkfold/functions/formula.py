"""Formula recognition as one decision list of column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import count_of, strip

# Alternatives of a math font's name, symbol sets and common words.
MATH_FONTS = [
    "cmr", "cmmi", "cmsy", "cmex", "cmbx", "cmti", "cmss", "cmb", "cmdunh", "symbol", "mtextra", "stix", "stixgeneral", "mathjax", "mtmi",
    "mtsy", "mtm", "mtext", "euclid", "euler", "rsfs", "math",
]
STRONG = "∫∑∏√∛±×÷∂∇∞≈≠≤≥≡∝∈∉⊂⊃∪∩∀∃∅→←⇒⇔↦⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉"
SYMBOLS = "∫∑∏√∛±×÷∂∇∞≈≠≤≥≡∝∈∉⊂⊃∪∩∀∃∅→←⇒⇔↦⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉αβγδεζηθικλμνξπρστυφχψωΓΔΘΛΞΠΣΦΨΩ↑↓"
ASCII_MATH = "=+-*/^_(){}[]<>|"
COMMON_WORDS = [
    "the", "is", "are", "was", "were", "we", "this", "that", "these", "those", "and", "or", "with", "from", "have", "has", "had", "been",
    "which", "what", "how", "does", "do", "did", "can", "could", "will", "would", "not", "but", "all", "any", "one", "two", "a", "an", "of",
    "to", "in", "on", "for", "by", "as", "at",
]
LATEX = r"\\[a-zA-Z]+|\^\{|_\{"


def is_math_font(name: Column) -> Column:
    """Whether a font's name contains one of the alternatives, in any case; null is no."""
    return F.coalesce(F.lower(name).rlike("|".join(MATH_FONTS)), F.lit(False))


def common_words(text: Column) -> Column:
    """How many of the common words stand in the text between single spaces."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.size(F.filter(F.array(*[F.lit(f" {w} ") for w in COMMON_WORDS]), lambda w: F.contains(padded, w)))


def is_formula(text: Column, fonts: Column | None = None) -> Column:
    """Whether a block of text is a formula; the first rule that fits decides. Null text is no formula."""
    t = strip(F.coalesce(text, F.lit("")))
    n = F.length(t)
    runs = F.size(F.regexp_extract_all(t, F.lit("([a-zA-Z]{4,})"), 1))
    fonts = F.coalesce(fonts, F.array().cast("array<string>")) if fonts is not None else F.array().cast("array<string>")
    n_math = F.size(F.filter(fonts, is_math_font))
    strong, symbols, ascii_ = count_of(t, STRONG), count_of(t, SYMBOLS), count_of(t, ASCII_MATH)
    latex = t.rlike(LATEX)
    signals = (strong >= 1).cast("int") + (symbols >= 1).cast("int") + latex.cast("int") + (ascii_ >= 3).cast("int")
    short = n <= 25
    return (
        F.when((n == 0) | (n > 200) | (runs >= 3), False)
        .when(t.rlike(r"^[\d.]+×"), False)
        .when(t.rlike(r"^[{}\-_.\s]+$"), False)
        .when(t.rlike(r"^\{[a-z_]+\}$"), False)
        .when(short & (signals >= 2), True)
        .when(short & (signals == 1) & (n_math > 0), True)
        .when(short & (signals == 1) & (F.size(fonts) == 0), False)
        .when((strong >= 2) | latex, True)
        .when((symbols >= 3) & (common_words(t) < 2), True)
        .when((ascii_ / n >= 0.2) & (runs == 0), True)
        .when((F.size(fonts) > 0) & (n_math >= 0.8 * F.size(fonts)) & (runs == 0), True)
        .otherwise(False)
    )


def is_formula_span(font: Column, text: Column) -> Column:
    """:func:`is_formula` for a single span with one font."""
    return is_formula(text, F.array(font))
