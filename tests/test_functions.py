import time
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfold.functions import formula, modality, text
from inkfold.operators.chunking import split_text
from inkfold.plans.fixtures import FORMULAS, TABLES


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_white_space(spark):
    values = ["  a b ", " x ", "\x1ca\x1f", "\t\n", "", "a\u0085"]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, lambda c: F.to_json(text.words(c))) == [
        "[" + ",".join(f'"{w}"' for w in v.lower().split()) + "]" for v in values
    ]


#: Which of the fixed texts are formulas, by number, as told by reading them.
ARE_FORMULAS = [0, 1, 3, 10, 11, 12, 13, 19, 22, 24, 25, 28, 29]


def formulas_among(spark, rows):
    df = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(rows)], "i int, t string, f array<string>")
    return [r.y for r in df.select("i", formula.is_formula(F.col("t"), F.col("f")).alias("y")).orderBy("i").collect()]


def test_formula_rules(spark):
    got = formulas_among(spark, [(t, [f] if f else []) for t, f in FORMULAS])
    assert [i for i, y in enumerate(got) if y] == ARE_FORMULAS
    # a short text with one signal needs a math font, and without any signal nearly all fonts must be
    fonts = [("β q", ["CMR10", "Times"]), ("β q", ["Times"]), ("q r", ["CMR10"] * 4 + ["Times"]), ("q r", ["CMR10", "Times"])]
    assert formulas_among(spark, fonts) == [True, False, True, False]
    assert column(spark, [None], formula.is_formula) == [False]
    assert column(spark, ["CMMI10", "Arial", "", None, "STIXGeneral"], formula.is_math_font) == [True, False, False, False, True]


def test_formula_words(spark):
    values = ["\\frac{dN}{dt} = rN", "x^2", "x_{ij}^{2}", "+", "\\interval"]
    assert column(spark, values, modality.formula_words) == [
        "formula: divided by dN dt = rN", "formula: x to the power of 2", "formula: x subscript ij to the power of 2",
        "mathematical formula: +", "formula: integral of erval",
    ]


#: The rows of the fixed tables, as told by reading them.
TABLE_ROWS = [
    ["table: A=1, B=2", "table: A=3"], ["table (cap): A=---, B=---"], ["table: cap no table at all"], ["table:  no table at all"],
    ["table (x): A=1", "table (x): A=3"], ["table: A=1, B=2", "table: A=1, B=2"], ["table (t): A=5, B=6"], ["table:"], ["table: one | A |"],
    ["table (sp): H=a, K=b"], ["table:  | A | B |\n| --- | --- |\n|  |  |"],
]


def test_table_rows(spark):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(TABLES)], "i int, m string, c string")
    got = [r.y for r in df.select("i", modality.table_rows(F.col("m"), F.col("c")).alias("y")).orderBy("i").collect()]
    assert got == TABLE_ROWS


def test_table_rows_are_linear_in_the_table(spark):
    """Lines and header are not made again for each row; 4,000 rows took minutes when they were."""
    n = 4000
    grid = "| A | B |\n| --- | --- |\n" + "\n".join(f"| {i} | x |" for i in range(n))
    df = spark.createDataFrame([(grid, "cap")], "m string, c string")
    began = time.perf_counter()
    got = df.select(modality.table_rows(F.col("m"), F.col("c"))).first()[0]
    assert got == [f"table (cap): A={i}, B=x" for i in range(n)]
    assert time.perf_counter() - began < 20


def test_embedding_text_prefixes_table_rows_twice(spark):
    df = spark.createDataFrame([("table", "table: A=1"), ("figure", ""), ("text", "t"), ("formula", "x^2")], "m string, c string")
    got = [r[0] for r in df.select(modality.embedding_text(F.col("m"), F.col("c"))).collect()]
    assert got == ["table:  table: A=1", "figure", "t", "formula: x to the power of 2"]
    assert df.select(modality.embedding_text(F.col("m"), F.col("c"), clean_tables=True)).first()[0] == "table: A=1"


@pytest.mark.parametrize("rule, want", [("report", "text"), ("builder", "figure"), ("stats", "text")])
def test_modality_fallback(spark, rule, want):
    assert column(spark, ["fig:zz"], lambda c: modality.modality_of_id(c, rule)) == [want]


ANY = st.text(alphabet="ab=+∑α{}_^\\ \t", max_size=30)


@settings(max_examples=25, deadline=None)
@given(st.lists(ANY, min_size=1, max_size=20))
def test_formula_properties(spark, values):
    """White space around a text changes nothing; blanks, words and long texts are none; two operators make one."""
    said = lambda rows: formulas_among(spark, [(t, []) for t in rows])
    assert said(values) == said([f" \t{v}\n " for v in values])
    assert not any(said([" " * len(v) for v in values] + [f"{v} these words here count" for v in values] + [v + "x" * 201 for v in values]))
    assert all(said([f"{v} ≤ ∞" for v in values]))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["b", "a", "é", "", "zz"]), max_size=12), min_size=1, max_size=10))
def test_counted(spark, lists):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<string>")
    for r in df.select("i", text.counted(F.col("x")).alias("c")).collect():
        assert [(c.value, c.n) for c in r.c] == sorted(((v, lists[r.i].count(v)) for v in set(lists[r.i])), key=lambda p: p[0].encode())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(f"aBÉİſ{text.BLANKS}​"), max_size=40)), min_size=1, max_size=10))
def test_word_counts_and_trimmed(spark, rows):
    """Counts in the workers are those of the expressions, and trimming is stripping."""
    df = spark.createDataFrame(list(enumerate(rows)), "i int, x string")
    w, x = text.words(F.col("x")), F.col("x")
    for r in df.select(w.alias("w"), text.word_counts(x).alias("c"), text.strip(x).alias("s"), text.trimmed(x).alias("t")).collect():
        assert r.s == r.t
        assert r.c is None if r.w is None else (r.c.dl == len(r.w) and {p.value: p.n for p in r.c.t} == {v: r.w.count(v) for v in r.w})


def test_pieces_are_trimmed_at_their_ends(spark):
    """No pattern is tried at every character of a piece to strip it."""
    text_ = ("　\tword " * 300 + " ") * 2
    pieces = split_text(spark.createDataFrame([(text_,)], "text string"))
    assert "regexp_replace" not in pieces._jdf.queryExecution().optimizedPlan().toString()
    assert (got := [r.piece for r in pieces.collect()]) and len(got) > 2 and all(p == p.strip() for p in got)


def test_texts_with():
    """Every white space parts words as str.split() does, and a word counts once for each text."""
    texts = [None, "", " ", "b a b", "　a ", *(f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000)]
    want = Counter(w for t in texts if t for w in set(t.split()))
    terms, n = text.texts_with(pa.array(texts))
    assert dict(zip(terms.to_pylist(), n.to_pylist())) == want and len(terms) == len(want)
    assert [len(x) for x in text.texts_with(pa.array([None], pa.string()))] == [0, 0]


def test_blank_pieces_go_without_a_pattern(spark):
    """Pieces of long texts are stripped already, so only a short text is searched for what isn't white space."""
    rows = [None, "", " \n", "　" * 1200, " " * 5000, "a" + " " * 4000 + "b", " a "]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    pieces = split_text(df)
    assert [(r.i, r.window, r.piece) for r in pieces.orderBy("i", "window").collect()] == [(5, 0, "a"), (5, 1, "b"), (6, 0, " a ")]
    plan = pieces._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == plan.count("RLIKE(_text") == 1
