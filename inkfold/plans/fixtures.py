"""Inputs that the tables don't have as such, derived by the same arithmetic in Spark and in DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import split_text
from ..sources import tables

#: Fixed texts for the formula rules: (text, font or '').
FORMULAS = [
    ("x = y + z", ""), ("∑ x ≤ ∞", ""), ("α + β", ""), ("E = mc²", "CMMI10"), ("a", ""), ("", ""), ("   ", ""), ("4.7×fewer", ""),
    ("{writing_prompt}", ""), ("---", ""), ("\\frac{dN}{dt} = rN(1 - \\frac{N}{K})", ""), ("x^{2} + y_{i}", ""), ("f(x)", "CMR10"),
    ("f(x)", "Times"), ("This is a plain sentence about nothing", ""), ("the sum of all α β γ δ values is here as one", ""),
    ("α β γ δ ε long list of greek", ""), ("(a+b)*(c-d)=[e]/{f}", ""), ("p < 0.05", ""), ("∫ f dx = F + C", "Times"), ("aaaa bbbb", "CMSY10"),
    ("x ∈ S, y ∉ T and much more text follows here", ""), ("ab cd ef gh ij kl mn op qr st uv", "CMMI7"), ("\\alpha_i \\cdot \\beta^2 \\rightarrow \\infty", ""),
    ("k_é^ü", ""), ("   y² ≈ 3   ", ""), ("if a then b else c", ""), ("|x| <= |y| + |z| - |w|", ""), ("→", ""), ("1 + 1", "Symbol"),
]
#: Fixed tables: (markdown, caption).
TABLES = [
    ("| A | B |\n| --- | --- |\n| 1 | 2 |\n| 3 | |", ""), ("| A | B |\n| --- | --- |", "cap"), ("no table at all", "cap"), ("no table at all", ""),
    ("| A |\n| 1 | 2 |\n| 3 |", "x"), ("||A|B|\n|---|---|\n||1|2|\n|1|2||", ""), ("| A | B |\n|---|---|\nplain\n| 5 | 6 |", "t"), ("", ""), ("| A |", "one"),
    ("  | H | K |  \n\n |---|---| \n | a | b | c |\n", "sp"), ("| A | B |\n| --- | --- |\n|  |  |", ""),
]
IDS = [
    "21:c0", "21:fig_p0_i1", "21:fig3", "21:tbl_p1_t0:r4", "21:t0:r12", "21:f7", "21:fx", "21:r", "x:y:tbl_1", "figure:z", "table:9", "plain", "a:C1", "21:21:fig_p2_i0",
]

BLOCKS = {
    "paper_id": "concat('p', o_orderkey {div} 32)",
    "page_no": "CAST((o_orderkey % 32) {div} 16 AS INT)",
    "block_no": "CAST(o_orderkey % 16 AS INT)",
    "text": "concat(CASE WHEN o_custkey % 3 = 0 THEN concat('Figure ', o_custkey % 9 + 1, '. ') ELSE '' END, 'Order ', o_orderkey, ' ', o_orderpriority)",
    "x0": "CAST(50 + (o_custkey % 2) * 300 + (o_custkey % 5) * 2 AS DOUBLE)",
    "y0": "CAST(CAST(floor(o_totalprice) AS BIGINT) % 700 AS DOUBLE)",
    "x1": "CAST(50 + (o_custkey % 2) * 300 + (o_custkey % 5) * 2 + CASE WHEN o_orderkey % 11 = 0 THEN 450 ELSE 200 END AS DOUBLE)",
    "y1": "CAST(CAST(floor(o_totalprice) AS BIGINT) % 700 + 10 + o_custkey % 20 AS DOUBLE)",
    "width": "CAST(612 AS DOUBLE)",
}
IMAGES = {
    **{k: BLOCKS[k] for k in ("paper_id", "page_no")},
    "img_idx": "CAST(o_orderkey % 16 AS INT)",
    "rect_no": "0",
    "ix0": BLOCKS["x0"],
    "iy0": "CAST(CAST(floor(o_totalprice) AS BIGINT) % 500 AS DOUBLE)",
    "ix1": "CAST(50 + (o_custkey % 2) * 300 + (o_custkey % 5) * 2 + 120 AS DOUBLE)",
    "iy1": "CAST(CAST(floor(o_totalprice) AS BIGINT) % 500 + 60 AS DOUBLE)",
}
REGIONS = {
    **{k: BLOCKS[k] for k in ("paper_id", "page_no")},
    "region_no": "CAST(o_orderkey % 16 AS INT)",
    "rx0": "CAST(40 + (o_custkey % 3) * 150 AS DOUBLE)",
    "ry0": "CAST(CAST(floor(o_totalprice) AS BIGINT) % 400 AS DOUBLE)",
    "rx1": "CAST(340 + (o_custkey % 3) * 150 AS DOUBLE)",
    "ry1": "CAST(CAST(floor(o_totalprice) AS BIGINT) % 400 + 200 AS DOUBLE)",
}
FONT_BLOCKS = {
    "paper_id": "concat('p', o_orderkey {div} 32)",
    "ord": "CAST(o_orderkey % 32 AS BIGINT)",
    "text": "CASE WHEN o_custkey % 7 IN (0, 1) THEN concat('x = y² + ∑ z ≤ ', o_custkey % 100) WHEN o_custkey % 7 = 2 THEN repeat('long words in a row ', 20) "
    "WHEN o_custkey % 7 = 3 THEN ' ' ELSE concat('short piece of text number ', o_orderkey) END",
    "fonts": "CASE WHEN o_custkey % 7 IN (0, 1) THEN {array}('CMMI10', 'CMR7'{close} ELSE {array}('Times'{close} END",
    "page": "CAST((o_orderkey % 32) {div} 16 AS INT)",
    "y0": "CAST(CAST(floor(o_totalprice) AS BIGINT) % 60 AS DOUBLE)",
    "y1": "CAST(CAST(floor(o_totalprice) AS BIGINT) % 60 + 8 AS DOUBLE)",
}


def spark_columns(spec: dict[str, str]) -> list[str]:
    return [f"{v.format(div='div', array='array', close=')')} AS {k}" for k, v in spec.items()]


def duck_select(spec: dict[str, str], where: str = "TRUE") -> str:
    cols = ", ".join(f"{v.format(div='//', array='list_value', close=')')} AS {k}" for k, v in spec.items())
    return f"SELECT {cols} FROM orders WHERE {where}"


def duck_values(rows: list[tuple], names: str) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    listed = ", ".join("(" + ", ".join([str(i), *map(quote, r)]) + ")" for i, r in enumerate(rows))
    return f"SELECT * FROM (VALUES {listed}) AS t(id, {names})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_as(spark: SparkSession, sf_dir: str, spec: dict[str, str]) -> DataFrame:
    return tables.spread(table(spark, sf_dir, "orders")).selectExpr(*spark_columns(spec))


def literal_rows(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    cols = [c.strip() for c in names.split(",")]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{c} string" for c in cols))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, paper_id, ord, content: every document (doc_id below 9 * 10**12) cut into chunks. No shuffle: a document is one element."""
    docs = tables.spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("paper_id"), "doc_id", "text")
    return split_text(docs).select(
        F.concat("paper_id", F.lit(":c"), F.col("window").cast("string")).alias("chunk_id"), "paper_id",
        (F.col("doc_id") * 1_000_000 + F.col("window")).alias("ord"), "start", "end", F.col("piece").alias("content"),
    )


def stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`corpus` as a written table: what an index is built from and what hits are joined to."""
    return tables.stored(corpus(spark, sf_dir).select("chunk_id", "ord", "content"), "chunks")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def over(spark: SparkSession, sql: str, frame: DataFrame, name: str) -> DataFrame:
    """``sql`` with ``frame`` in the place of the table ``name``. The view has a name of its own and is gone once the plan is made."""
    view = f"{name}_{uuid.uuid4().hex}"
    frame.createOrReplaceTempView(view)
    try:
        return spark.sql(sql.replace(f"FROM {name}", f"FROM {view}"))
    finally:
        spark.catalog.dropTempView(view)


# ---- DuckDB ----
DUCK_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{DUCK_SPACE}]+|[{DUCK_SPACE}]+$', '', 'g')"


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[{DUCK_SPACE}]+'), lambda w: w <> '')"


def _end(s: str) -> str:
    tail = f"instr(reverse(substr(text, {s} + 1051, 150)), ' ')"
    return f"CASE WHEN {s} + 1200 >= length(text) THEN length(text) WHEN {tail} > 0 THEN {s} + 1200 - {tail} ELSE {s} + 1200 END"


#: Common table expressions (after WITH RECURSIVE) that make chunks(chunk_id, paper_id, ord, s, e, content).
CHUNKS = f"""
cuts(doc_id, k, s, e) AS (
  SELECT doc_id, 0, 0, CAST({_end('0')} AS BIGINT) FROM documents
  UNION ALL
  SELECT c.doc_id, c.k + 1, CAST(greatest(c.e - 150, c.s + 1) AS INTEGER), CAST({_end('greatest(c.e - 150, c.s + 1)')} AS BIGINT)
  FROM cuts c JOIN documents d ON d.doc_id = c.doc_id WHERE c.e < length(d.text)),
cut_texts AS (
  SELECT c.*, CASE WHEN length(d.text) <= 1200 THEN d.text ELSE {strip_sql('substr(d.text, c.s + 1, c.e - c.s)')} END AS content
  FROM cuts c JOIN documents d ON d.doc_id = c.doc_id),
chunks AS (
  SELECT CAST(doc_id AS VARCHAR) || ':c' || n AS chunk_id, CAST(doc_id AS VARCHAR) AS paper_id, doc_id * 1000000 + n AS ord, s, e, content
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n FROM cut_texts WHERE {strip_sql('content')} <> ''))
"""
