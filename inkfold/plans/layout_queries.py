"""Layout, formula, table and adapter queries over derived blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formula as fm
from ..functions import modality as md
from ..operators import adapters, layout
from ..sources.tables import spread
from .corpus_queries import MIXED, MODALITY, mixed_chunks
from .fixtures import (
    BLOCKS, DUCK_SPACE, FONT_BLOCKS, FORMULAS, IMAGES, REGIONS, TABLES, duck_select, duck_values, literal_rows, orders_as, strip_sql, table,
    over,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- columns and reading order ----
_blocks = f"blocks AS ({duck_select(BLOCKS)})"
_pages = """bins AS (SELECT paper_id, page_no, greatest(0, least(CAST(trunc((x0 + x1) / 2 / width * 20) AS INTEGER), 19)) AS bin, count(*) AS n FROM blocks GROUP BY 1, 2, 3),
peaks AS (SELECT paper_id, page_no, CAST(sum(n) AS BIGINT) AS n_blocks, coalesce(max(n) FILTER (bin <= 7), 0) AS l, coalesce(max(n) FILTER (bin >= 12), 0) AS r,
  coalesce(sum(n) FILTER (bin BETWEEN 8 AND 11), 0) / 4 AS m FROM bins GROUP BY 1, 2),
cols AS (SELECT paper_id, page_no, n_blocks, n_blocks >= 4 AND CASE WHEN m = 0 THEN l > 0 AND r > 0 ELSE l > 2 * m AND r > 2 * m END AS two_column FROM peaks)"""
_order = """sides AS (SELECT b.*, c.two_column, CASE WHEN x1 - x0 > width * 0.6 THEN 'span' WHEN (x0 + x1) / 2 < width / 2 THEN 'left' ELSE 'right' END AS side
  FROM blocks b JOIN cols c USING (paper_id, page_no)),
zones AS (SELECT *, CASE WHEN NOT two_column THEN 0 WHEN side = 'left' THEN 2 WHEN side = 'right' THEN 3
  WHEN y1 < coalesce(min(y0) FILTER (side = 'left') OVER p, 0) THEN 0 WHEN y0 > coalesce(max(y1) FILTER (side = 'left') OVER p, 'inf') THEN 4 ELSE 1 END AS zone
  FROM sides WINDOW p AS (PARTITION BY paper_id, page_no)),
ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id, page_no ORDER BY zone, CASE WHEN two_column THEN y0 ELSE round_even(y0 / 10, 0) END,
  CASE WHEN two_column THEN 0 ELSE x0 END, block_no) - 1 AS INTEGER) AS order_ FROM zones)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_as(spark, sf_dir, BLOCKS)


@query(f"WITH {_blocks}, {_pages} SELECT * FROM cols")
def two_column_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.two_column_pages(blocks(spark, sf_dir))


@query(f"WITH {_blocks}, {_pages}, {_order} SELECT paper_id, page_no, block_no, two_column, CAST(zone AS INTEGER) AS zone, order_ FROM ordered")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(blocks(spark, sf_dir)).select(
        "paper_id", "page_no", "block_no", "two_column", "zone", F.col("order").alias("order_")
    )


@query(f"WITH {_blocks}, {_pages}, {_order} SELECT paper_id, page_no, string_agg(text, chr(10) ORDER BY order_) AS text FROM ordered GROUP BY 1, 2")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_texts(layout.reading_order(blocks(spark, sf_dir)))


# ---- captions and regions ----
_images = f"images AS ({duck_select(IMAGES)})"
_caption = r"'(?i)^\s*(?:figure|fig\.?|table|tab\.?)\s*(\d+)[.:\s]'"
_below = f"""found AS (SELECT i.paper_id, i.page_no, i.img_idx, b.text, b.y0 - i.iy1 AS distance,
  row_number() OVER (PARTITION BY i.paper_id, i.page_no, i.img_idx ORDER BY b.y0 - i.iy1, i.rect_no, b.block_no) AS n
  FROM images i JOIN blocks b USING (paper_id, page_no)
  WHERE b.y0 >= i.iy1 AND b.y0 - i.iy1 <= 250 AND b.x1 >= i.ix0 AND b.x0 <= i.ix1 AND regexp_matches(b.text, {_caption}))"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_as(spark, sf_dir, IMAGES)


@query(f"WITH {_blocks}, {_images}, {_below} SELECT paper_id, page_no, img_idx, {strip_sql('substr(text, 1, 800)')} AS caption, distance FROM found WHERE n = 1")
def caption_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.captions_below(images(spark, sf_dir), blocks(spark, sf_dir))


@query(
    f"""WITH {_blocks}, {_pages}, {_order}, {_images}, {_below}, texts AS (SELECT paper_id, page_no, string_agg(text, chr(10) ORDER BY order_) AS text FROM ordered GROUP BY 1, 2)
SELECT i.paper_id, i.page_no, i.img_idx, coalesce(nullif({strip_sql('substr(f.text, 1, 800)')}, ''),
  CASE WHEN regexp_matches(t.text, {_caption}) THEN {strip_sql("string_split(substr(t.text, 1, 800), chr(10))[1]")} ELSE '' END) AS caption
FROM images i LEFT JOIN (SELECT * FROM found WHERE n = 1) f USING (paper_id, page_no, img_idx) LEFT JOIN texts t USING (paper_id, page_no)"""
)
def figure_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return layout.figure_captions(images(spark, sf_dir), b, layout.page_texts(layout.reading_order(b)))


@query(
    f"""WITH {_blocks}, regions AS ({duck_select(REGIONS)})
SELECT r.paper_id, r.page_no, r.region_no, count(b.text) AS n_lines, coalesce(string_agg(b.text, ' ' ORDER BY b.y0, b.block_no), '') AS text
FROM regions r LEFT JOIN blocks b ON b.paper_id = r.paper_id AND b.page_no = r.page_no AND (b.x0 + b.x1) / 2 BETWEEN r.rx0 AND r.rx1 AND (b.y0 + b.y1) / 2 BETWEEN r.ry0 AND r.ry1
GROUP BY 1, 2, 3"""
)
def region_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.region_texts(orders_as(spark, sf_dir, REGIONS), blocks(spark, sf_dir).withColumnRenamed("block_no", "line_no"))


@query("SELECT o_orderkey, o_custkey * 7 AS n_bytes FROM orders WHERE o_custkey * 7 > 5000")
def large_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 7).alias("n_bytes"))
    return layout.large_images(rows)


@query(
    f"""WITH s AS (SELECT o_custkey AS paper_id, o_orderkey, o_orderkey % 3 AS kind, ' ' || o_orderpriority || ' ' AS text, CASE WHEN o_orderkey % 2 = 0 THEN 'CMR10' ELSE '' END AS font FROM orders)
SELECT CAST(paper_id AS VARCHAR) AS paper_id, {strip_sql("string_agg(text, ' ' ORDER BY o_orderkey)")} AS text, {strip_sql("string_agg(text, '' ORDER BY o_orderkey)")} AS font_text,
CASE WHEN bool_or(font <> '') THEN 'CMR10' ELSE '' END AS fonts FROM s WHERE kind = 0 GROUP BY 1"""
)
def span_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("paper_id"), F.lit(0).alias("page_no"), F.lit(0).alias("block_no"), F.col("o_orderkey").alias("span_no"),
        (F.col("o_orderkey") % 3).alias("kind"), F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("text"),
        F.when(F.col("o_orderkey") % 2 == 0, "CMR10").otherwise("").alias("font"), *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")],
    )
    return layout.page_blocks(spans).select("paper_id", "text", "font_text", F.array_join("fonts", ",").alias("fonts"))


# ---- formulas, tables, figures ----
def _count(t: str, chars: str) -> str:
    return f"(length({t}) - length(translate({t}, '{chars}', '')))"


def formula_sql(text: str, n_fonts: str, n_math: str) -> str:
    """The decision list on a text; n_fonts and n_math: how many fonts and math fonts it has."""
    t = strip_sql(text)
    runs = f"len(regexp_extract_all({t}, '[a-zA-Z]{{4,}}'))"
    strong, sym, asc = _count(t, fm.STRONG), _count(t, fm.SYMBOLS), _count(t, fm.ASCII_MATH)
    latex = rf"regexp_matches({t}, '\\[a-zA-Z]+|\^\{{|_\{{')"
    words = ", ".join(f"' {w} '" for w in fm.COMMON_WORDS)
    common = f"len(list_filter([{words}], lambda w: contains(' ' || lower({t}) || ' ', w)))"
    signals = f"(CAST({strong} >= 1 AS INTEGER) + CAST({sym} >= 1 AS INTEGER) + CAST({latex} AS INTEGER) + CAST({asc} >= 3 AS INTEGER))"
    short = f"length({t}) <= 25"
    return rf"""CASE WHEN length({t}) = 0 OR length({t}) > 200 OR {runs} >= 3 THEN FALSE WHEN regexp_matches({t}, '^[0-9.]+×') THEN FALSE
WHEN regexp_matches({t}, '^[{{}}\-_.\s]+$') THEN FALSE WHEN regexp_matches({t}, '^\{{[a-z_]+\}}$') THEN FALSE
WHEN {short} AND {signals} >= 2 THEN TRUE WHEN {short} AND {signals} = 1 AND {n_math} > 0 THEN TRUE WHEN {short} AND {signals} = 1 AND {n_fonts} = 0 THEN FALSE
WHEN {strong} >= 2 OR {latex} THEN TRUE WHEN {sym} >= 3 AND {common} < 2 THEN TRUE WHEN {asc} / length({t}) >= 0.2 AND {runs} = 0 THEN TRUE
WHEN {n_fonts} > 0 AND {n_math} >= 0.8 * {n_fonts} AND {runs} = 0 THEN TRUE ELSE FALSE END"""


_math = f"regexp_matches(lower(font), '{'|'.join(fm.MATH_FONTS)}')"
_formula_rows = f"SELECT id, text, font FROM ({duck_values(FORMULAS, 'text, font')}) UNION ALL SELECT o_orderkey + 1000, 'f = ' || o_totalprice || CASE o_orderkey % 4 WHEN 0 THEN ' ∑ x' WHEN 1 THEN ' total amount given here' ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN 'CMSY8' ELSE '' END FROM orders"


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1000).alias("id"),
        F.concat(F.lit("f = "), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 4 == 0, " ∑ x").when(F.col("o_orderkey") % 4 == 1, " total amount given here").otherwise("")).alias("text"),
        F.when(F.col("o_orderkey") % 3 == 0, "CMSY8").otherwise("").alias("font"),
    )
    return literal_rows(spark, FORMULAS, "text, font").union(more)


_formula_rows = _formula_rows.replace("o_totalprice", "o_custkey")


@query(
    f"""SELECT CAST(id AS BIGINT) AS id, {formula_sql('text', "CAST(font <> '' AS INTEGER)", f"CAST(font <> '' AND {_math} AS INTEGER)")} AS is_formula,
{formula_sql('text', '0', '0')} AS without_fonts, {_math} AS math_font FROM ({_formula_rows})"""
)
def formula_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    fonts = F.when(F.col("font") != "", F.array("font")).otherwise(F.array().cast("array<string>"))
    return formulas(spark, sf_dir).select(
        F.col("id").cast("long").alias("id"), fm.is_formula(F.col("text"), fonts).alias("is_formula"), fm.is_formula(F.col("text")).alias("without_fonts"),
        fm.is_math_font(F.col("font")).alias("math_font"),
    )


def _verbalized(t: str) -> str:
    for k, v in md.LATEX_WORDS.items():
        t = f"replace({t}, '{k}', ' {v} ')"
    for pattern, new in ((r"\^\{([^}]+)\}", r" to the power of \1"), (r"\^([\pL\pN_])", r" to the power of \1"), (r"_\{([^}]+)\}", r" subscript \1"), (r"_([\pL\pN_])", r" subscript \1")):
        t = f"regexp_replace({t}, '{pattern}', '{new}', 'g')"
    return f"trim(regexp_replace(translate({t}, '{{}}', '  '), '[{DUCK_SPACE}]+', ' ', 'g'))"


@query(
    f"""SELECT CAST(id AS BIGINT) AS id, CASE WHEN regexp_matches(v, '[a-zA-Z]{{3,}}') THEN 'formula: ' ELSE 'mathematical formula: ' END || v AS words
FROM (SELECT id, {_verbalized('text')} AS v FROM ({_formula_rows}))"""
)
def formula_verbalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulas(spark, sf_dir).select(F.col("id").cast("long").alias("id"), md.formula_words(F.col("text")).alias("words"))


_lines = f"list_filter(list_transform(string_split(markdown, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '')"
_cells = lambda x: f"list_transform(string_split(trim({x}, '|'), '|'), lambda c: {strip_sql('c')})"
_part_tables = """SELECT 100 + CAST(substr(p_brand, 7) AS INTEGER) AS id, '| Name | Size | Price |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
string_agg('| ' || p_name || ' | ' || CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END || ' | ' || p_partkey || CASE WHEN p_size % 7 = 0 THEN ' ||' ELSE ' |' END, chr(10) ORDER BY p_partkey) AS markdown,
CASE WHEN p_brand = 'Brand#3' THEN '' ELSE p_brand END AS caption FROM part GROUP BY p_brand"""


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(
        F.lit("| "), "p_name", F.lit(" | "), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_size").cast("string")), F.lit(" | "),
        F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 7 == 0, " ||").otherwise(" |"),
    )
    rows = F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l"))))
    by = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.transform(rows, lambda r: r["l"]), "\n").alias("m"))
    return literal_rows(spark, TABLES, "markdown, caption").union(
        by.select(
            (F.substring("p_brand", 7, 9).cast("int") + 100).alias("id"), F.concat(F.lit("| Name | Size | Price |\n| --- | --- | --- |\n"), "m").alias("markdown"),
            F.when(F.col("p_brand") == "Brand#3", "").otherwise(F.col("p_brand")).alias("caption"),
        )
    )


@query(
    f"""WITH t AS (SELECT id, markdown, caption FROM ({duck_values(TABLES, 'markdown, caption').replace("VALUES", "VALUES")}) UNION ALL {_part_tables}),
l AS (SELECT *, {_lines} AS ls FROM t),
d AS (SELECT *, {_cells('coalesce(ls[1], chr(0))')} AS h, list_filter(CASE WHEN len(ls) > 2 AND contains(ls[2], '---') THEN ls[3:] ELSE ls[2:] END, lambda x: starts_with(x, '|')) AS data FROM l),
r AS (SELECT *, list_filter(list_transform(data, lambda x: array_to_string(list_filter(list_transform(range(1, least(len(h), len({_cells('x')})) + 1),
  lambda i: CASE WHEN {_cells('x')}[i] <> '' THEN h[i] || '=' || {_cells('x')}[i] END), lambda p: p IS NOT NULL), ', ')), lambda x: x <> '') AS parts FROM d),
o AS (SELECT id, CASE WHEN len(ls) >= 2 AND starts_with(ls[1], '|') AND len(parts) > 0
  THEN list_transform(parts, lambda p: CASE WHEN caption <> '' THEN 'table (' || caption || '): ' ELSE 'table: ' END || p)
  ELSE [{strip_sql("'table: ' || caption || ' ' || markdown")}] END AS rows_ FROM r)
SELECT id, CAST(i - 1 AS INTEGER) AS row_no, rows_[i] AS row_text FROM o, unnest(range(1, len(rows_) + 1)) AS u(i)"""
)
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = md.table_rows(F.col("markdown"), F.col("caption"))
    return tables(spark, sf_dir).select("id", F.posexplode(rows).alias("row_no", "row_text"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'figure L: ' || o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN ' figure content: ocr' ELSE '' END
WHEN o_orderkey % 2 = 0 THEN 'figure L' || CASE WHEN o_orderkey % 5 = 0 THEN ': figure content: ocr' ELSE '' END
WHEN o_orderkey % 3 = 0 THEN o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN ': figure content: ocr' ELSE '' END
WHEN o_orderkey % 5 = 0 THEN 'figure content: ocr' ELSE 'figure' END AS text FROM orders"""
)
def figure_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    given = lambda n, c: F.when(k % n == 0, c).otherwise("")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", md.figure_text(given(3, F.col("o_orderpriority")), given(2, F.lit("L")), given(5, F.lit("ocr"))).alias("text")
    )


@query(
    f"""WITH {MIXED}, m AS (SELECT chunk_id, content AS text, {MODALITY} AS modality FROM mixed), v AS (SELECT *, {_verbalized('text')} AS v FROM m)
SELECT chunk_id, CASE modality WHEN 'formula' THEN CASE WHEN regexp_matches(v, '[a-zA-Z]{{3,}}') THEN 'formula: ' ELSE 'mathematical formula: ' END || v
WHEN 'table' THEN {strip_sql("'table:  ' || text")} WHEN 'figure' THEN CASE WHEN text = '' THEN 'figure' ELSE text END ELSE text END AS embedded FROM v"""
)
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = md.modality_of_id(F.col("chunk_id"))
    return mixed_chunks(spark, sf_dir).select("chunk_id", md.embedding_text(kind, F.col("content")).alias("embedded"))


# ---- adapters ----
_markdown = """SELECT CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '# Title ' || doc_id || chr(10) || chr(10) END ||
regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '\\. ([A-Z])', '.' || chr(10) || chr(10) || '## \\1', 'g') AS markdown FROM documents""".replace("\\\\", "\\")


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n\n")))
    body = F.regexp_replace(F.replace("text", F.lit("\n"), F.lit("\n\n")), r"\. ([A-Z])", ".\n\n## $1")
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(F.col("doc_id").cast("string").alias("paper_id"), F.concat(title, body).alias("markdown"))


@query(
    f"""WITH m AS ({_markdown}), b AS (SELECT paper_id, i, {strip_sql('string_split(markdown, chr(10) || chr(10))[i]')} AS block FROM m, unnest(range(1, len(string_split(markdown, chr(10) || chr(10))) + 1)) AS u(i)),
h AS (SELECT *, starts_with(block, '#') AS head, last_value(CASE WHEN starts_with(block, '#') THEN {strip_sql("regexp_replace(block, '^#+', '')")} END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY i) AS section
FROM b WHERE block <> '')
SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY i) - 1 AS INTEGER) AS ord, block AS text, section FROM h WHERE NOT head"""
)
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.markdown_elements(markdown_docs(spark, sf_dir))


_line_formula = formula_sql("line", "0", "0")


@query(
    f"""WITH m AS (SELECT paper_id, markdown || chr(10) || 'x = ∑ y² ≤ z' || chr(10) || 'tail text' AS markdown FROM ({_markdown})),
l AS (SELECT paper_id, i, {strip_sql('string_split(markdown, chr(10))[i]')} AS line FROM m, unnest(range(1, len(string_split(markdown, chr(10))) + 1)) AS u(i)),
f AS (SELECT *, {_line_formula} AS f FROM l WHERE line <> ''), r AS (SELECT *, sum(CAST(f AS INTEGER)) OVER (PARTITION BY paper_id ORDER BY i) AS run FROM f),
g AS (SELECT paper_id, run, f, min(i) AS i, string_agg(line, ' ' ORDER BY i) AS text FROM r GROUP BY 1, 2, 3),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id, f ORDER BY i) - 1 AS INTEGER) AS ord FROM g)
SELECT paper_id, CASE WHEN f THEN 'formula' ELSE 'text' END AS kind, ord, CASE WHEN f THEN 'f' ELSE 'c' END || ord AS element_id, text FROM n"""
)
def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.concat("markdown", F.lit("\nx = ∑ y² ≤ z\ntail text"))
    return adapters.markdown_line_elements(markdown_docs(spark, sf_dir).select("paper_id", more.alias("markdown")))


_fonts = f"fb AS ({duck_select(FONT_BLOCKS)})"
_n_math = "len(list_filter(fonts, lambda font: " + _math + "))"
_block_formula = formula_sql("text", "len(fonts)", _n_math)
_merged = f"""kept AS (SELECT paper_id, ord, {strip_sql('text')} AS text, fonts, page, y0, y1 FROM fb WHERE {strip_sql('text')} <> ''),
alone AS (SELECT *, ({_block_formula}) OR length(text) >= 300 AS alone, row_number() OVER (PARTITION BY paper_id ORDER BY ord) AS n FROM kept),
fold(paper_id, n, grp, own, size) AS (
  SELECT paper_id, n, CASE WHEN alone OR length(text) + 1 >= 300 THEN 1 ELSE 0 END, 0, CASE WHEN alone OR length(text) + 1 >= 300 THEN 0 ELSE length(text) + 1 END FROM alone WHERE n = 1
  UNION ALL
  SELECT a.paper_id, a.n, CASE WHEN a.alone OR f.size + length(a.text) + 1 >= 300 THEN g + 1 ELSE g END, g, CASE WHEN a.alone OR f.size + length(a.text) + 1 >= 300 THEN 0 ELSE f.size + length(a.text) + 1 END
  FROM (SELECT f.*, f.n + 1 AS m FROM fold f) f JOIN alone a ON a.paper_id = f.paper_id AND a.n = f.m, LATERAL (SELECT CASE WHEN a.alone AND f.size > 0 THEN f.grp + 1 ELSE f.grp END AS g) x),
merged AS (SELECT a.paper_id, f.own, string_agg(a.text, ' ' ORDER BY a.ord) AS text, list_sort(list_distinct(flatten(list(a.fonts)))) AS fonts, bool_or(a.alone) AS alone,
  max(a.page) AS page, max(a.y0) AS y0, max(a.y1) AS y1 FROM alone a JOIN fold f ON f.paper_id = a.paper_id AND f.n = a.n GROUP BY 1, 2)"""


def font_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_as(spark, sf_dir, FONT_BLOCKS)


@query(f"WITH RECURSIVE {_fonts}, {_merged} SELECT paper_id, CAST(own AS BIGINT) AS ord, text, array_to_string(fonts, ',') AS fonts, NOT alone AS merged FROM merged")
def short_block_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.merge_short_blocks(font_blocks(spark, sf_dir))
    return m.select("paper_id", "ord", "text", F.array_join("fonts", ",").alias("fonts"), "merged")


_islands = f"""cls AS (SELECT paper_id, ord, {strip_sql('text')} AS text, page, y0, y1, {_block_formula} AS f FROM src),
brk AS (SELECT *, CASE WHEN f AND coalesce(lag(f) OVER w, FALSE) AND lag(page) OVER w = page AND abs(y0 - lag(y1) OVER w) < 30 THEN 0 ELSE 1 END AS b FROM cls WINDOW w AS (PARTITION BY paper_id ORDER BY ord)),
isl AS (SELECT *, sum(b) OVER (PARTITION BY paper_id ORDER BY ord) AS island FROM brk),
joined AS (SELECT paper_id, min(ord) AS ord, string_agg(text, ' ' ORDER BY ord) AS text, bool_or(f) AS f FROM isl GROUP BY paper_id, island)"""


@query(f"WITH {_fonts}, src AS (SELECT * FROM fb), {_islands} SELECT paper_id, ord, text, f AS is_formula FROM joined")
def formula_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.formula_islands(font_blocks(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_fonts}, {_merged}, src AS (SELECT paper_id, own AS ord, text, fonts, CASE WHEN alone THEN page ELSE 0 END AS page, CASE WHEN alone THEN y0 ELSE 0 END AS y0, CASE WHEN alone THEN y1 ELSE 0 END AS y1 FROM merged),
{_islands}, kept2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id, f ORDER BY ord) - 1 AS INTEGER) AS n FROM joined WHERE length(text) >= CASE WHEN f THEN 10 ELSE 5 END)
SELECT paper_id, CASE WHEN f THEN 'formula' ELSE 'text' END AS kind, n AS ord, CASE WHEN f THEN 'f' ELSE 'c' END || n AS element_id, text FROM kept2"""
)
def font_block_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.font_block_elements(font_blocks(spark, sf_dir))


@query(
    """WITH d AS (SELECT CAST(o_orderkey AS VARCHAR) AS paper_id, list_value(o_orderpriority, ' ', 'second') AS texts, CASE WHEN o_orderkey % 2 = 0 THEN list_value('| a |') ELSE [] END AS tables FROM orders)
SELECT paper_id, 'text' AS kind, 0 AS ord, 'c0' AS element_id, texts[1] AS text FROM d UNION ALL SELECT paper_id, 'text', 1, 'c1', 'second' FROM d
UNION ALL SELECT paper_id, 'table', 0, 't0', tables[1] FROM d WHERE len(tables) > 0 UNION ALL SELECT paper_id, 'figure', 0, 'fig0', '' FROM d"""
)
def structured_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    docs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("paper_id"), F.array("o_orderpriority", F.lit(" "), F.lit("second")).alias("texts"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("| a |"))).otherwise(none).alias("tables"), F.array(F.lit("picture")).alias("pictures"),
    )
    return adapters.structured_elements(docs)


_ocr = "SELECT concat('p', o_orderkey // 8) AS paper_id, CAST(o_orderkey % 8 // 4 AS INTEGER) AS page_idx, CAST(o_orderkey % 4 AS INTEGER) AS no, CASE WHEN o_custkey % 5 = 0 THEN ' ' ELSE o_orderpriority END AS text, CASE o_custkey % 3 WHEN 0 THEN 'Figure' WHEN 1 THEN 'Table' ELSE 'Text' END AS label, o_custkey FROM orders"


@query(
    f"""WITH o AS ({_ocr}), lines_ AS (SELECT * FROM o WHERE o_custkey % 2 = 0), regions AS (SELECT * FROM o WHERE o_custkey % 2 = 1),
pages_ AS (SELECT DISTINCT paper_id, page_idx FROM lines_ INTERSECT SELECT DISTINCT paper_id, page_idx FROM regions),
u AS (SELECT paper_id, 'text' AS kind, page_idx, no, text FROM lines_ SEMI JOIN pages_ USING (paper_id, page_idx) WHERE {strip_sql('text')} <> ''
  UNION ALL SELECT paper_id, lower(label), page_idx, no, '' FROM regions SEMI JOIN pages_ USING (paper_id, page_idx) WHERE label IN ('Figure', 'Table')),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id, kind ORDER BY page_idx, no) - 1 AS INTEGER) AS ord FROM u)
SELECT paper_id, kind, ord, CASE kind WHEN 'text' THEN 'c' WHEN 'figure' THEN 'fig' ELSE 't' END || ord AS element_id, text, CAST(page_idx + 1 AS INTEGER) AS page FROM n"""
)
def ocr_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = over(spark, _ocr.replace("//", "div").replace("INTEGER", "INT"), table(spark, sf_dir, "orders"), "orders")
    lines = o.where("o_custkey % 2 = 0").select("paper_id", "page_idx", F.col("no").alias("line_no"), "text")
    regions = o.where("o_custkey % 2 = 1").select("paper_id", "page_idx", F.col("no").alias("region_no"), "label")
    return adapters.ocr_elements(lines, regions)
