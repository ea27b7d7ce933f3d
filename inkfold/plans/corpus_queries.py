"""Chunking, quality, identifiers and evaluation sets over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.modality import modality_of_id, paper_of_id
from ..operators import chunking, evalset, quality, routing, statistics
from ..sources import tables
from .fixtures import CHUNKS, IDS, corpus, duck_values, literal_rows, over, strip_sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, CAST(s AS INTEGER) AS start_, CAST(e AS INTEGER) AS end_, content FROM chunks")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("chunk_id", F.col("start").alias("start_"), F.col("end").alias("end_"), "content")


@query(
    f"""WITH RECURSIVE {CHUNKS} SELECT count(*) AS n, CAST(min(length(content)) AS INTEGER) AS min_len,
CAST(max(length(content)) AS INTEGER) AS max_len, CAST(sum(length(content)) // count(*) AS BIGINT) AS avg_len FROM chunks"""
)
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.length_stats(corpus(spark, sf_dir))


@query(f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, content FROM chunks WHERE length({strip_sql('content')}) >= 50")
def chunk_min_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).withColumn("modality", F.lit("text"))
    return chunking.without_fragments(rows).select("chunk_id", "content")


_suffix = "regexp_extract(chunk_id, '[^:]*$')"
_table = f"WHEN starts_with({_suffix}, 'tbl') THEN 'table'"
_base = f"CASE WHEN starts_with({_suffix}, 'fig') THEN 'figure' {_table}"
_row = f"WHEN regexp_matches({_suffix}, '^r[0-9]+$') THEN 'table'"
_formula = f"WHEN regexp_matches({_suffix}, '^f[0-9]+$') THEN 'formula'"
MODALITY = f"{_base} {_row} {_formula} ELSE 'text' END"
BUILDER = (
    f"{_base} {_row} {_formula} WHEN regexp_matches({_suffix}, '^c[0-9]+$') THEN 'text' WHEN contains(lower(chunk_id), 'fig') THEN 'figure' "
    "WHEN contains(lower(chunk_id), 'tbl') OR contains(lower(chunk_id), 'table') THEN 'table' ELSE 'text' END"
)
#: Chunks with identifiers of every modality, from the keys of documents.
_mixed_sql = """SELECT CAST(doc_id AS VARCHAR) || CASE doc_id % 7 WHEN 0 THEN ':fig_p1_i0' WHEN 1 THEN ':tbl_p0_t1:r3' WHEN 2 THEN ':t0:r2' WHEN 3 THEN ':f4'
ELSE ':c' || doc_id % 5 END AS chunk_id, text AS content, doc_id AS ord FROM documents"""
MIXED = f"mixed AS ({_mixed_sql})"


def mixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(spark, _mixed_sql.replace("AS VARCHAR", "AS STRING"), table(spark, sf_dir, "documents"), "documents")


@query(
    f"WITH t AS ({duck_values([(x,) for x in IDS], 'chunk_id')}), a AS (SELECT chunk_id FROM t UNION ALL SELECT chunk_id FROM ({_mixed_sql}))"
    f" SELECT chunk_id, {MODALITY} AS report, {BUILDER} AS builder, {_base} {_formula} ELSE 'text' END AS stats FROM a"
)
def modality_from_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = literal_rows(spark, [(x,) for x in IDS], "chunk_id").select("chunk_id").union(mixed_chunks(spark, sf_dir).select("chunk_id"))
    return ids.select("chunk_id", *[modality_of_id(F.col("chunk_id"), r).alias(r) for r in ("report", "builder", "stats")])


@query(
    f"""WITH {MIXED}, c AS (SELECT {MODALITY} AS modality, count(*) AS n FROM mixed GROUP BY 1)
SELECT m.modality, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (SELECT count(*) FROM mixed), 6) AS share
FROM (VALUES ('text'), ('figure'), ('table'), ('formula')) AS m(modality) LEFT JOIN c USING (modality)"""
)
def modality_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.modality_distribution(mixed_chunks(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(
    f"""WITH RECURSIVE {CHUNKS}, p AS (SELECT paper_id, count(*) AS n FROM chunks GROUP BY 1)
SELECT count(*) AS n_papers, round(avg(n), 6) AS avg_chunks, max(n) AS max_chunks, min(n) AS min_chunks FROM p"""
)
def paper_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.per_paper_stats(corpus(spark, sf_dir)).withColumn("avg_chunks", F.round("avg_chunks", 6))


def _histogram(edges: tuple[int, ...]) -> str:
    case = "CASE " + " ".join(f"WHEN length(content) < {e} THEN {i}" for i, e in enumerate(edges)) + f" ELSE {len(edges)} END"
    return f"""WITH RECURSIVE {CHUNKS}, h AS (SELECT {case} AS bucket, count(*) AS n FROM chunks GROUP BY 1)
SELECT CAST(b.bucket AS INTEGER) AS bucket, coalesce(h.n, 0) AS n FROM range(0, {len(edges) + 1}) AS b(bucket) LEFT JOIN h ON h.bucket = b.bucket"""


@query(_histogram(quality.EDGES_4))
def length_histogram_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.length_histogram(corpus(spark, sf_dir), quality.EDGES_4)


@query(_histogram(quality.EDGES_5))
def length_histogram_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.length_histogram(corpus(spark, sf_dir), quality.EDGES_5)


#: Every document, and beside it a row that is garbled, empty, a formula or short.
_flags_sql = """SELECT CAST(doc_id * 17 AS VARCHAR) AS paper_id, CAST(doc_id * 17 AS VARCHAR) || ':c0' AS chunk_id, text AS content, doc_id * 2 AS ord FROM documents
UNION ALL SELECT CAST(doc_id * 17 AS VARCHAR), CAST(doc_id * 17 AS VARCHAR) || CASE doc_id % 2 WHEN 0 THEN ':c1' ELSE ':f1' END,
CASE doc_id % 4 WHEN 0 THEN repeat('é∑', CAST(doc_id % 40 AS INTEGER)) || lang WHEN 1 THEN '' WHEN 2 THEN 'x^{2} and y' ELSE 'short ' || lang END, doc_id * 2 + 1 FROM documents"""
_odd = r"length(regexp_replace(content, '[\x00-\x7F]', '', 'g'))"
_garbled = f"CASE WHEN content = '' THEN TRUE ELSE {_odd} / length(content) > 0.3 END"
_formula_like = r"(contains(content, '^{') OR contains(content, '_{') OR contains(content, '\frac') OR contains(content, '\sum')) AND length(content) < 300"


def flagged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(spark, _flags_sql.replace("AS VARCHAR", "AS STRING"), table(spark, sf_dir, "documents"), "documents")


@query(
    f"""WITH f AS ({_flags_sql}) SELECT chunk_id, {_garbled} AS garbled, CASE WHEN content = '' THEN FALSE ELSE {_garbled} END AS garbled_text_only,
length(content) < 50 AS fragment, {_formula_like} AS formula_like, NOT starts_with(paper_id, '2') AS odd_paper FROM f"""
)
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return flagged_chunks(spark, sf_dir).select(
        "chunk_id", quality.garbled(c).alias("garbled"), quality.garbled(c, empty=False).alias("garbled_text_only"),
        quality.fragment(c).alias("fragment"), quality.formula_like(c).alias("formula_like"), quality.odd_paper_id(F.col("paper_id")).alias("odd_paper"),
    )


@query(
    f"""WITH chunks AS ({_flags_sql}) SELECT count(*) AS n_chunks, count(DISTINCT paper_id) AS n_papers, count(*) FILTER ({_garbled}) AS n_garbled,
count(*) FILTER (length(content) < 50) AS n_fragments, count(*) FILTER ({_formula_like}) AS n_formula_like,
count(*) FILTER (NOT starts_with(paper_id, '2')) AS n_odd_ids, count(*) FILTER ({MODALITY} = 'text') AS n_text FROM chunks"""
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(flagged_chunks(spark, sf_dir)).select("totals.*", "anomalies.*", F.col("modalities")["text"].alias("n_text"))


#: Every document on four pages, and beside it one with formulas (f), one with blank pages (b) and one without pages (n).
_route_sql = """SELECT CAST(doc_id AS VARCHAR) || v.kind AS paper_id, v.kind, d.text FROM documents d CROSS JOIN (VALUES (''), ('f'), ('b'), ('n')) AS v(kind)"""
_pages_sql = """SELECT paper_id, page_no, CASE kind WHEN 'f' THEN replace(t, 'e', '_{') WHEN 'b' THEN '  ' ELSE t END AS text
FROM (SELECT *, substr(text, 1 + page_no * CAST(ceil(length(text) / 4) AS INTEGER), CAST(ceil(length(text) / 4) AS INTEGER)) AS t
FROM (ROUTED) r CROSS JOIN (VALUES (0), (1), (2), (3)) AS p(page_no) WHERE kind <> 'n') x"""


@query(
    f"""WITH pages_ AS ({_pages_sql.replace('ROUTED', _route_sql)}), s AS (SELECT paper_id, count(*) AS n, sum(length({strip_sql('text')})) AS st, sum(length(text)) AS al,
sum(list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda l: contains(l, '\\frac') OR contains(l, '\\sum') OR contains(l, '_{{') OR contains(l, '^{{') OR contains(l, '\\int')), lambda l: length(l)))) AS m
FROM pages_ WHERE page_no < 3 GROUP BY 1),
r AS (SELECT d.paper_id, coalesce(st, 0) / greatest(coalesce(n, 0), 1) < 50 AS scanned, coalesce(m, 0) / greatest(coalesce(al, 0), 1) AS density
FROM ({_route_sql}) d LEFT JOIN s ON s.paper_id = d.paper_id)
SELECT paper_id, scanned, round(density, 6) AS formula_density, CASE WHEN scanned THEN 'surya' WHEN density > 0.05 THEN 'mineru' ELSE 'docling' END AS parser FROM r"""
)
def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    all_ = _route_sql.replace("AS VARCHAR", "AS STRING")
    routed = routing.route(over(spark, all_, docs, "documents").select("paper_id"), over(spark, _pages_sql.replace("ROUTED", all_), docs, "documents"))
    return routed.withColumn("formula_density", F.round("formula_density", 6))


@query(
    f"""WITH RECURSIVE {CHUNKS}, r AS (SELECT *, md5('7:' || chunk_id) AS r FROM chunks), f AS (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY r, chunk_id) > 2 AS INTEGER) AS fill FROM r),
t AS (SELECT * FROM f ORDER BY fill, r, chunk_id LIMIT 100)
SELECT chunk_id, content, CAST(row_number() OVER (ORDER BY md5('8:' || chunk_id), chunk_id) AS INTEGER) AS position FROM t"""
)
def diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalset.diverse_sample(corpus(spark, sf_dir), 100)


@query(
    f"""WITH {MIXED}, k AS (SELECT *, {BUILDER} AS modality, regexp_extract(chunk_id, '^[^:]*') AS paper FROM mixed),
q(modality, quota, least) AS (VALUES ('text', 60, 200), ('figure', 15, 10), ('table', 15, 10), ('formula', 10, 5)),
p AS (SELECT k.*, q.quota, min(ord) OVER (PARTITION BY k.modality, paper) AS f, row_number() OVER (PARTITION BY k.modality, paper ORDER BY md5('7:' || chunk_id), chunk_id) AS n
FROM k JOIN q ON q.modality = k.modality WHERE length(content) >= least),
o AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY f, paper, n) AS i FROM p WHERE n <= 2)
SELECT chunk_id, content, modality FROM o WHERE i <= quota"""
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalset.stratified_sample(mixed_chunks(spark, sf_dir), 100)


_first = strip_sql("string_split(content, '.')[1]")


@query(
    f"""WITH RECURSIVE {CHUNKS} SELECT chunk_id, 'According to the paper, what does this passage describe: ' ||
CASE WHEN length({_first}) > 80 THEN substr({_first}, 1, 80) || '...' ELSE {_first} END || '?' AS question FROM chunks"""
)
def template_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("chunk_id", evalset.template_question(F.col("content")).alias("question"))


@query(
    f"""WITH RECURSIVE {CHUNKS}, f AS (SELECT paper_id, min(ord) AS ord FROM chunks WHERE length(content) > 100 GROUP BY 1 ORDER BY 2 LIMIT 20)
SELECT f.paper_id, substr(c.content, 1, 150) AS snippet FROM f JOIN chunks c ON c.ord = f.ord"""
)
def topic_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalset.topic_snippets(corpus(spark, sf_dir))


#: Questions with near copies: every benchmark item, and again with its first words cut off.
_asked = "SELECT item_id * 2 AS query_id, text AS question FROM benchmark UNION ALL SELECT item_id * 2 + 1, substr(text, 30) FROM benchmark"
_tokens = "list_distinct(regexp_extract_all(lower(question), '[a-z]{4,}'))"
_shared = "len(list_intersect(a.t, b.t))"


def near_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(spark, _asked, table(spark, sf_dir, "benchmark"), "benchmark")


@query(
    f"""WITH q AS (SELECT query_id, {_tokens} AS t FROM ({_asked})), p AS (SELECT a.query_id AS a, b.query_id AS b, {_shared} / (len(a.t) + len(b.t) - {_shared}) AS j
FROM q a JOIN q b ON a.query_id < b.query_id WHERE {_shared} > 0) SELECT a, b, round(j, 6) AS jaccard FROM p WHERE j > 0.5"""
)
def similar_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalset.similar_questions(near_questions(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 6))


@query(
    f"""WITH RECURSIVE q AS (SELECT query_id, question, {_tokens} AS t, row_number() OVER (ORDER BY query_id) AS n FROM ({_asked})),
r(n, query_id, accepted, kept) AS (
  SELECT n, query_id, TRUE, [t] FROM q WHERE n = 1
  UNION ALL
  SELECT q.n, q.query_id, ok, CASE WHEN ok THEN list_append(r.kept, q.t) ELSE r.kept END
  FROM (SELECT r.*, q.n AS m, NOT coalesce(list_bool_or(list_transform(r.kept, lambda x: len(x) > 0 AND len(q.t) > 0
          AND len(list_intersect(x, q.t)) / (len(x) + len(q.t) - len(list_intersect(x, q.t))) > 0.5)), FALSE) AS ok FROM r JOIN q ON q.n = r.n + 1) r
  JOIN q ON q.n = r.m)
SELECT r.query_id, q.question, r.accepted FROM r JOIN q ON q.n = r.n"""
)
def near_duplicate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalset.reject_near_duplicates(near_questions(spark, sf_dir))




@query(
    f"""WITH {MIXED}, m AS (SELECT {MODALITY} AS modality, length(content) AS n FROM mixed)
SELECT modality, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_chars, CAST(min(n) AS BIGINT) AS min_len, CAST(max(n) AS BIGINT) AS max_len,
array_to_string([{', '.join(f"count(*) FILTER (n >= {a} AND n < {b})" for a, b in zip((0, *quality.EDGES_5), (*quality.EDGES_5, 10**18)))}], ' ') AS histogram, TRUE AS close FROM m GROUP BY 1"""
)
def merged_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of sixteen batches, written and merged: the exact ones, and whether quantiles and numbers of papers are within their bounds."""
    chunks = tables.stored(mixed_chunks(spark, sf_dir), "statistics-chunks")
    batches = statistics.of_batch(chunks.withColumn("batch", F.pmod(F.xxhash64("chunk_id"), F.lit(16))), "batch")
    whole = statistics.merged(tables.stored(batches, "statistics"))
    at = statistics.estimates(whole, (0.5, 0.9))
    rows = chunks.select(modality_of_id(F.col("chunk_id")).alias("modality"), paper_of_id(F.col("chunk_id")).alias("_p"), F.length("content").alias("_n"))
    rows = rows.join(F.broadcast(at.select("modality", "quantiles")), "modality")  # four rows
    under = lambda i, strict: F.avg((F.col("_n") < F.get("quantiles", F.lit(i)) if strict else F.col("_n") <= F.get("quantiles", F.lit(i))).cast("double"))
    e = statistics.RANK_ERROR
    exact = rows.groupBy("modality").agg(
        F.countDistinct("_p").alias("_papers"), *[((under(i, True) <= q + e) & (under(i, False) >= q - e)).alias(f"_q{i}") for i, q in enumerate((0.5, 0.9))]
    )
    close = (F.abs(F.col("n_papers") / F.col("_papers") - 1) <= statistics.PAPER_ERROR) & F.col("_q0") & F.col("_q1")
    return at.join(exact, "modality").select(
        "modality", "n_chunks", "n_chars", "min_len", "max_len", F.array_join(F.col("histogram").cast("array<string>"), " ").alias("histogram"), close.alias("close")
    )
