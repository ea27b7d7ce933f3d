"""Parsers, adapters, chunk kinds, stores, reports and plug-ins, each as one query over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formula as fm
from ..functions import modality as md
from ..operators import adapters, answer, chunking, embedding, evalset, evaluate, overlap, quality, retrieval
from ..sources import html, parsers, readers, tables, writers
from . import layout_queries as lq
from . import retrieval_queries as rq
from .corpus_queries import MIXED, MODALITY, mixed_chunks
from .fixtures import CHUNKS, DUCK_SPACE, corpus, duck_values, questions, stored_corpus, strip_sql, table, words_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- documents and parsers ----
def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its text: path, paper_id, content, length, modificationTime."""
    k = F.col("doc_id")
    return tables.spread(table(spark, sf_dir, "documents")).select(
        F.concat(F.lit("/papers/"), k.cast("string"), F.lit(".pdf")).alias("path"), k.cast("string").alias("paper_id"), F.col("text").cast("binary").alias("content"),
        F.octet_length("text").cast("long").alias("length"), F.timestamp_seconds(k).alias("modificationTime"),
    )


def _mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file of its markup, and every document as one of its text; French ones are written in UTF-16."""
    pages = tables.spread(table(spark, sf_dir, "pages")).select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("paper_id"), F.col("html").cast("binary").alias("content"))
    docs = tables.spread(table(spark, sf_dir, "documents"))
    body = F.when(F.col("lang") == "fr", F.encode("text", "UTF-16")).otherwise(F.col("text").cast("binary"))
    both = pages.unionByName(docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("paper_id"), body.alias("content")))
    return both.select(F.concat(F.lit("/in/"), "paper_id").alias("path"), "paper_id", "content")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.stored(readers.parse_documents(_mixed_files(spark, sf_dir), "html"), "parsed")


#: Pages as blocks: markup that is left out goes, then the text between two tags of blocks has the kind of the tag before it.
_tags = "|".join((*html.KINDS, *html.CONTAINERS))
_kinds = " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in html.KINDS.items())
_unescape = "replace(replace(replace(replace(regexp_replace({}, '&amp$', '&'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_squeezed = f"trim(regexp_replace({_unescape.format('x')}, '[{DUCK_SPACE}]+', ' ', 'g'))"
PAGES = f"""clean AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^<>]*$', ''), '<!--.*?-->', '', 'gs'), '<(script|style)>.*?</(script|style)>', '', 'gs'), '<br>', ' ', 'g') AS h FROM pages),
cutup AS (SELECT page_id, regexp_split_to_array(h, '</?(?:{_tags})(?:\\s[^>]*)?>') AS texts, [''] || regexp_extract_all(h, '<(/?(?:{_tags}))(?:\\s[^>]*)?>', 1) AS tags FROM clean),
strips AS (SELECT page_id, i, CASE tags[i] {_kinds} ELSE 'loose' END AS kind, regexp_replace(texts[i], '<[^>]*>', '', 'g') AS x FROM cutup, unnest(range(1, len(texts) + 1)) AS u(i)),
page_blocks AS (SELECT page_id, i, kind, {_squeezed} AS text FROM strips WHERE {_squeezed} <> ''),
page_parts AS (SELECT 'page' || page_id AS paper_id, i, kind, text, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS section FROM page_blocks)"""


@query(
    f"""WITH {PAGES}, links AS (SELECT 'page' || page_id AS paper_id, u.n - 1 AS n, hrefs[u.n] AS text FROM (SELECT page_id, regexp_extract_all(h, '<a href="([^"]*)">', 1) AS hrefs FROM clean), unnest(range(1, len(hrefs) + 1)) AS u(n))
SELECT paper_id, kind, row_number() OVER (PARTITION BY paper_id, kind ORDER BY i) - 1 AS n, text, section FROM page_parts
UNION ALL SELECT paper_id, 'link', n, {_unescape.format('text')}, NULL FROM links"""
)
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, headings, paragraphs, list items, loose texts and links of every page."""
    e = readers.parse_documents(_mixed_files(spark, sf_dir).where("startswith(paper_id, 'page')"), "html")
    n = F.regexp_extract("element_id", "([0-9]+)$", 1).cast("long")
    return e.select("paper_id", "kind", n.alias("n"), "text", F.when(F.col("kind") != "link", F.col("section")).alias("section"))


@query(
    f"""WITH {PAGES}, parts AS (SELECT paper_id || ' ' || kind || ' ' || (row_number() OVER (PARTITION BY paper_id, kind ORDER BY i) - 1) AS id, text FROM page_parts), {rq._vectors('vec', 'parts', 'id', 'text')}
SELECT id, bucket, round(CAST(weight AS DOUBLE), 5) AS weight FROM vec"""
)
def embedded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of every page parsed and embedded in the same tasks, the one ahead of the other."""
    pages = _mixed_files(spark, sf_dir).where("startswith(paper_id, 'page')")
    e = overlap.parse_and_embed(pages, "html", embedding.hash_embedder).where("kind <> 'link'")
    n = F.row_number().over(Window.partitionBy("paper_id", "kind").orderBy("ord")) - 1
    e = e.select(F.concat_ws(" ", "paper_id", "kind", n.cast("string")).alias("id"), "embedding").select("id", F.posexplode("embedding").alias("bucket", "weight"))
    return e.where("weight <> 0").select("id", "bucket", F.round(F.col("weight").cast("double"), 5).alias("weight"))


#: A file in UTF-16 begins with a mark that UTF-8 doesn't have.
_unread = "lang = 'fr'"


@query(
    f"""WITH {PAGES} SELECT paper_id, 'html' AS engine, NULL AS error, n + len(regexp_extract_all(h, '<a href="')) AS n_elements
FROM (SELECT paper_id, count(*) AS n FROM page_parts GROUP BY 1) JOIN (SELECT 'page' || page_id AS paper_id, h FROM clean) USING (paper_id)
UNION ALL SELECT 'doc' || doc_id, CASE WHEN {_unread} THEN NULL ELSE 'utf8' END, CASE WHEN {_unread} THEN 'html: UnicodeDecodeError; utf8: UnicodeDecodeError' END, 1 FROM documents"""
)
def parser_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are parsed as such, plain texts by the stand-in, and a file that neither can read gives one row with both errors."""
    kinds = F.regexp_replace("error", r"(\w+: \w+): [^;]*", "$1")
    return _parsed(spark, sf_dir).groupBy("paper_id", "engine", kinds.alias("error")).agg(F.count(F.lit(1)).alias("n_elements"))


_whole = f"SELECT 'doc' || doc_id AS paper_id, text AS markdown FROM documents WHERE NOT {_unread}"
_sections = f"""b AS (SELECT paper_id, i, {strip_sql('string_split(markdown, chr(10) || chr(10))[i]')} AS block FROM ({_whole}) m, unnest(range(1, len(string_split(markdown, chr(10) || chr(10))) + 1)) AS u(i)),
h AS (SELECT *, starts_with(block, '#') AS head, last_value(CASE WHEN starts_with(block, '#') THEN {strip_sql("regexp_replace(block, '^#+', '')")} END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY i) AS section
FROM b WHERE block <> '')"""


@query(
    f"""WITH {PAGES}, {_sections}
SELECT 'mineru' AS parser, paper_id, CAST(NULL AS VARCHAR) AS kind, row_number() OVER (PARTITION BY paper_id ORDER BY i) - 1 AS ord, block AS text, section FROM h WHERE NOT head
UNION ALL SELECT 'html', paper_id, 'text', row_number() OVER (PARTITION BY paper_id ORDER BY i) - 1, text, section FROM page_parts WHERE kind IN ('text', 'item', 'loose')"""
)
def adapted_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each engine gave, through its adapter, as one table."""
    e = adapters.adapt(parsers.records(_parsed(spark, sf_dir)))
    return e.select("parser", "paper_id", "kind", F.col("ord").cast("long").alias("ord"), "text", "section")


@query(
    """SELECT '/papers/' || doc_id || '.pdf' AS path FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0"""
)
def files_to_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a cache misses: a third is not in it, and a fifth has changed since."""
    files = _files(spark, sf_dir)
    k = F.col("paper_id").cast("long")
    cached = files.where(k % 3 != 0).withColumn("length", F.when(k % 5 == 0, F.col("length") + 1).otherwise(F.col("length")))
    return readers.new_files(files, cached).select("path")


@query(
    f"""WITH {PAGES} SELECT paper_id, 'span' AS kind, count(*) AS n, CAST(NULL AS VARCHAR) AS error FROM page_parts GROUP BY 1
UNION ALL SELECT 'page' || page_id, 'link', len(regexp_extract_all(h, '<a href="')), NULL FROM clean WHERE contains(h, '<a href="')
UNION ALL SELECT 'doc' || doc_id, 'error', 1, CASE WHEN {_unread} THEN 'UnicodeDecodeError' ELSE 'ValueError' END FROM documents"""
)
def page_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of every page; a file that is no page, or can't be decoded, gives its error."""
    raw = parsers.extract_pages(_mixed_files(spark, sf_dir), html.raw_rows)
    return raw.groupBy("paper_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max(F.regexp_extract("error", r"^(\w+)", 1)).alias("error"))


@query("SELECT '2610.' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, doc_id % 11 <> 0 AS ok FROM documents")
def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of every paper are one download; those that fail say so."""

    def fetch():
        def get(name: str) -> bytes:
            if int(name[5:]) % 11 == 0:
                raise OSError(name)
            return name.encode()

        return get

    def store():
        held: dict[str, bytes] = {}
        return lambda name, body: name in held if body is None else bool(held.setdefault(name, body))

    v = F.concat(F.lit("2610."), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit("v"))
    docs = table(spark, sf_dir, "documents")
    listing = docs.select(F.concat(v, F.lit("1")).alias("id")).union(docs.select(F.concat(v, F.lit("2"))))
    return writers.download(listing, fetch, store)


@query("SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of a folder, read whole, and the lines in them."""
    path = tables.shared_folder(spark, "folder")
    tables.spread(table(spark, sf_dir, "documents")).select("text").write.text(path)
    body = F.col("content").cast("string")
    lines = readers.document_files(spark, path, "*.txt").select(F.explode(F.split(F.substr(body, F.lit(1), F.length(body) - 1), "\n")).alias("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


# ---- chunks of every kind and their embeddings ----
def _all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.spread(table(spark, sf_dir, "documents"))
    paper = F.col("doc_id").cast("string").alias("paper_id")
    none = F.lit(None).cast("string")
    texts = docs.select(paper, F.lit(0).alias("ord"), "text", F.col("lang").alias("section"))
    figures = docs.select(paper, F.lit("fig1").alias("fig_id"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")).alias("caption"), none.alias("image_uri"))
    grid = F.concat(F.lit("| lang | chars |\n| --- | --- |\n| "), "lang", F.lit(" | "), F.col("n_chars").cast("string"), F.lit(" |"))
    grids = docs.select(paper, F.lit("t0").alias("table_id"), grid.alias("markdown"), F.lit("size").alias("caption"))
    formulas = docs.select(paper, F.lit("f0").alias("formula_id"), F.concat(F.lit("x^{"), F.col("n_chars").cast("string"), F.lit("}")).alias("latex"))
    return chunking.document_chunks(texts, figures, grids, formulas)


_kinds = f"""kinds AS (SELECT chunk_id, 'text' AS modality, content, d.lang AS section FROM chunks c JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.paper_id
UNION ALL SELECT doc_id || ':fig1', 'figure', CASE WHEN doc_id % 2 = 0 OR source = '' THEN 'Figure fig1' ELSE source END, NULL FROM documents
UNION ALL SELECT doc_id || ':t0:r0', 'table', 'table (size): lang=' || lang || ', chars=' || n_chars, NULL FROM documents
UNION ALL SELECT doc_id || ':f0', 'formula', 'x^{{' || n_chars || '}}', NULL FROM documents)""".replace("{{", "{").replace("}}", "}")


@query(f"WITH RECURSIVE {CHUNKS}, {_kinds} SELECT chunk_id, modality, content, section FROM kinds")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, figure, table and formula chunks of every document."""
    return _all_chunks(spark, sf_dir).select("chunk_id", "modality", "content", "section")


_embedded = """emb AS (SELECT chunk_id, CASE modality WHEN 'formula' THEN 'formula: x to the power of ' || substr(content, 4, length(content) - 4) WHEN 'table' THEN 'table:  ' || content ELSE content END AS t FROM kinds)"""


@query(
    f"""WITH RECURSIVE {CHUNKS}, {_kinds}, {_embedded}, {rq._vectors('vec', 'emb', 'chunk_id', 't')}
SELECT chunk_id, bucket, round(CAST(weight AS DOUBLE), 5) AS weight FROM vec"""
)
def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of every chunk by a plugged model in the workers; without its library, hash embeddings stand in."""
    vectors = embedding.embed_chunks(_all_chunks(spark, sf_dir), embedding.model_or_hash("no/such-model"), batch=32)
    each = vectors.select("chunk_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight <> 0")
    return each.select("chunk_id", "bucket", F.round(F.col("weight").cast("double"), 5).alias("weight"))


@query(
    f"""WITH p AS (SELECT row_number() OVER () AS id, a.text AS a, b.text AS b FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
w AS (SELECT id, 1 AS side, unnest({words_sql('a')}) AS t FROM p UNION ALL SELECT id, 2, unnest({words_sql('b')}) FROM p),
v AS (SELECT id, side, md5_number_upper(t) % 384 AS k, count(*) AS n FROM w GROUP BY 1, 2, 3), u AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY id, side)) AS x FROM v),
d AS (SELECT y.id, sum(y.x * z.x) AS s FROM u y JOIN u z ON y.id = z.id AND y.k = z.k AND y.side = 1 AND z.side = 2 GROUP BY 1)
SELECT p.a, p.b, 'float32' AS dtype, round(coalesce(d.s, 0), 4) AS similarity FROM p LEFT JOIN d USING (id)"""
)
def pair_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look at the embedder: every turn of a conversation beside the next one."""
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    pairs = turns.join(after, ["conv_id", "turn"]).select(F.col("text").alias("a"), "b")
    return embedding.pair_similarities(spark, embedding.hash_embedder, pairs).withColumn("similarity", F.round("similarity", 4))


@query(
    f"""SELECT CAST(id AS BIGINT) AS id, {lq.formula_sql('text', '1', f'CAST({lq._math} AS INTEGER)')} AS is_formula FROM ({lq._formula_rows})"""
)
def formula_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on single spans, each with its one font."""
    rows = lq.formulas(spark, sf_dir)
    return rows.select(F.col("id").cast("long").alias("id"), fm.is_formula_span(F.col("font"), F.col("text")).alias("is_formula"))


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS paper_id, 'figure' AS kind, 'fig' || o_orderkey AS element_id, o_orderpriority AS text, CAST(o_orderkey % 9 AS INTEGER) AS page FROM orders
UNION ALL SELECT CAST(l_suppkey AS VARCHAR), 'table', 't' || l_orderkey || '_' || l_linenumber, '| ' || l_quantity || ' |', CAST(l_linenumber AS INTEGER) FROM lineitem"""
)
def passed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and tables that need no adapting."""
    page = lambda c: c.cast("int").alias("page")
    figures = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("paper_id"), F.concat(F.lit("fig"), F.col("o_orderkey").cast("string")).alias("fig_id"), F.col("o_orderpriority").alias("caption"), page(F.col("o_orderkey") % 9)
    )
    grids = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("paper_id"), F.concat_ws("_", F.concat(F.lit("t"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string")).alias("table_id"),
        F.concat(F.lit("| "), F.col("l_quantity").cast("string"), F.lit(" |")).alias("markdown"), page(F.col("l_linenumber")),
    )
    return adapters.passed_through(figures, grids)


@query(f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, CAST(length(content) AS INTEGER) AS length, substr(content, 1, 300) AS head FROM chunks ORDER BY ord LIMIT 5")
def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.head_sample(corpus(spark, sf_dir))


# ---- stores ----
@query(f"WITH RECURSIVE {CHUNKS}, {rq._tokens}, {rq._asked}, {rq._sparse(10)} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM sparse10")
def bm25_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse index written, read again and searched."""
    path = tables.shared_folder(spark, "sparse-index")
    retrieval.build_sparse(stored_corpus(spark, sf_dir)).write(path, 8)
    hits = retrieval.search_sparse(retrieval.SparseIndex.read(spark, path), questions(spark, sf_dir))
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, paper_id, ord, content FROM chunks")
def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus written and read as a chunk corpus."""
    path = tables.shared_folder(spark, "corpus")
    corpus(spark, sf_dir).select("chunk_id", "paper_id", "ord", "content").write.parquet(path)
    return readers.chunk_corpus(spark, path)


@query(
    f"""WITH {MIXED}, {rq._vectors('vec', 'mixed', 'chunk_id', 'content')}, t AS (SELECT chunk_id, sum(CAST(weight AS DOUBLE)) AS total FROM vec GROUP BY 1)
SELECT mixed.chunk_id AS id, round(coalesce(total, 0), 4) AS total, content, {MODALITY.replace('chunk_id', 'mixed.chunk_id')} AS modality, regexp_extract(mixed.chunk_id, '^[^:]*') AS paper_id, '384' AS dimension, 'COSINE' AS metric
FROM mixed LEFT JOIN t ON t.chunk_id = mixed.chunk_id"""
)
def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reset, filled with the chunks' vectors and read; the table's name is its own, and only its files stay."""
    name, path = f"vectors_{uuid.uuid4().hex}", tables.shared_folder(spark, "vectors")
    chunks = tables.stored(mixed_chunks(spark, sf_dir), "vector-chunks")
    vectors = embedding.dense(embedding.hash_vectors(chunks, "chunk_id", "content"), "chunk_id", chunks)
    named = chunks.join(vectors, "chunk_id").select(
        "chunk_id", "embedding", "content", md.modality_of_id(F.col("chunk_id")).alias("modality"), md.paper_of_id(F.col("chunk_id")).alias("paper_id")
    )
    writers.reset_vector_table(spark, name, path=path)
    try:
        writers.insert_vectors(spark, name, writers.dense_records(named))
        said = writers.vector_table_properties(spark, name)
    finally:
        spark.sql(f"DROP TABLE {name}")
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x).cast("double")), 4)
    rows = spark.read.parquet(path).select("id", total.alias("total"), "content", "modality", "paper_id")
    return rows.withColumns({k: F.lit(v) for k, v in said.items()})


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings ORDER BY vec_id LIMIT 20")
def vector_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dump of the first vectors."""
    path = tables.shared_folder(spark, "dump")
    writers.vector_dump(table(spark, sf_dir, "embeddings"), path, key="vec_id")
    return spark.read.parquet(path).select("vec_id", F.size("embedding").alias("dim"))


# ---- answers, evaluation sets, reports ----
@query(
    f"""{rq._search(10)}, {rq._context}, first AS (SELECT b.item_id AS query_id, b.text AS question, c.score AS best, c.source_id FROM benchmark b LEFT JOIN (SELECT * FROM ctx WHERE position = 1) c ON c.query_id = b.item_id),
said AS (SELECT *, CASE WHEN source_id IS NULL OR starts_with(upper(question), 'T') THEN '' ELSE 'see [' || source_id || ']' END AS ans FROM first)
SELECT query_id, CASE WHEN best IS NULL OR best < 0.3 OR ans = '' THEN 'refused' ELSE 'answered' END AS status, CASE WHEN best IS NULL THEN 'I couldn''t find anything in the corpus that supports an answer.'
WHEN best < 0.3 THEN 'I couldn''t find anything relevant enough to answer that question.' WHEN ans = '' THEN 'The sources don''t support a reliable answer.' ELSE ans END AS answer FROM said"""
)
def plugged_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a registered generator in the workers; one that says NO_ANSWER counts as none."""

    def build():
        return lambda qs, cites: ["No_Answer: none" if not c or q.upper().startswith("T") else f"see [{c[0]['source_id']}]" for q, c in zip(qs, cites)]

    answer.register_generator("first-source", build)
    said = answer.answer_questions(questions(spark, sf_dir), rq.hits(spark, sf_dir), "first-source")
    return said.select("query_id", "status", "answer")


@query(
    """WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['a:c1', 'b:c2'] WHEN 1 THEN ['b:c2'] WHEN 2 THEN ['a:c1'] ELSE ['a:c1', 'b:c2'] END AS cited FROM documents)
SELECT doc_id, array_to_string(cited, ',') AS cited FROM d"""
)
def cited_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers that name a chunk, a section or a figure, behind every text."""
    cites = F.array(
        F.struct(F.lit("a:c1").alias("source_id"), F.lit("Methods").alias("section"), F.lit("Figure 1").alias("figure_label")),
        F.struct(F.lit("b:c2").alias("source_id"), F.lit("Results").alias("section"), F.lit("Figure 3").alias("figure_label")),
    )
    kind = F.col("doc_id") % 4
    marks = F.when(kind == 0, "[a:c1] and [ results ]").when(kind == 1, "[figure 3]").when(kind == 2, "[METHODS] but not [nothing]").otherwise("[nothing at all]")
    text = F.concat(F.translate("text", "[]", "()"), F.lit(" "), marks)
    ids = evaluate.cited_ids(text, cites, "section", "figure_label")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(ids, ",").alias("cited"))


_first = "trim(regexp_replace(regexp_extract(left(content, 1500), '^[^.!?]*'), '[{DUCK_SPACE}]+', ' ', 'g'))".replace("{DUCK_SPACE}", DUCK_SPACE)
_vouched = f"len(string_split({_first}, ' ')) >= {evalset.LEAST_WORDS}"


@query(
    f"""WITH RECURSIVE {CHUNKS}, {_kinds}, s AS (SELECT modality, {_first} <> '' AND {_vouched} AS kept FROM kinds)
SELECT modality, count(*) AS n_sampled, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_failed, round(count(*) FILTER (kept) / count(*), 6) AS success_rate FROM s GROUP BY 1"""
)
def generated_case_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases from every chunk by a writer in the workers that vouches for some and fails on others."""
    cases = evalset.generated_cases(_all_chunks(spark, sf_dir), evalset.first_sentence_writer, tries=1, wait=0)
    return evalset.build_stats(cases).withColumn("success_rate", F.round("success_rate", 6))


@query(
    f"""WITH RECURSIVE {CHUNKS}, r AS (SELECT *, md5('7:' || chunk_id) AS r FROM chunks), f AS (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY r, chunk_id) > 2 AS INTEGER) AS fill FROM r),
t AS (SELECT * FROM f ORDER BY fill, r, chunk_id LIMIT 200), p AS (SELECT *, row_number() OVER (ORDER BY md5('8:' || chunk_id), chunk_id) AS position FROM t),
q AS (SELECT chunk_id, position, {_first} AS sentence, {_first} <> '' AND {_vouched} AS kept FROM p WHERE position <= 120),
n AS (SELECT *, count(*) FILTER (kept) OVER (ORDER BY position) - CAST(kept AS INTEGER) AS before FROM q)
SELECT chunk_id, CASE WHEN sentence <> '' THEN 'Which text begins with: ' || substr(sentence, 1, 80) || '?' END AS question, kept FROM n WHERE before < 40"""
)
def bounded_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 kept cases are wanted, and at most three times as many attempts are made."""
    sample = evalset.diverse_sample(corpus(spark, sf_dir), 200).withColumn("modality", F.lit("text"))
    made = evalset.build_cases(tables.stored(sample, "sample"), evalset.first_sentence_writer, 40, wait=0)
    return made.select(F.get("gold", F.lit(0)).alias("chunk_id"), "question", "kept")


_pct = lambda c: f"CASE WHEN {c} IS NULL THEN 'n/a' ELSE format('{{:.1f}}%', {c} * 100) END"
_cut = lambda n: f"substr(regexp_replace(question, '[\\r\\n|]', ' ', 'g'), 1, {n})"


@query(
    f"""{rq._evaluation()}, r AS (SELECT res.*, b.text AS question FROM res JOIN benchmark b ON b.item_id = res.query_id)
SELECT query_id, '| ' || {_cut(50)} || ' | ' || status || ' | ' || {_pct('recall')} || ' | ' || {_pct('rr')} || ' |' AS line FROM r"""
)
def markdown_lines_of_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.report_lines(rq.results(spark, sf_dir), 50, "| %s | %s | %s | %s |")


@query(
    f"""{rq._evaluation()}, r AS (SELECT res.*, b.text AS question FROM res JOIN benchmark b ON b.item_id = res.query_id)
SELECT query_id, rpad({_cut(45)}, 45, ' ') || ' ' || rpad(status, 9, ' ') || ' ' || lpad({_pct('recall')}, 8, ' ') || ' ' || lpad({_pct('rr')}, 8, ' ') AS line FROM r"""
)
def console_lines_of_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.report_lines(rq.results(spark, sf_dir), 45, "%-45s %-9s %8s %8s")


@query(
    f"""{rq._evaluation()} SELECT count(*) AS n_cases, count(*) AS n_listed, round(avg(recall), 6) AS recall, count(*) FILTER (answerable AND status = 'answered') AS answered_answerable,
count(*) FILTER (NOT answerable AND status <> 'answered') AS refused_unanswerable FROM res"""
)
def report_of_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON report, read back."""
    results = tables.stored(rq.results(spark, sf_dir), "results")
    text = writers.json_report(evaluate.summary(results), evaluate.refusal_tally(results), results)
    shape = "aggregate struct<n_cases: bigint, recall: double>, tally struct<answered_answerable: bigint, refused_unanswerable: bigint>, cases array<struct<query_id: bigint>>"
    r = text.select(F.from_json("report", shape).alias("r"))
    return r.select("r.aggregate.n_cases", F.size("r.cases").alias("n_listed"), F.round("r.aggregate.recall", 6).alias("recall"), "r.tally.*")


@query(
    f"""{rq._evaluation()}, r AS (SELECT res.*, b.text AS question FROM res JOIN benchmark b ON b.item_id = res.query_id),
s AS (SELECT count(*) AS n_cases, avg(recall) AS recall, avg(rr) FILTER (answerable) AS mrr, count(*) FILTER (status = 'refused') AS n_refused FROM res),
h AS (SELECT unnest(range(9)) AS part, unnest(['| metric | value |', '| --- | --- |', '| n_cases | ' || n_cases || ' |', '| recall | ' || {_pct('recall')} || ' |', '| mrr | ' || {_pct('mrr')} || ' |', '| n_refused | ' || n_refused || ' |',
  '', '| question | status | recall | rr |', '| --- | --- | --- | --- |']) AS line FROM s)
SELECT part, 0 AS query_id, line FROM h UNION ALL
SELECT 100, query_id, '| ' || {_cut(50)} || ' | ' || status || ' | ' || {_pct('recall')} || ' | ' || {_pct('rr')} || ' |' FROM r"""
)
def markdown_report_of_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole Markdown report: means, then every case."""
    results = tables.stored(rq.results(spark, sf_dir), "results")
    return writers.markdown_lines(results, evaluate.summary(results)).select("place.*", "line")


@query(
    f"""{rq._evaluation()}, r AS (SELECT res.*, b.text AS question FROM res JOIN benchmark b ON b.item_id = res.query_id),
s AS (SELECT count(*) AS n_cases, count(*) FILTER (status = 'refused') AS n_refused, avg(recall) AS recall, avg(rr) FILTER (answerable) AS mrr, avg(citation_precision) AS cp, avg(citation_recall) AS cr, avg(groundedness) AS g FROM res),
h AS (SELECT unnest(range(8)) AS part, unnest(['n_cases: ' || n_cases, 'n_refused: ' || n_refused, 'recall: ' || {_pct('recall')}, 'mrr: ' || {_pct('mrr')}, 'citation_precision: ' || {_pct('cp')},
  'citation_recall: ' || {_pct('cr')}, 'groundedness: ' || {_pct('g')}, '']) AS line FROM s)
SELECT part, 0 AS query_id, line FROM h UNION ALL
SELECT 100, query_id, rpad({_cut(45)}, 45, ' ') || ' ' || rpad(status, 9, ' ') || ' ' || lpad({_pct('recall')}, 8, ' ') || ' ' || lpad({_pct('rr')}, 8, ' ') FROM r"""
)
def console_report_of_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report as plain lines."""
    results = tables.stored(rq.results(spark, sf_dir), "results")
    return writers.console_lines(results, evaluate.summary(results)).select("place.*", "line")


_demo = duck_values([(q, "x") for q, *_ in readers.DEMO_CASES], "question, x")


@query(
    f"""WITH RECURSIVE {CHUNKS}, {rq._tokens}, demo AS ({_demo}), asked AS (SELECT query_id, term, count(*) AS qf FROM (SELECT id AS query_id, unnest({words_sql('question')}) AS term FROM demo) GROUP BY 1, 2), {rq._sparse(5)}
SELECT question, id <> 2 AS answerable, chunk_id, CAST(rank AS INTEGER) AS rank FROM demo LEFT JOIN sparse5 ON query_id = id"""
)
def demo_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demo cases asked of the whole corpus: their best chunks."""
    cases = readers.demo_cases(spark).select(F.xxhash64("question").alias("query_id"), "question", "answerable")
    hits = retrieval.search_sparse(retrieval.build_sparse(stored_corpus(spark, sf_dir)), cases, 5)
    return cases.join(hits, "query_id", "left").select("question", "answerable", "chunk_id", "rank")
