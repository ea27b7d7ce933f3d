import hashlib
import json
import sys
import threading
import time
import types
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from inkfold.functions import text
from inkfold.operators import adapters, answer, chunking, embedding, evaluate, evalset, layout, quality, retrieval, routing
from inkfold.plans import retrieval_queries
from inkfold.sources import parsers, readers, tables, writers
from inkfold.streaming import pipelines


def check_windows(t, windows, size=1200, overlap=150):
    """The windows cover the text; each but the last ends where it should, and the next begins an overlap before that."""
    assert windows[0][0] == 0 and windows[-1][1] == len(t) and all(b - a <= size for a, b in windows)
    for (a, b), (c, _) in zip(windows, windows[1:]):
        tail = t[a + size - overlap : a + size]
        assert len(t) > a + size and c == b - overlap
        # the last blank of the tail, or the tail's end where it has none
        assert (" " not in tail and b == a + size) or (t[b] == " " and a + size - overlap <= b < a + size and " " not in t[b + 1 : a + size])
    assert len(t) - windows[-1][0] <= size


def test_windows(spark):
    rng = np.random.default_rng(0)
    texts = ["", "short", "x" * 1200, "x" * 1201, "y" * 5000, " " * 3000] + ["".join(rng.choice(list("abé \n"), n)) for n in (1300, 4000, 9999)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", chunking.spans(F.col("t"), F.length("t")).alias("w")).orderBy("i").collect()
    for r, t in zip(got, texts):
        w = [(x.s, x.e) for x in r.w]
        check_windows(t, w)
    pieces = chunking.split_text(df, "t").where("i = 1").collect()
    assert [(r.window, r.piece) for r in pieces] == [(0, "short")]
    assert chunking.split_text(df, "t").where("i in (0, 5)").count() == 0


def test_windows_of_a_long_text(spark):
    """4 MB of text with letters beyond ASCII, in time linear in its length."""
    texts = ["Ein paar Wörter mit Umlauten äöü. " * 120_000, "x" * 3_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    began = time.perf_counter()
    rows = chunking.split_text(df, "t").select("i", "window", "start", "end").collect()
    assert time.perf_counter() - began < 30
    for i, t in enumerate(texts):
        check_windows(t, [(a, b) for _, a, b in sorted((r.window, r.start, r.end) for r in rows if r.i == i)])
    with pytest.raises(ValueError):
        chunking.spans(F.lit("x"), F.lit(1), size=300, overlap=150)


@pytest.mark.parametrize("size, overlap", [(50, 10), (7, 2), (5, 0)])
def test_windows_of_other_sizes(spark, size, overlap):
    rng = np.random.default_rng(size)
    texts = ["".join(rng.choice(list("ab😀 \n"), n)) for n in (0, 1, size, size + 1, 300, 2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", chunking.spans(F.col("t"), F.length("t"), size, overlap).alias("w")).collect():
        check_windows(texts[r.i], [(x.s, x.e) for x in r.w], size, overlap)


def test_document_chunks(spark):
    texts = spark.createDataFrame([("21", 0, "a" * 1300, "S"), ("21", 1, "tail of text", None), ("22", 0, " ", None)], "paper_id string, ord int, text string, section string")
    figures = spark.createDataFrame([("21", "fig1", "", None), ("21", "fig2", "cap", "u")], "paper_id string, fig_id string, caption string, image_uri string")
    tables = spark.createDataFrame([("21", "t0", "| A |\n|---|\n| 1 |\n| 2 |", None)], "paper_id string, table_id string, markdown string, caption string")
    formulas = spark.createDataFrame([("21", "f0", "x^2")], "paper_id string, formula_id string, latex string")
    got = {r.chunk_id: r.content for r in chunking.document_chunks(texts, figures, tables, formulas).collect()}
    assert got == {
        "21:c0": "a" * 1200, "21:c1": "a" * 250, "21:c2": "tail of text", "21:fig1": "Figure fig1", "21:fig2": "cap", "21:t0:r0": "table: A=1",
        "21:t0:r1": "table: A=2", "21:f0": "x^2",
    }
    kept = {r.chunk_id for r in chunking.document_chunks(texts, figures, tables, formulas, drop_fragments=True).collect()}
    assert kept == set(got) - {"21:c2", "21:fig2", "21:f0"}


def test_reading_order_is_a_permutation(spark):
    rng = np.random.default_rng(1)
    rows = [(f"p{p}", 0, b, "t", float(x), float(y), float(x + w), float(y + 10), 600.0) for p in range(8) for b in range(20)
            for x, y, w in [(rng.choice([30, 320]), rng.integers(0, 700), rng.choice([200, 230, 500]))]]
    df = spark.createDataFrame(rows, "paper_id string, page_no int, block_no int, text string, x0 double, y0 double, x1 double, y1 double, width double")
    for p in {r[0] for r in rows}:
        got = layout.reading_order(df.where(F.col("paper_id") == p)).orderBy("order").collect()
        assert [r.order for r in got] == list(range(20)) and {r.block_no for r in got} == set(range(20))
        assert got[0].two_column is not None and all(a.zone <= b.zone for a, b in zip(got, got[1:]))


def test_rounding_is_half_even(spark):
    rows = [("p", 0, i, "t", 0.0, y, 500.0, y + 1, 600.0) for i, y in enumerate([25.0, 21.0, 15.0])]
    df = spark.createDataFrame(rows, "paper_id string, page_no int, block_no int, text string, x0 double, y0 double, x1 double, y1 double, width double")
    assert [r.block_no for r in layout.reading_order(df).orderBy("order").collect()] == [0, 1, 2]


def test_caption_text(spark):
    df = spark.createDataFrame([("Figure 1. A cap\nnext",), ("x\nFig. 2: B",), ("figures",)], "t string")
    got = [tuple(r) for r in df.select(layout.caption_in_text(F.col("t")), layout.caption_in_text(F.col("t"), multiline=True)).collect()]
    assert got == [("Figure 1. A cap", "Figure 1. A cap"), ("", "Fig. 2: B"), ("", "")]


def test_adapter_dispatch(spark):
    md = spark.createDataFrame([("1", "# T\n\nfirst\n\nsecond")], "paper_id string, markdown string")
    assert adapters.adapt({"mineru": (md,)}).count() == 2
    with pytest.raises(ValueError, match="unknown parser"):
        adapters.adapt({"other": (md,)})


def test_routing_without_pages(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "paper_id string")
    pages = spark.createDataFrame([("b", 0, "word " * 100), ("b", 5, "")], "paper_id string, page_no int, text string")
    assert {r.paper_id: r.parser for r in routing.route(docs, pages).collect()} == {"a": "surya", "b": "docling"}


@pytest.mark.parametrize("dim", [384, 64, 1000])
def test_hash_buckets(spark, dim):
    tokens = ["the", "é", "", "1234", "x" * 100]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = [r[0] for r in df.select(embedding.bucket(F.col("t"), dim)).collect()]
    assert got == [int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "little") % dim for t in tokens]


def test_hash_vectors(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, " ")], "k int, t string")
    v = embedding.dense(embedding.hash_vectors(df, "k", "t"), "k", df).orderBy("k").collect()
    assert abs(np.linalg.norm(v[0].embedding) - 1) < 1e-6 and not any(v[1].embedding) and len(v[1].embedding) == 384


def test_model_embedder(spark):
    df = spark.createDataFrame([("a:c0", "text", "hello"), ("a:f0", "formula", "x^2")], "chunk_id string, modality string, content string")
    got = embedding.embed_chunks(df, lambda: lambda texts: np.array([[len(t)] for t in texts])).orderBy("chunk_id").collect()
    assert [r.embedding for r in got] == [[5.0], [len("formula: x to the power of 2")]]


def corpus(spark):
    rows = [("1:c0", 0, "the cat sat on the mat"), ("1:c1", 1, "dogs bark at the moon"), ("2:c0", 2, "a cat and a dog"), ("2:c1", 3, "nothing here"), ("3:c0", 4, "")]
    return spark.createDataFrame(rows, "chunk_id string, ord int, content string")


def test_bm25(spark, tmp_path):
    index = retrieval.build_sparse(corpus(spark))
    asked = spark.createDataFrame([(1, "cat cat moon"), (2, "zebra")], "query_id int, question string")
    docs = [r.content.split() for r in corpus(spark).orderBy("ord").collect()]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    idf = {t: np.log(n - c + 0.5) - np.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    want = [sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in ("cat", "cat", "moon")) for d in docs]
    got = {r.ord: r.score for r in retrieval.search_sparse(index, asked).collect()}
    assert got.keys() == {i for i, s in enumerate(want) if s > 0} and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    index.write(str(tmp_path), 2)
    again = retrieval.search_sparse(retrieval.SparseIndex.read(spark, str(tmp_path)), asked)
    assert {r.ord: round(r.score, 9) for r in again.collect()} == {k: round(v, 9) for k, v in got.items()}


def test_dense_fills_up_with_zero_scores(spark):
    asked = spark.createDataFrame([(1, "moon"), (2, "zebra"), (3, "")], "query_id int, question string")
    got = retrieval.search_hashed(corpus(spark), asked, 3).orderBy("query_id", "rank").collect()
    by = {q: [(r.ord, r.score > 0) for r in got if r.query_id == q] for q in (1, 2, 3)}
    assert by[1][0] == (1, True) and [o for o, _ in by[1][1:]] == [0, 2]
    assert by[2] == by[3] == [(0, False), (1, False), (2, False)]


def test_vector_search(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 8)], "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 50 = 0 and vec_id < 200").select(F.col("vec_id").alias("query_id"), "embedding")
    got = retrieval.search_vectors(df, asked, 5, block=3).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in (0, 50, 100, 150):
        own = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert own == sorted(range(200), key=lambda i: (-round(u[q] @ u[i], 9), i))[:5]


def test_vector_search_in_many_blocks(spark, monkeypatch):
    """More blocks of queries than are broadcast or kept, ties, repeated query ids and vectors of several widths."""
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", 1)
    monkeypatch.setattr(retrieval, "MOST_KEPT", 2)
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(0, 2, 3 + i % 2).astype(float).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = df.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in retrieval.search_vectors(df, asked, 4, block=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-9) for i, v in rows}
    for q in range(0, 90, 9):
        own = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i, v in rows if len(v) == len(unit[q]))[:4]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(own)]


def test_fusion(spark):
    hit = "query_id int, chunk_id string, ord int, score double, rank int"
    dense = spark.createDataFrame([(1, "a", 0, 0.9, 1), (1, "b", 1, 0.8, 2)], hit)
    sparse = spark.createDataFrame([(1, "c", 2, 3.0, 1), (1, "a", 0, 2.0, 2)], hit)
    got = retrieval.fuse(dense, sparse).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "b", "c"] and all(r.score <= 1 for r in got)
    assert got[0].score == 0.7 + (1 - 0.7) / 2 and got[2].score == 1 - 0.7


def test_context_and_refusals(spark):
    hits = spark.createDataFrame(
        [(1, "a", 1.0, 1, "x" * 3000), (1, "b", 0.9, 2, "y" * 900), (1, "c", 0.8, 3, "z" * 200), (1, "d", 0.7, 4, "w"), (2, "a", 0.2, 1, "cat dog mouse"), (3, "q", 0.5, 1, "red cats chase mice"),
         (5, "big", 0.5, 1, "v" * 9000)],
        "query_id int, chunk_id string, score double, rank int, content string",
    )
    ctx = answer.context(hits)
    assert [(r.source_id, len(r.snippet)) for r in ctx.where("query_id = 1").orderBy("position").collect()] == [("a", 500), ("b", 500)]
    assert ctx.where("query_id = 5").count() == 1
    asked = spark.createDataFrame([(1, "nothing shared"), (2, "cat dog"), (3, "why do cats chase mice"), (4, "no hits"), (5, "v")], "query_id int, question string")
    got = {r.query_id: r for r in answer.answer_questions(asked, hits).collect()}
    assert {q: r.status for q, r in got.items()} == {1: "refused", 2: "refused", 3: "answered", 4: "refused", 5: "refused"}
    assert got[3].answer.startswith("Based on the retrieved source [q]") and got[3].confidence == 0.5 and len(got[3].citations) == 1
    assert got[4].answer == answer.NO_HITS and got[2].answer == answer.WEAK_HITS and got[1].answer == answer.NO_ANSWER
    assert got[2].citations == [] and got[4].confidence is None


def test_plugged_generator(spark):
    answer.register_generator("shout", lambda: lambda qs, cs: [q.upper() if c else "NO_ANSWER: none" for q, c in zip(qs, cs)])
    hits = spark.createDataFrame([(1, "a", 0.9, 1, "text")], "query_id int, chunk_id string, score double, rank int, content string")
    asked = spark.createDataFrame([(1, "yes"), (2, "no")], "query_id int, question string")
    got = {r.query_id: (r.status, r.answer) for r in answer.answer_questions(asked, hits, "shout").collect()}
    assert got == {1: ("answered", "YES"), 2: ("refused", answer.NO_HITS)}
    with pytest.raises(ValueError, match="unknown generator"):
        answer.generated(asked, "bedrock")


def test_soft_refusal(spark):
    df = spark.createDataFrame([("I cannot find information.",), ("No information [2:c1].",), ("It is 4.",), ("",)], "a string")
    assert [r[0] for r in df.select(answer.soft_refusal(F.col("a"))).collect()] == [True, False, False, True]


def test_metrics(spark):
    rows = [(["a", "b", "c"], ["b", "z"], ["b", "b", "x"], "see [B] and [nope] [c:1]"), (["a"], [], [], "none"), ([], ["a"], ["a"], "[a]")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ids array<string>, gold array<string>, cited array<string>, ans string")
    c = F.col
    got = df.select(
        "i", evaluate.recall_at(c("ids"), c("gold"), 2), evaluate.reciprocal_rank(c("ids"), c("gold")), evaluate.citation_precision(c("cited"), c("gold")),
        evaluate.citation_recall(c("cited"), c("gold")), evaluate.groundedness(c("ans"), c("ids")),
    )
    assert [tuple(r)[1:] for r in got.orderBy("i").collect()] == [
        (0.5, 0.5, 2 / 3, 0.5, 2 / 3), (None, 0.0, None, None, None), (0.0, 0.0, 1.0, 1.0, None)
    ]


def test_cited_ids(spark):
    cites = [("a:c1", "Methods", None), ("b:c2", "methods", "Figure 3")]
    df = spark.createDataFrame(
        [(i, s, cites) for i, s in enumerate(["[a:c1] [Methods] [x]", "[figure 3]", "[x]", "plain"])],
        "i int, ans string, c array<struct<source_id:string,section:string,figure_label:string>>",
    )
    got = [r[1] for r in df.select("i", evaluate.cited_ids(F.col("ans"), F.col("c"), "section", "figure_label")).orderBy("i").collect()]
    assert got == [["a:c1", "b:c2"], ["b:c2"], ["a:c1", "b:c2"], ["a:c1", "b:c2"]]


def test_refusal_tally(spark):
    rows = [(True, "answered")] * 163 + [(True, "refused")] * 6 + [(False, "refused")] * 18 + [(False, "answered")]
    r = evaluate.refusal_tally(spark.createDataFrame(rows, "answerable boolean, status string")).first()
    assert (round(r.answer_accuracy, 3), round(r.refusal_recall, 3), r.refusal_precision) == (0.963, 0.947, 0.75)
    empty = evaluate.refusal_tally(spark.createDataFrame([], "answerable boolean, status string")).first()
    assert empty.answer_accuracy is None


def test_quality_report(spark):
    df = spark.createDataFrame([("2:c0", "é" * 10), ("2:f1", "x^{2}"), ("1:r", "")], "chunk_id string, content string")
    r = quality.report(df).first()
    assert (r.totals.n_chunks, r.totals.n_papers, r.anomalies.n_garbled, r.anomalies.n_formula_like, r.anomalies.n_odd_ids) == (3, 2, 2, 1, 1)
    assert r.modalities == {"figure": 0, "formula": 1, "table": 0, "text": 2}


def test_like_questions_are_settled_in_order(spark):
    """Chains of like questions, in which a rejected one doesn't reject the next."""
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 12])) for i in range(16)] + [(100, "a b c"), (101, ""), (102, "a b c"), (103, " ".join(words[:12]))]
    df = spark.createDataFrame(rows, "query_id long, question string")
    accepted, want = [], {}
    for q, text in rows:
        t = {w for w in text.split() if len(w) >= 4}
        want[q] = not any(t and s and len(t & s) / len(t | s) > 0.5 for s in accepted)
        accepted += [t] * want[q]
    assert {r.query_id: r.accepted for r in evalset.reject_near_duplicates(df).collect()} == want and not all(want.values())
    assert evalset.reject_near_duplicates(df.limit(0)).count() == 0
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[:14], rng.integers(1, 9)))) for i in range(80)]
    got = {(r.a, r.b): r.jaccard for r in evalset.similar_questions(spark.createDataFrame(rows, df.schema)).collect()}
    sets = {i: set(t.split()) for i, t in rows}
    assert got == {(a, b): j for a in sets for b in sets if a < b and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) > 0.5}


def test_passages_of_any_length(spark):
    texts = ["one two three four five six seven eight nine", "xone two three", "red  fox", "the redfox jumps over two three four", ""]
    asked = ["two three four five six seven eight", "two three four", "one two three", "red", "ne tw", "three fou", "d  f", "zzz", "over two three", "x"]
    corpus = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, content string")
    df = spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")
    for most in (10_000, 0):
        evaluate.MOST_SHORT, old = most, evaluate.MOST_SHORT
        got = {(r.query_id, r.chunk_id) for r in evaluate.gold_by_passage(corpus, df).collect()}
        evaluate.MOST_SHORT = old
        assert got == {(q, str(i)) for q, a in enumerate(asked) for i, t in enumerate(texts) if a in t}


def test_generated_cases(spark):
    df = spark.createDataFrame([("1:c0", "long text", "text"), ("1:c1", "bad", "text")], "chunk_id string, content string, modality string")

    def build():
        calls = []

        def ask(m, c):
            calls.append(c)
            if len(calls) == 1:
                raise OSError("once")
            return ("What is " + c + "?", "yes" if c != "bad" else "no")

        return ask

    got = evalset.generated_cases(df.coalesce(1), build, wait=0)
    assert sorted((r.gold[0], r.kept) for r in got.collect()) == [("1:c0", True), ("1:c1", False)]
    s = evalset.build_stats(got).first()
    assert (s.n_sampled, s.n_kept, s.n_failed, s.success_rate) == (2, 1, 1, 0.5)


def test_cases_are_built_in_bounded_attempts(spark):
    rows = [(f"1:c{i}", f"text {i}", "text", i + 1) for i in range(40)]
    df = spark.createDataFrame(rows, "chunk_id string, content string, modality string, position int")
    fifth = lambda: lambda m, c: ("What is " + c + "?", "yes" if int(c[5:]) % 5 == 0 else "no")
    made = evalset.build_cases(df, fifth, 6, wait=0)
    assert made.where("kept").count() == 4 and made.count() == 18  # three times the target, and no more
    assert evalset.build_cases(df, lambda: lambda m, c: ("What is " + c, "yes"), 6, wait=0).count() == 6
    assert evalset.build_cases(df.limit(0), fifth, 6, wait=0).count() == 0
    broken = evalset.build_cases(df, lambda: lambda m, c: 1 / 0, 2, wait=0)
    assert broken.count() == 6 and broken.where("kept").count() == 0


def test_files_parsers_and_cache(spark, tmp_path):
    for name, body in (("b.pdf", b"hello"), ("a.pdf", b"\xff\xfe"), ("c.txt", b"no")):
        (tmp_path / name).write_bytes(body)
    files = readers.document_files(spark, str(tmp_path))
    assert [r.paper_id for r in files.orderBy("path").collect()] == ["a", "b"]
    rows = {r.paper_id: r for r in readers.parse_documents(files, "utf8").collect()}
    assert rows["b"].text == "hello" and rows["b"].engine == "utf8" and "UnicodeDecodeError" in rows["a"].error

    def fails():
        raise RuntimeError("not installed")

    readers.register_parser("mineru", fails)
    readers.register_parser("docling", fails)
    readers.register_parser("pymupdf", lambda: lambda name, content: [{"kind": "text", "text": name, "page": 1}])
    got = readers.parse_documents(files.withColumn("parser", F.lit("mineru"))).collect()
    assert {(r.engine, r.text, r.page) for r in got} == {("pymupdf", "a", 1), ("pymupdf", "b", 1)}
    files.select("path", "length", "modificationTime").write.parquet(str(tmp_path / "cache"))
    cached = spark.read.parquet(str(tmp_path / "cache"))
    assert readers.cache_is_current(files, cached) and readers.cache_is_current(files, cached, by_count=True)
    (tmp_path / "b.pdf").write_bytes(b"longer now")
    files = readers.document_files(spark, str(tmp_path))
    assert [r.paper_id for r in readers.new_files(files, cached).collect()] == ["b"] and not readers.cache_is_current(files, cached)


def test_listing_source(spark, tmp_path):
    entries = [{"id": f"2610.{i:05d}v{i % 3 + 1}", "submitted": f"2026-01-{i % 28 + 1:02d}", "title": "t"} for i in range(250)]
    (tmp_path / "l.json").write_text(json.dumps(entries))
    spark.dataSource.register(readers.PaperListing)
    rows = spark.read.format("paper_listing").option("path", str(tmp_path / "l.json")).option("max", "120").load()
    want = sorted(entries, key=lambda e: (e["submitted"], e["id"]), reverse=True)[:120]
    assert {r.id for r in rows.collect()} == {e["id"] for e in want}
    assert spark.read.format("paper_listing").option("path", str(tmp_path / "l.json")).load().count() == 100
    assert readers.listing_query() == "cat:cs.CL" and readers.listing_query(None, "rag") == 'all:"rag"'
    assert readers.listing_query(["cs.CL", "cs.AI"], "rag") == '(cat:cs.CL OR cat:cs.AI) AND all:"rag"'
    seen = str(tmp_path)

    def fetch():
        return lambda name: name.encode()

    def store():
        import os

        def put(name, body):
            path = f"{seen}/{name}.bin"
            if body is None:
                return os.path.exists(path)
            with open(path, "wb") as f:
                return f.write(body) > 0

        return put

    assert writers.download(rows.limit(5), fetch, store).where("ok").count() == 5
    assert len(list(tmp_path.glob("*.bin"))) == 5 and not list(tmp_path.glob("*v*.bin"))


def test_env_and_cases(spark, tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("A_NEW_KEY='v'\n# c\nPATH=x\n")
    monkeypatch.delenv("A_NEW_KEY", raising=False)
    assert readers.load_env(str(tmp_path / ".env")) == {"A_NEW_KEY": "v"} and readers.load_env("/no/such") == {}
    (tmp_path / "c.jsonl").write_text('\n# note\n{"question": "q", "gold_source_ids": ["a"], "answerable": true}\n')
    r = readers.cases(spark, str(tmp_path / "c.jsonl")).collect()
    assert len(r) == 1 and r[0].gold_source_ids == ["a"] and r[0].notes is None
    assert readers.demo_cases(spark).where("answerable").count() == 2


def test_vector_table_and_reports(spark, tmp_path):
    writers.reset_vector_table(spark, "test_vectors")
    chunks = spark.createDataFrame([("a:c0", None, "t", "text", "a")], "chunk_id string, embedding array<float>, content string, modality string, paper_id string")
    writers.dense_records(chunks).write.insertInto("test_vectors")
    writers.create_vector_table(spark, "test_vectors")
    r = spark.table("test_vectors").first()
    assert len(r.vector) == 384 and not any(r.vector)
    assert writers.vector_table_properties(spark, "test_vectors") == {"dimension": "384", "metric": "COSINE"}
    writers.reset_vector_table(spark, "test_vectors", dim=2, metric="L2")
    assert spark.table("test_vectors").count() == 0 and writers.vector_table_properties(spark, "test_vectors")["metric"] == "L2"
    with pytest.raises(Exception, match="wrong dimension: a:c0"):
        writers.insert_vectors(spark, "test_vectors", writers.dense_records(chunks))
    spark.sql("DROP TABLE test_vectors")
    results = spark.createDataFrame(
        [(1, "a | long question " * 5, True, "answered", 1.0, 0.5, None, None, None), (2, "q", False, "refused", None, 0.0, None, None, None)],
        "query_id int, question string, answerable boolean, status string, recall double, rr double, citation_precision double, citation_recall double, groundedness double",
    )
    s = evaluate.summary(results)
    md = writers.markdown_report(results, s)
    assert "| recall | 100.0% |" in md and "| q | refused | n/a | 0.0% |" in md
    assert "mrr: 50.0%" in writers.console_report(results, s)
    report = json.loads(writers.json_report(s, evaluate.refusal_tally(results), results).first()[0])
    assert report["aggregate"]["n_cases"] == 2 and report["tally"]["refused_unanswerable"] == 1 and len(report["cases"]) == 2
    writers.vector_dump(spark.range(50).select(F.col("id").alias("chunk_id")), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 20


@pytest.mark.parametrize("stored_index", [False, True])
def test_sparse_search_shuffles_only_the_best_of_a_task(spark, tmp_path, monkeypatch, stored_index):
    """However the postings lie, a task hands on its k best of each question, and they are those of the join of all scores."""
    rng = np.random.default_rng(3)
    rows = [(f"c{i}", i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) % 90)) for i in range(400)]
    rows += [(f"c{i}", i, rows[7][2]) for i in range(400, 420)]  # ties
    corpus = spark.createDataFrame(rows, "chunk_id string, ord long, content string").repartition(3)
    asked = spark.createDataFrame([(q, rows[q * 7][2]) for q in range(9)] + [(99, "unknown")], "query_id long, question string")
    index = retrieval.build_sparse(corpus)
    if stored_index:
        index.write(str(tmp_path / "i"), 3)
        index = retrieval.SparseIndex.read(spark, str(tmp_path / "i"))
    found = lambda: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in retrieval.search_sparse(index, asked, 4).collect())
    monkeypatch.setattr(retrieval, "MOST_ASKED", -1)
    joined = found()
    seen = []
    monkeypatch.setattr(retrieval, "MOST_ASKED", 1 << 18)
    monkeypatch.setattr(retrieval, "CELLS", 50)
    monkeypatch.setattr(retrieval, "POSTINGS", 64)
    best = retrieval._best_of_tasks
    monkeypatch.setattr(retrieval, "_best_of_tasks", lambda *a: seen.append(best(*a)) or seen[-1])
    assert found() == joined and len(joined) == 9 * 4
    assert seen[0].count() <= 9 * 4 * seen[0].rdd.getNumPartitions()


def test_dense_search_packs_in_the_task_that_searches(spark):
    """Blocks aren't handed from one Python stage to the next, where many lay in one batch."""
    corpus = spark.createDataFrame([(i, f"a b{i}") for i in range(50)], "ord long, content string")
    asked = retrieval.hashed_blocks(corpus.limit(3).withColumnRenamed("ord", "query_id"), "query_id", "content").packed()
    found = retrieval.nearest(retrieval.hashed_blocks(corpus, "ord", "content"), asked, 2, "ord", unit=False)
    assert found._jdf.queryExecution().toString().split("Physical Plan")[-1].count("MapInArrow") == 1


def test_elements_are_handed_on_as_they_come(spark, monkeypatch):
    """A worker doesn't hold the elements of a whole batch of files."""
    monkeypatch.setattr(readers, "ELEMENTS", 100)

    def build():
        live = [0]

        class Text(str):
            def __new__(cls, s):
                live[0] += 1
                return super().__new__(cls, s)

            def __del__(self):
                live[0] -= 1

        def parse(paper, content):
            assert live[0] < 500
            return [{"kind": "text", "text": Text("x")} for _ in range(10)]

        return parse

    files = spark.range(400).coalesce(1).selectExpr("cast(id as string) path", "cast(id as string) paper_id", "cast('a' as binary) content")
    e = readers.parse_documents(files, "counting", {"counting": build})
    assert e.where("error is null").count() == 4000


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(embedding, "MOST_WORDS", 3)
    known = embedding.Buckets(7)
    got = known.counts(["a b c d e a", "", "é"])
    want = np.zeros((3, 7), int)
    for i, t in enumerate(["a b c d e a", "", "é"]):
        for w in t.split():
            want[i, int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little") % 7] += 1
    assert (got == want).all() and len(known) == 3


def test_pairs_are_embedded_few_at_a_time(spark):
    """The model gets no more than ``TEXTS`` texts at once, however many rows come in a batch."""

    def build():
        def model(texts):
            assert len(texts) <= 512
            return np.ones((len(texts), 2), np.float32)

        return model

    pairs = spark.range(2000).coalesce(1).selectExpr("cast(id as string) a", "'x' b")
    assert embedding.pair_similarities(spark, build, pairs).where("similarity = 2").count() == 2000


def test_percents_round_as_doubles(spark):
    """Halves go to the even digit, as in DuckDB's and Python's formats: 1/16 is 6.2 %, 0.0015 is 0.1 %."""
    ratios = [1 / 16, 3 / 16, 5 / 16, 0.0015, 0.0005, 0.35, 1.0, 0.0, 1 / 3, 0.9995, 12.34567] + [i / n for n in (7, 48, 80, 160) for i in range(n + 1)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ratios)], "i int, x double")
    got = [r.p for r in df.select("i", writers.percent(F.col("x")).alias("p")).orderBy("i").collect()]
    assert got == [f"{x * 100:.1f}%" for x in ratios] and got[:4] == ["6.2%", "18.8%", "31.2%", "0.1%"]


def test_soft_refusal_reads_an_answer_once(spark):
    """Not once for each phrase: the head takes about as long as stripping the answer once."""
    df = spark.createDataFrame([("A word  or two. " * 200_000,)], "a string").repartition(1).cache()

    def seconds(c):
        df.select(c).collect()
        began = time.perf_counter()
        df.select(c).collect()
        return time.perf_counter() - began

    once = seconds(F.length(F.substring(text.strip(F.lower("a")), 1, 200)))
    assert seconds(answer.soft_refusal(F.col("a"))) < 6 * once + 0.3


def test_stream_restarts(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * 400) for i in range(6)], "doc_id long, text string")
    docs.where("doc_id < 3").write.parquet(str(tmp_path / "in"))
    go = lambda: pipelines.run_available(
        pipelines.file_stream(spark, str(tmp_path / "in"), docs.schema, 1), str(tmp_path / "out"), str(tmp_path / "state"), pipelines.chunk_stream
    )
    go()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    docs.where("doc_id >= 3").write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 * first == 12


def test_remote_listing(spark):
    """A service that answers in Atom, page by page, until a page is empty."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            start, n = int(q["start"][0]), int(q["max_results"][0])
            asked.append((q["search_query"][0], start, n))
            entries = "".join(f"<entry><id>http://x/abs/2610.{i:05d}v2</id><title>t{i}</title><published>2026-01-01</published></entry>" for i in range(start, min(start + n, 230)))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(f'<feed xmlns="http://www.w3.org/2005/Atom">{entries}</feed>'.encode())

        def log_message(self, *x):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(readers.PaperListing)
    load = lambda most: spark.read.format("paper_listing").options(url=f"http://127.0.0.1:{server.server_port}/q", pause="0", max=str(most)).load()
    rows = load(1000).collect()
    assert [r.id for r in rows] == [f"2610.{i:05d}v2" for i in range(230)] and rows[7].title == "t7"
    assert {a[0] for a in asked} == {"cat:cs.CL"} and max(a[1] for a in asked) == 300
    assert load(120).count() == 120
    server.shutdown()


def test_tables_of_engines_through_their_adapters(spark):
    def docling(name, content):
        return [{"kind": "text", "text": "first"}, {"kind": "text", "text": " "}, {"kind": "text", "text": "second"}, {"kind": "table", "text": "| a |"}, {"kind": "figure", "text": ""}]

    def surya(name, content):
        return [{"kind": "line", "text": "ocr line", "page": 1}, {"kind": "region", "text": "Table", "page": 1}, {"kind": "region", "text": "Text", "page": 1}]

    files = spark.createDataFrame([("/a", "a", b"x", "docling"), ("/b", "b", b"x", "surya"), ("/c", "c", b"# T\n\nbody", "utf8"), ("/d", "d", b"x", "nothing")], "path string, paper_id string, content binary, parser string")
    parsed = readers.parse_documents(files, builders={"docling": lambda: docling, "surya": lambda: surya})
    assert [r.paper_id for r in parsed.where("error is not null").collect()] == ["d"]
    got = adapters.adapt(parsers.records(parsed)).select("paper_id", "kind", "ord", "text", "page").collect()
    assert sorted(map(str, got)) == sorted(map(str, [
        Row(paper_id="a", kind="text", ord=0, text="first", page=None), Row(paper_id="a", kind="text", ord=1, text="second", page=None),
        Row(paper_id="a", kind="table", ord=0, text="| a |", page=None), Row(paper_id="a", kind="figure", ord=0, text="", page=None),
        Row(paper_id="b", kind="text", ord=0, text="ocr line", page=1), Row(paper_id="b", kind="table", ord=0, text="", page=1),
        Row(paper_id="c", kind=None, ord=0, text="body", page=None),
    ]))


def test_shared_folder_of_one_machine_is_refused(spark, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "master", "spark://host:7077", raising=False)
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.shared_folder(spark, "x")


def test_external_parsers(monkeypatch):
    """The builders of parsers with outside libraries, against stand-ins of those."""
    module = types.SimpleNamespace
    item = lambda x: module(text=x, export_to_markdown=lambda: x)
    doc = module(texts=[item("t")], tables=[item("|a|")], pictures=[1])
    monkeypatch.setitem(sys.modules, "docling", module())
    monkeypatch.setitem(sys.modules, "docling.document_converter", module(DocumentConverter=lambda: module(convert=lambda p: module(document=doc))))
    assert [(e["kind"], e["element_id"], e["text"]) for e in parsers._docling()("n", b"x")] == [("text", "c0", "t"), ("table", "t0", "|a|"), ("figure", "fig0", "")]
    for name in ("mineru", "mineru.cli", "surya", "pypdfium2"):
        monkeypatch.setitem(sys.modules, name, module(PdfDocument=lambda b: [module(render=lambda scale: module(to_pil=lambda: scale))]))
    monkeypatch.setitem(sys.modules, "mineru.cli.client", module(parse_pdf=lambda p, **k: {"markdown": "# m"} if k["formula_enable"] else ""))
    assert parsers._mineru()("n", b"x")[0]["text"] == "# m"
    line, region = module(text_lines=[module(text="l")]), module(bboxes=[module(label="Figure")])
    monkeypatch.setitem(sys.modules, "surya.detection", module(DetectionPredictor=lambda: 1))
    monkeypatch.setitem(sys.modules, "surya.recognition", module(RecognitionPredictor=lambda: lambda images, det_predictor: [line for _ in images]))
    monkeypatch.setitem(sys.modules, "surya.layout", module(LayoutPredictor=lambda: lambda images: [region for _ in images]))
    assert [(e["kind"], e["text"], e["page"]) for e in parsers._surya()("n", b"x")] == [("line", "l", 1), ("region", "Figure", 1)]
    assert readers.FALLBACK.get("surya") is None


def test_passages_are_looked_up_where_texts_are_read(spark, monkeypatch):
    """Up to a number of keys no chunk is exploded into its keys, and a join finds the same beyond it."""
    texts = ["one two three four five six seven eight nine", "a b c d e f g h i", "xone two three", None, "", "one two three one two three"]
    asked = ["two three four five six seven eight", "a b c d e f g h", "one two three", "e f g", "nine", "seven eight nine ten"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    df = spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")
    want = {(q, i) for q, a in enumerate(asked) for i, t in enumerate(texts) if a in (t or "")}
    used = []
    with_keys = evaluate._with_keys
    monkeypatch.setattr(evaluate, "_with_keys", lambda *x: used.append(1) or with_keys(*x))
    for most in (1 << 17, 1):
        monkeypatch.setattr(evaluate, "MOST_KEYS", most)
        assert {(r.query_id, r.chunk_id) for r in evaluate.gold_by_passage(corpus, df).collect()} == want
    assert used == [1]
    assert evaluate.gold_by_passage(corpus, df.where("query_id = 4")).count() == 1


def test_postings_are_not_exploded_to_be_searched(spark, tmp_path):
    """Scores are taken from the counts of each chunk; written postings give the same hits."""
    rng = np.random.default_rng(6)
    rows = [(f"c{i}", i, " ".join(f"w{j}" for j in rng.zipf(1.5, int(rng.integers(0, 60))) % 90)) for i in range(300)] + [("n", 300, None), ("e", 301, " ")]
    index = retrieval.build_sparse(spark.createDataFrame(rows, "chunk_id string, ord long, content string").repartition(3))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    texts = [set((t or "").split()) for _, _, t in rows]
    assert {r.term: r.df for r in index.terms.collect()} == {w: sum(w in t for t in texts) for w in set().union(*texts)}
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1} w{2 * i} w1 zzz") for i in range(40)] + [(99, "")], "query_id long, question string")
    assert "Generate" not in plan(retrieval._best_of_tasks(index, asked.select("query_id", F.explode(F.split("question", " ")).alias("term"), F.lit(1.5).alias("_q")), 7))
    got = lambda i: {(r.query_id, r.rank, r.ord, round(r.score, 9)) for r in retrieval.search_sparse(i, asked, 7).collect()}
    index.write(str(tmp_path), 2)
    assert got(index) == got(retrieval.SparseIndex.read(spark, str(tmp_path))) and len(got(index)) > 200


def test_term_weights_need_no_postings(spark, sf, monkeypatch):
    """The terms of an index, whose texts pass once: nothing but the sums of the tasks is exchanged and written."""
    rng = np.random.default_rng(7)
    rows = [(f"c{i}", i, " ".join(f"W{j}" for j in rng.zipf(1.5, int(rng.integers(0, 60))) % 90)) for i in range(900)] + [("n", 900, None), ("e", 901, " "), ("b", 902, " é É\u0085\x1c İ ")]
    got = lambda df: {(r.term, r.df, round(r.idf, 9)) for r in df.collect()}
    for own in (rows, rows[-3:], rows[-3:-1], []):
        corpus = spark.createDataFrame(own, "chunk_id string, ord long, content string").repartition(2)
        want = got(retrieval.build_sparse(corpus).terms)
        assert got(retrieval.term_weights(corpus)) == want and (len(want) > 40) == (own is rows)
        with monkeypatch.context() as m:  # sums are handed on again and again
            m.setattr(retrieval, "TERMS", 5)
            m.setattr(retrieval, "POSTINGS", 2)
            m.setattr(retrieval, "TEXTS", 3)
            assert got(retrieval.term_weights(corpus)) == want
    written = []
    monkeypatch.setattr(tables, "shared_folder", lambda s, name, f=tables.shared_folder: written.append(name) or f(s, name))
    retrieval_queries.bm25_terms(spark, sf)
    assert written == ["bm25-df"]
