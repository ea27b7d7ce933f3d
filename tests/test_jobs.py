import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from inkfold.operators import retrieval, segments
from inkfold.sources import tables
from jobs import config, ingest_documents, sweep_fusion

ROWS = "doc_id long, text string, version long, gone boolean, batch string, term string"


def rows(*found):
    return [(i, t, v, g, "x", "y") for i, t, v, g in found]


def text(i, n=40):
    return " ".join(f"w{(i * 7 + k * k) % 53}" for k in range(n + i % 5))


FIRST = rows(*[(i, text(i), 1, False) for i in range(30)], (None, "nobody", 1, False), (40, None, 1, False), (41, "", 1, None), (42, text(3, 900), 1, False))
SECOND = rows(*[(i, text(i + 100), 2, False) for i in range(0, 10, 2)], (3, None, 2, True), (5, "late and old", 0, False), (50, text(50), 1, False), (50, text(51), 3, False))
THIRD = rows((3, "here again w1 w2", 3, False), (0, "again w1 w1 w1", 3, False), (42, "short now w5", 2, False), (7, None, 2, True), (50, text(50), 1, False))
#: What is there after all three: the text of each document's largest version.
LAST = {i: text(i) for i in range(30)} | {i: text(i + 100) for i in range(0, 10, 2)} | {3: "here again w1 w2", 0: "again w1 w1 w1", 40: None, 41: "", 42: "short now w5", 50: text(51)}
del LAST[7]
ASKED = [(1, "w1 w2 w3"), (2, "w5 w5 again"), (3, "zzz"), (4, "w10 w11 w12 w13 w14 w15"), (5, "")]


def add(spark, folder, found, files=1):
    spark.createDataFrame(found, ROWS).repartition(files).write.mode("append").parquet(str(folder))


def hits(spark, store, asked=ASKED):
    found = retrieval.search_sparse(segments.index(spark, str(store)), spark.createDataFrame(asked, "query_id long, question string"), 7)
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in found.collect())


def state(spark, store):
    chunks = sorted((r.chunk_id, r.content, r.dl) for r in segments.live_chunks(spark, str(store)).collect())
    known = sorted(r.doc_id for r in segments.live_versions(spark, str(store)).collect())
    terms = sorted((r.term, r.df, round(r.idf, 9)) for r in segments.index(spark, str(store)).terms.collect())
    return chunks, known, terms


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """One build of what is there in the end."""
    store = str(tmp_path_factory.mktemp("whole"))
    segments.create(spark, store)
    docs = spark.createDataFrame([(i, t, 0, None) for i, t in LAST.items()], "doc_id long, text string, version long, deleted boolean")
    segments.write_segment(docs, store, 0)
    return state(spark, store), hits(spark, store)


SETTINGS = {"version": "version", "deleted": "gone", "files_per_batch": 2}


def test_growing_input_gives_what_one_build_gives(spark, tmp_path, whole):
    source, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "state"))
    run = lambda: ingest_documents.ingest(spark, source, store, checkpoint, SETTINGS)
    add(spark, source, FIRST, 3)
    assert run() == 2
    before = state(spark, store)
    assert run() == 0 and state(spark, store) == before
    for more in (SECOND, THIRD):
        add(spark, source, more)
        assert run() == 1
    assert (state(spark, store), hits(spark, store)) == whole
    assert run() == 0 and (state(spark, store), hits(spark, store)) == whole
    ran = {r.batch: r for r in spark.read.parquet(f"{store}/runs").collect()}
    assert sorted(ran) == [0, 1, 2, 3] and sum(r.rows_read for r in ran.values()) == len(FIRST + SECOND + THIRD)
    assert ran[2].documents == 8 and ran[3].documents == 5
    # the live rows as one segment of a new folder, and what comes after it
    assert segments.compact(spark, store, str(tmp_path / "small")) == 3
    assert (state(spark, tmp_path / "small"), hits(spark, tmp_path / "small")) == whole
    more = spark.createDataFrame([(9, "new w1", 5, False)], "doc_id long, text string, version long, deleted boolean")
    segments.write_segment(more, str(tmp_path / "small"), 4)
    assert [r.content for r in segments.live_chunks(spark, str(tmp_path / "small")).where("doc_id = 9").collect()] == ["new w1"]


def test_a_batch_that_is_written_again_changes_nothing(spark, tmp_path):
    docs = spark.createDataFrame(FIRST, ROWS).withColumn("deleted", F.col("gone"))
    store = str(tmp_path / "store")
    segments.create(spark, store)
    segments.write_segment(docs, store, 0)
    before = state(spark, store), hits(spark, store)
    segments.create(spark, store)
    segments.write_segment(docs, store, 0)
    assert (state(spark, store), hits(spark, store)) == before
    # a segment whose last table wasn't written isn't there yet
    segments._put(segments.read(spark, store, "chunks").withColumn("doc_id", F.col("doc_id") + 1000), store, "chunks", 1)
    assert state(spark, store)[0] == before[0][0]


def test_order_of_arrival_counts_without_versions(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "state"))
    for found in (FIRST, SECOND):
        add(spark, source, found)
        assert ingest_documents.ingest(spark, source, store, checkpoint) == 1
    assert [r.content for r in segments.live_chunks(spark, store).where("doc_id = 5").collect()] == ["late and old"]


def test_nothing_to_read(spark, tmp_path):
    add(spark, tmp_path / "in", [])
    store = str(tmp_path / "store")
    assert ingest_documents.ingest(spark, str(tmp_path / "in"), store, str(tmp_path / "state")) <= 1
    assert state(spark, store) == ([], [], []) and hits(spark, store) == []
    assert segments.compact(spark, store, str(tmp_path / "small")) == -1 or state(spark, tmp_path / "small")[0] == []


def test_sweep_again_and_with_fewer_weights(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(None, "x", "en", "s", 1), (900, None, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(str(tmp_path / "docs"))
    run = lambda **s: sweep_fusion.sweep(spark, str(tmp_path / "docs"), f"{sf}/benchmark.parquet", str(tmp_path / "out"), s)
    read = lambda: sorted(map(str, spark.read.parquet(str(tmp_path / "out" / "cases")).collect()))
    run(alphas=[0.0, 0.7])
    before = read()
    run(alphas=[0.0, 0.7])
    assert read() == before and len(before) == 2 * 40
    means = spark.read.parquet(str(tmp_path / "out" / "summary")).orderBy("alpha").collect()
    assert [r.alpha for r in means] == [0.0, 0.7] and all(0 < r.n_answerable < r.n_cases == 40 and 0 <= r.mrr <= 1 for r in means)
    run(alphas=[0.7])
    assert read() == [r for r in before if "alpha=0.7" in r]


def test_config(tmp_path):
    assert config.load(ingest_documents.CONFIG, ingest_documents.DEFAULTS) == ingest_documents.DEFAULTS
    assert config.load(sweep_fusion.CONFIG, sweep_fusion.DEFAULTS) == sweep_fusion.DEFAULTS
    (tmp_path / "c.json").write_text('{"sizes": 3}')
    with pytest.raises(ValueError, match="unknown settings sizes"):
        config.load(tmp_path / "c.json", ingest_documents.DEFAULTS)


def test_command_line(spark, tmp_path):
    add(spark, tmp_path / "in", FIRST)
    paths = [f"--{k}={tmp_path / v}" for k, v in (("input", "in"), ("store", "store"), ("checkpoint", "state"))]
    at = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run([sys.executable, "jobs/ingest_documents.py", *paths], cwd=at, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 34 rows" in done.stderr and "wrote 33 documents" in done.stderr
    assert segments.live_versions(spark, str(tmp_path / "store")).count() == 33


def test_files_of_postings_grow_with_them(spark, tmp_path, monkeypatch):
    """A segment's postings aren't sorted by four tasks however many there are."""
    monkeypatch.setattr(tables, "ROWS", 100)
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 40 + j}" for j in range(40)), 0, False) for i in range(50)], "doc_id long, text string, version long, deleted boolean")
    segments.write_segment(docs, str(tmp_path), 0)
    written = segments.read(spark, str(tmp_path), "postings")
    assert written.count() == 2000 and len(written.inputFiles()) > 10
