import hashlib
import math
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.llm import common, minhash_dedup, mixing, packing, quality, queries

from .conftest import passage, texts
from .test_texts import check_packing, pieces_of


def naive_copies(key, rate, seed=mixing.SEED):
    u = int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / (1 << 52)
    k, total = 0, math.exp(-rate)
    while total <= u:
        k += 1
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def test_mixing_against_brute_force(docs, no_docs):
    rows = docs.collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len((r.text or "").encode())
    weight = {s: b**0.5 for s, b in size.items() if b}
    rate = {s: w / sum(weight.values()) * sum(size.values()) / size[s] for s, w in weight.items()}
    want = {}
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        for c in range(naive_copies(key, rate[r.source])):
            want[r.doc_id, r.text, c] = want.get((r.doc_id, r.text, c), 0) + 1
    out = mixing.mix_sources(docs)
    got = {}
    for r in out.collect():
        got[r.doc_id, r.text, r["copy"]] = got.get((r.doc_id, r.text, r["copy"]), 0) + 1
    assert got == want and out.columns.count("rate") == 1
    assert mixing.mix_sources(no_docs).count() == 0 and mixing.replicate(docs).columns == docs.columns


def test_mixing_weights(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("source"))
    got = {r.source: r.n for r in mixing.mix_sources(df, {"a": 0.5, "b": 0.5}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["a"] - 10_000) < 400 and abs(got["b"] - 10_000) < 400
    assert {r.source for r in mixing.mix_sources(df, {"a": 1.0}).select("source").distinct().collect()} == {"a"}
    big = mixing.mix_sources(df.where("doc_id < 20"), {"a": 1.0}, size=100.0).groupBy("doc_id").count().collect()
    assert len(big) == 2 and all(abs(r["count"] - 1000) < 200 for r in big)


@pytest.mark.parametrize("rate", [0.01, 1.0, 40.0, 900.0])
def test_poisson_table(rate):
    cdf = mixing._cdf(rate)
    assert abs(cdf[-1] - 1) < 1e-9 and cdf == sorted(cdf)
    assert abs(sum(1 - c for c in cdf) - rate) < 1e-6 * max(1, rate)


def test_order_does_not_depend_on_partitions(docs):
    rows = lambda d: sorted((r.shuffle_key, r.doc_id or 0) for r in mixing.mix_sources(d).collect())
    assert rows(docs) == rows(docs.repartition(7))


def plain_good(docs, labels):
    """Documents that their nearest labelled neighbours call good, one document at a time."""
    learned = sorted(i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 3 != 1)
    assert len(learned) <= 2 * quality.SAMPLE

    def count(text):
        v = np.zeros(quality.CLASSES**2)
        b = [int(quality._classes[x]) for x in text.encode()]
        for x, y in zip(b, b[1:]):
            v[quality.CLASSES * x + y] += 1
        return np.sqrt(v / max(1, len(b) - 1))

    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-9)
    t = np.array([count(docs[i].text) for i in learned])
    s = np.array([quality.shape(docs[i].text) for i in learned])
    idf = np.log((1 + len(t)) / (1 + (t > 0).sum(0))) + 1
    axes = np.linalg.svd(unit(t * idf), full_matrices=False)[2][: quality.RANK].T
    place = lambda x, y: unit(np.concatenate([unit(unit(x * idf) @ axes), quality.SHAPE * np.clip((y - s.mean(0)) / (s.std(0) + 1e-6), -4, 4)], axis=-1))
    held = place(t, s)
    out = []
    for i, r in docs.items():
        c = held @ place(count(r.text), np.array(quality.shape(r.text)))
        near = np.argsort(-c)[: quality.NEIGHBOURS]
        w = np.maximum(c[near], 1e-6) ** quality.SHARPNESS
        if w @ np.array([labels[learned[k]] for k in near]) / w.sum() >= 0.5:
            out.append(i)
    return out


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on what the one before kept."""
    sf = "/root/testdata/sf0.001"
    docs = common.documents(spark, sf)
    known = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = common.save(stage(spark, docs, sf), f"test-{name}")
        rows = out.collect()
        if name == "quality_filter":
            assert sorted(r.doc_id for r in rows) == sorted(plain_good(before, {r.doc_id: r.quality for r in known.collect()}))
            assert len(rows) > 0.7 * len(before)
        elif name == "exact_deduplication":
            groups = {}
            for r in before.values():
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), []).append((-len(r.text), r.doc_id))
            assert sorted(r.doc_id for r in rows) == sorted(min(g)[1] for g in groups.values())
        elif name == "near_deduplication":
            from .test_dedup import components, shingle_set

            sets = {i: shingle_set(r.text) for i, r in before.items()}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            best = components(sets, links)
            assert sorted(r.doc_id for r in rows) == sorted(i for i in sets if best[i] == i)
        elif name == "source_mixing":
            size = {}
            for r in before.values():
                size[r.source] = size.get(r.source, 0) + len(r.text.encode())
            root = {k: b**0.5 for k, b in size.items()}
            rate = {k: root[k] / sum(root.values()) * sum(size.values()) / size[k] for k in size}
            want = sorted(i for i, r in before.items() for _ in range(naive_copies(i, rate[r.source])))
            assert sorted(r.doc_id for r in rows) == want
        else:
            copies = [r.text for r in docs.collect()]
            check_packing(rows, [p for t in copies for p in pieces_of(t)])
        if name != "sequence_packing":
            assert out.columns == docs.columns
            docs = out
    assert corpus_pipeline.run(spark, sf).count() == len(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_filter", "exact_deduplication", "near_deduplication", "source_mixing", "sequence_packing"
    ]


def test_pipeline_stages_handle_odd_rows(spark, docs, no_docs):
    sf = "/root/testdata/sf0.001"
    now = docs
    for name, stage in corpus_pipeline.STAGES[1:-1]:  # what the classifier thinks of such rows isn't fixed
        out = common.save(stage(spark, now, sf), "odd")
        assert out.columns == docs.columns
        if name == "exact_deduplication":
            assert sorted(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in out.collect()) == sorted({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in texts()})
        elif name == "near_deduplication":
            left = {r.text for r in out.collect()}
            assert passage(3, 4000) in left and passage(3, 4000, change=2000) not in left and "x" * 3000 in left
        now = out
    check_packing(corpus_pipeline.STAGES[-1][1](spark, now, sf).collect(), [p for r in now.collect() for p in pieces_of(r.text or "")])
    kept = corpus_pipeline.quality_filter(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf).count() == 0


def test_pipeline_stages_take_very_long_texts(spark):
    long_ = [passage(1, 150_000), passage(1, 150_000, change=70_000), passage(9, 150_000) + "’"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*long_, long_[0] + " ", "short text"])]
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf = "/root/testdata/sf0.001"
    assert corpus_pipeline.quality_filter(spark, now, sf).count() <= 5
    left = corpus_pipeline.near_deduplication(spark, corpus_pipeline.exact_deduplication(spark, now, sf), sf)
    # passages of one cycle of words have the same shingles, so only the first of them stays
    sets = {r.doc_id for r in left.collect()}
    assert 4 in sets and len(sets) == 2
    mixed = common.save(corpus_pipeline.source_mixing(spark, now, sf), "long")
    check_packing(corpus_pipeline.sequence_packing(spark, mixed, sf).collect(), [p for r in mixed.collect() for p in pieces_of(r.text)])


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 13))
    assert set(queries.oracles()) <= set(queries.QUERIES)
    assert minhash_dedup.SQL and packing.CAPACITY == 1024
