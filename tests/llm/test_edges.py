"""Columns whose names the operators use themselves, texts of megabytes, and what the first stage does with odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkfold.llm import merkle, minhash_dedup, mixing, packing, quality, sharding, suffix_dedup

from .conftest import passage, texts

#: Names that operators or their helpers give to columns of their own.
NAMES = ["length", "piece", "start", "offset", "sequence_id", "rank", "predicted", "held_out", "y", "mark", "component_id", "n_shingles", "copy", "shuffle_key",
         "n_copies", "shard", "slot", "place", "hash", "tree", "size", "key", "hood", "first", "repeated", "spans", "_score", "_predicted", "_probable", "_chunk"]


def some(spark, clashing):
    rows = [(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}", i) for i, t in texts()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(k) if k % 2 else F.lit("x") for k, c in enumerate(NAMES)}) if clashing else df


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 26)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda s, d: minhash_dedup.near_duplicates(d, percent=85),
    "op3": lambda s, d: mixing.mix_sources(d).select("doc_id", "rate", "copy", "n_copies", "shuffle_key"),
    "op6": lambda s, d: sharding.shard_documents(d),
    "op8": lambda s, d: packing.pack(d).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "op10": lambda s, d: quality.quality_scores(d, labels(s)),
    "op11": lambda s, d: merkle.manifest(d),
    "op12": lambda s, d: suffix_dedup.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(spark, name):
    with_, without = (sorted(map(str, OPERATORS[name](spark, some(spark, c)).collect())) for c in (True, False))
    assert with_ == without and len(with_) > 0


def test_texts_of_megabytes_in_shards_and_scores(spark):
    long_ = passage(2, 400_000)
    rows = [(1, long_), (2, long_ + " end"), (3, "é" * 1_500_000), (4, "short"), *[(10 + k, passage(k, 50)) for k in range(12)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    size = {i: len(t.encode()) + 8 for i, t in rows}
    got = {r.doc_id: r for r in sharding.shard_documents(df, 3).collect()}
    assert {i: r.size for i, r in got.items()} == size
    # the three longest are alone in a shard until the others are dealt, so none shares one with another
    assert len({got[i].shard for i in (1, 2, 3)}) == 3
    marks = spark.createDataFrame([(i, int(i in (1, 2) or i >= 16), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r for r in quality.quality_scores(df, marks).collect()}
    assert set(scores) == set(size) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scores.values())


def test_odd_rows_of_the_first_stage(spark, sf, docs, no_docs):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.select(*real.columns).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    before = real.unionByName(odd).unionByName(odd).withColumns({"_score": F.lit("x"), "predicted": F.lit(1.5)})
    kept = corpus_pipeline.quality_filter(spark, before, sf)
    assert kept.dtypes == before.dtypes
    model = quality.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {t: model.scores([t])[0] >= 0.5 for t in {r.text or "" for r in before.select("text").collect()}}
    key = lambda r: (r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "-").encode()).hexdigest())
    want = sorted(key(r) for r in before.collect() if good[r.text or ""])
    # every row of a kept text stays, as often as it is there; null and empty texts are judged alike
    assert sorted(key(r) for r in kept.collect()) == want and 0 < len(want) < before.count()
    assert corpus_pipeline.quality_filter(spark, no_docs, sf).count() == 0
