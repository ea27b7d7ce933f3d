import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.operators import cells, retrieval
from inkfold.plans import retrieval_queries
from inkfold.sources.tables import shared_folder


def brute(x, q, k=10):
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(x).T, 9)
    return [sorted(range(len(x)), key=lambda j: (-r[j], j))[:k] for r in s]


@pytest.fixture(scope="module")
def clustered(spark):
    """4,000 vectors around 40 centres, of which one has a third."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((40, 24))
    own = np.where(rng.random(4000) < 1 / 3, 0, rng.integers(0, 40, 4000))
    x = centre[own] + 0.25 * rng.standard_normal((4000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    return x, df, cells.CellIndex.write(df, shared_folder(spark, "cells"), 40)


def asked(df):
    return df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def recall(rows, x, ids, k=10):
    found = {}
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = dict(zip(ids, brute(x, x[ids], k)))
    return np.mean([len(found.get(i, set()) & set(w)) / k for i, w in want.items()])


def test_clusters_are_found_by_reading_little(clustered):
    x, df, index = clustered
    n = index.probes_for(asked(df).where("query_id % 100 = 0"), 0.95)
    rows = index.search(asked(df), n).collect()
    ids = list(range(0, 4000, 50))
    assert recall(rows, x, ids) >= 0.95 and len(rows) == 10 * len(ids)
    small = asked(df).where("query_id in (150, 250)")
    some = index.read_for(index.probed(small, n))
    assert some.count() <= 0.55 * len(x)  # two queries read their own cells, one of which may be the one of a third
    assert "PartitionFilters: [cell" in some._jdf.queryExecution().toString()


def test_all_cells_give_the_exact_search(clustered):
    _, df, index = clustered
    keep = lambda f: sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 8)) for r in f.collect())
    assert keep(index.search(asked(df), 1000)) == keep(retrieval.search_vectors(df, asked(df)))


def test_vectors_of_the_tables(spark, sf):
    """They have no clusters, so nearly all cells have to be asked for nine tenths; the measured number says so."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    index = cells.CellIndex.write(df, shared_folder(spark, "cells"), 16)
    sample = df.where("vec_id % 50 = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    n = index.probes_for(sample, 0.95)
    rows = df.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows]), [i for i, r in enumerate(rows) if r.vec_id % 50 == 0]
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    assert 8 < n <= 16 and recall(index.search(asked(df), n).collect(), x, ids) >= 0.9


def test_registered_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows]), [i for i, r in enumerate(rows) if r.vec_id % 50 == 0]
    got = retrieval_queries.dense_topk_cells(spark, sf).collect()
    assert recall(got, x, ids) >= 0.9 and len(got) == 10 * len(ids)
    assert all(abs(r.score - x[r.query_id] @ x[r.vec_id] / np.linalg.norm(x[r.query_id]) / np.linalg.norm(x[r.vec_id])) < 1e-5 for r in got)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 2.0, 3.0]), (5, [0.6, 0.8]), (6, []), (7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = cells.CellIndex.write(df.where("vec_id <> 4"), shared_folder(spark, "cells"), 2)
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [1.0, 1.0, 1.0])], "query_id long, embedding array<double>")
    got = index.search(q, 2).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, round(r.score, 6)) for r in got] == [(1, 1, 1.0), (1, 7, 1.0), (1, 5, 0.6), (1, 2, 0.0)]
    none = cells.CellIndex.write(df.where("vec_id < 0"), shared_folder(spark, "cells"), 4)
    assert none.search(q, 3).count() == 0 and none.probes_for(q) == 1


def test_k_means_against_a_plain_loop():
    rng = np.random.default_rng(0)
    x = cells._unit_rows(rng.standard_normal((300, 5)))
    c = x[:7].copy()
    for _ in range(3):
        own = [max(range(7), key=lambda j: (round(float(v @ c[j]), 9), -j)) for v in x]
        for j in range(7):
            if j in own:
                m = sum(v for v, o in zip(x, own) if o == j)
                c[j] = m / np.linalg.norm(m)
    assert np.allclose(cells.k_means(x, 7, 3), c)
    assert cells.closest(x, c, 7).tolist() == [sorted(range(7), key=lambda j: (-round(float(v @ c[j]), 9), j)) for v in x]
