import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.llm import blocks, common, embedding_dedup, exact_dedup, minhash_dedup, shingles

from .conftest import passage, texts

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingle_set(t):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(nodes, links):
    best = {n: n for n in nodes}
    again = True
    while again:
        again = False
        for a, b in links:
            m = min(best[a], best[b])
            if best[a] != m or best[b] != m:
                best[a] = best[b] = m
                again = True
    return best


def test_exact_against_brute_force(spark, docs):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_duplicates(docs).collect()}
    groups = {}
    for i, t in texts():
        groups.setdefault(SPACE.sub("", t or ""), []).append((i, len(t or "")))
    assert sum(len(g) for g in groups.values()) == docs.count() == exact_dedup.exact_duplicates(docs).count()
    import hashlib

    for text, g in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        keep = min(g, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[0]
        for i, _ in g:
            r = got[i, sha]
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(g), i == keep)


def test_exact_at_the_ends_of_long(spark):
    rows = [(-(1 << 63), "a b"), ((1 << 63) - 1, "ab"), (0, "a b"), (None, "a  b"), (-(1 << 63), "c"), (5, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for support in (0.001, 0.4):
        got = exact_dedup.exact_duplicates(df, support).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [
            (False, -(1 << 63), -(1 << 63), 2, True), (False, -(1 << 63), 0, 4, False), (False, 0, 0, 4, False),
            (False, 5, -(1 << 63), 2, False), (False, (1 << 63) - 1, 0, 4, False), (True, 0, 0, 4, True),
        ]
    assert sorted((r.text, r.doc_id) for r in exact_dedup.drop_exact_duplicates(df).collect()) == [("a  b", None), ("c", -(1 << 63))]


@pytest.mark.parametrize("support", [0.001, 0.2, 0.9])
def test_exact_support_changes_nothing(docs, support):
    rows = lambda s: sorted(map(str, exact_dedup.exact_duplicates(docs, s).collect()))
    assert rows(support) == rows(0.01)


def test_exact_stage_keeps_one_row_of_each(docs):
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    left = [SPACE.sub("", r.text or "") for r in out.collect()]
    assert sorted(left) == sorted({SPACE.sub("", t or "") for _, t in texts()})


def test_exact_is_free_of_python(docs):
    plan = exact_dedup.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_exact_empty(no_docs):
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    assert exact_dedup.drop_exact_duplicates(no_docs).count() == 0


def test_shingles_agree_with_words():
    for _, t in texts():
        got = shingles.shingle_sets([t or ""])[0]
        assert len(got) == len(shingle_set(t))
    text = b" ".join(b"word%d" % (i % 77) for i in range(3000)) + b"\n" + b"x" * 5000 + b" end"
    assert (shingles.word_hashes(text, 100) == shingles.word_hashes(text)).all() and len(shingles.word_hashes(text, 64)) == 3002
    a, b = shingles.shingle_sets(["ONE two  three", "one TWO\x0bthree"])
    assert (a == b).all()
    assert len(np.unique(shingles.word_hashes(b" ".join(b"%d" % i for i in range(50_000))))) == 50_000


def test_structured_words_do_not_collide(spark):
    """Words on which polynomial hashes cancel: a sequence over two letters and its complement, doubled again and again."""
    word, pairs = "a", []
    for _ in range(13):
        word += word.translate(str.maketrans("ab", "ba"))
        pairs += [word, word.translate(str.maketrans("ab", "ba"))]
    hashes = shingles.word_hashes(" ".join(pairs).encode())
    assert len(np.unique(hashes)) == len(pairs)
    a, b = pairs[-2:]
    rows = [(1, a), (2, b), (3, f"{a} q {b}"), (4, f"{b} q {a}"), (5, f"{a} {a} {a} {b} {b} {b}"), (6, f"{b} {b} {b} {a} {a} {a}")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert all(r.component_id == r.doc_id and r.kept for r in got)
    swapped = shingles.shingle_sets(["a b c d e", "b a c d e", "e d c b a", "ab c d e", "a bc d e"])
    assert len({tuple(x) for x in swapped}) == 5


def test_rounded_ranks_keep_their_order():
    ranks = np.unique(np.concatenate((np.arange(20_000), np.arange(0, shingles.UNIVERSE, 997), [shingles.UNIVERSE - 1]))).astype(np.uint32)
    got = shingles._rounded(ranks).astype(np.int64)
    assert (np.diff(got) >= 0).all() and (got[:8192] == np.arange(8192)).all()
    changes = np.flatnonzero(np.diff(got))
    assert len(np.unique(got)) > 0.9 * len(ranks[ranks < 8192]) and (np.diff(ranks[changes].astype(float)) / ranks[changes][1:] < 0.01)[-1000:].all()
    assert len(np.unique(shingles._permuted(np.arange(shingles.UNIVERSE, dtype=np.uint32), (0x9E3779B1, 0x27D4EB2F)))) == shingles.UNIVERSE


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate((a[:850], rng.integers(0, 1 << 63, 100).astype(np.uint64))))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((shingles.signature(a, 600) == shingles.signature(b, 600)).mean() - j) < 0.08


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_against_brute_force(docs, percent):
    rows = {i: shingle_set(t) for i, t in texts() if i is not None}
    links = [
        (a, b) for a in rows for b in rows
        if a < b and rows[a] and rows[b] and 100 * len(rows[a] & rows[b]) >= percent * len(rows[a] | rows[b])
    ]
    best = components(rows, links)
    for r in minhash_dedup.near_duplicates(docs, percent).collect():
        if r.doc_id is None:
            continue
        assert (r.n_shingles, r.component_id, r.kept) == (len(rows[r.doc_id]), best[r.doc_id], best[r.doc_id] == r.doc_id)
    assert best[11] == 9 and best[20] == 19 and best[2] == 2


def test_minhash_without_ids(docs):
    rows = [r for r in minhash_dedup.near_duplicates(docs).collect() if r.doc_id is None]
    assert sorted((r.component_id is None, r.kept) for r in rows) == [(False, False), (True, True)]


def test_minhash_hot_family(spark, monkeypatch):
    """Chains and stars of near copies around one text, in blocks smaller than the family."""
    rng = np.random.default_rng(3)
    base = passage(11, 100).split()
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.choice(100, rng.integers(0, 8), replace=False):
            w[k] = f"x{rng.integers(0, 50)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    best = components(sets, links)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r.doc_id: r.component_id for r in got} == best
    monkeypatch.setattr(minhash_dedup, "BLOCK", 10_000)
    monkeypatch.setattr(blocks, "ELEMENTS", 2000)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r.doc_id: r.component_id for r in got} == best


def test_minhash_stage(docs, no_docs):
    out = minhash_dedup.keep_one_of_each(docs)
    assert out.columns == docs.columns
    ids = {r.doc_id for r in out.collect()}
    assert {9, 13, 19, 1, 2, 3} <= ids and not ids & {10, 11, 14, 15, 20}
    assert minhash_dedup.near_duplicates(no_docs).count() == 0 == minhash_dedup.keep_one_of_each(no_docs).count()


def test_minhash_stage_goes_by_row(spark, docs):
    """Rows without id or with a repeated id go by their own text, not by the id."""
    left = [(r.doc_id, r.text) for r in minhash_dedup.keep_one_of_each(docs).collect()]
    assert (None, None) in left and (None, "no id here at all, none") not in left and left.count((9, passage(0))) == 1
    alone, other = passage(101, 80), " ".join(f"q{i}" for i in range(70))
    rows = [
        (1, passage(0)), (7, passage(0, change=59)), (7, alone), (None, passage(0).upper()), (None, other), (None, ""), (None, "short one"),
        (8, passage(2, 90)), (8, passage(2, 90, change=89)), (None, passage(4, 90)), (None, passage(4, 90, change=89)), (None, passage(4, 90).upper()),
        (None, passage(2, 90, change=0)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = minhash_dedup.keep_one_of_each(df).collect()
    assert [(r.doc_id, r.text) for r in left if r.text in (alone, other, "", "short one")].__len__() == 4
    sets = sorted((r.doc_id or 0, r.text.lower()[:6]) for r in left if r.text not in (alone, other, "", "short one"))
    assert sets == sorted([(1, passage(0)[:6]), (8, passage(2)[:6]), (0, passage(4)[:6])])
    got = minhash_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) and sum(r.component_id == 7 for r in got) == 1 and sum(r.component_id == 8 for r in got) == 3


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 200, n).astype(np.uint64) << np.uint64(56)) for n in (1, 5, 50, 300)]
    got = minhash_dedup.intersections(sets)
    assert all(len(np.intersect1d(sets[i], sets[j])) == got[i, j] for i in range(4) for j in range(4) if i != j)


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (7, 100), (40, 39)]
    nodes = {n for e in edges for n in e}
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: c for n, c in components(nodes, edges).items() if n != 5}
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mark_probable_misses_none(spark):
    ids = spark.range(0, 5000, 7)
    out = common.mark_probable(spark.range(5000).withColumnRenamed("id", "k"), "k", ids)
    marked = {r.k for r in out.where("_probable").collect()}
    assert out.count() == 5000 and set(range(0, 5000, 7)) <= marked and len(marked) < 1500


@pytest.mark.parametrize("classes", [1, 3, 100, 5000])
@pytest.mark.parametrize("key", ["-id", "id div 300", "cast(null as long)"])
def test_number_in_class(spark, classes, key):
    df = common.save(spark.range(6000).selectExpr(f"id % {classes} as c", f"{key} as k").repartition(5), "t")
    own = {}
    for r in common.number_in_class(df, "c", ["k"]).collect():
        own.setdefault(r.c, []).append((r["rank"], r.k or 0))
    for rows in own.values():
        rows.sort()
        assert [n for n, _ in rows] == list(range(len(rows))) and [k for _, k in rows] == sorted(k for _, k in rows)
    assert sum(map(len, own.values())) == 6000


def test_batches_are_small_only_for_a_while(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with common.small_batches(spark):
        assert spark.conf.get(key) == str(common.TEXT_ROWS)
    assert spark.conf.get(key) == before


def test_tables_can_be_removed(spark):
    scratch = common.Scratch()
    scratch.save(spark.range(3), "gone")
    path = scratch.tables[0].path.removeprefix("file://")
    assert os.path.exists(path)
    scratch.drop()
    assert not os.path.exists(path) and not scratch.tables


def vectors():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        base = np.random.default_rng(i % 12).standard_normal(16)
        v = (base + rng.standard_normal(16) * 0.08 * (i % 4)).astype(np.float32)
        rows.append((i, v.tolist(), i % 2))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], None), (203, None, 0), (204, [0.0] * 16, 0), (205, [float("nan")] * 16, 0)]
    rows += [(206, [None] + [1.0] * 15, 0), (207, [float("inf")] + [1.0] * 15, 0), (208, [1.0, 0.0], 0), (209, [2.0, 0.0], 0), (210, [], 0), (0, rows[0][1], 0)]
    return rows


def test_embeddings_against_brute_force(spark, monkeypatch):
    rows = vectors()
    ok = [
        k for k, (_, v, y) in enumerate(rows)
        if y is not None and v and None not in v and np.isfinite(v).all() and any(v)
    ]
    links = []
    for a in ok:
        for b in ok:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links.append((a, b))
    best = components([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in links])
    n = [sum(a == k for a, _ in links) for k in range(len(rows))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = embedding_dedup.near_duplicate_vectors(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted(
        (i, n[k], best[i], best[i] == i) for k, (i, _, _) in enumerate(rows)
    )
    for name, value in (("BLOCK", 8), ("ELEMENTS", 100), ("BITS", 20)):
        monkeypatch.setattr(embedding_dedup, name, value)
        assert sorted(map(str, embedding_dedup.near_duplicate_vectors(df).collect())) == sorted(map(str, got))
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_embeddings_without_ids_or_with_repeated_ids(spark):
    rng = np.random.default_rng(8)
    a, b, c = rng.standard_normal((3, 16))
    near = lambda v: (v + 0.01).tolist()
    rows = [(1, a.tolist(), 0), (None, near(a), 0), (None, b.tolist(), 0), (None, near(b), 0), (7, near(near(a) + np.array(0.01)), 0), (7, c.tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.near_duplicate_vectors(df).collect()))
    assert got == [(0, 1, 0, False), (0, 1, 0, True), (0, 2, 1, False), (1, 2, 1, True), (7, 0, 7, True), (7, 2, 1, False)]


def test_minhash_links_rows_without_ids(spark):
    rows = [(None, passage(0, 90)), (None, passage(0, 90, change=89)), (3, passage(5, 90)), (None, passage(5, 90, change=0)), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash_dedup.near_duplicates(df).collect())
    assert got == [(0, 0, False), (0, 0, True), (0, 0, True), (0, 3, False), (3, 3, True)]


def test_embeddings_of_doubles(spark):
    big, small = [1e300, 2e300, -1e300], [1e-300, 2e-300, -1e-300]
    edge = [0.98 - 1e-10, (1 - (0.98 - 1e-10) ** 2) ** 0.5, 0.0]  # just below 0.98 to the axis
    rows = [(1, big, 0), (2, small, 0), (3, [1.0, 0.0, 0.0], 1), (4, edge, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicate_vectors(df).select("vec_id", "n_links", "component_id").collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]


def test_embedding_keys_find_pairs_at_the_edge(spark):
    """Recall of the candidate search, for pairs exactly at the least cosine and the settings of small to huge labels."""
    rng = np.random.default_rng(2)
    sizes = spark.createDataFrame([(100,), (50_000,), (10**8,)], "n long").select("n", embedding_dedup.signs(F.col("n")))
    for classes, bits in sizes.collect():
        tables = embedding_dedup.tables_for(bits, 0.98)
        assert 2.0**-bits * classes * tables < tables  # unrelated vectors of a label share few buckets
        a = rng.standard_normal((3000, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.standard_normal((3000, 64))
        b -= (a * b).sum(1, keepdims=True) * a
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        same = embedding_dedup.table_codes(a, bits, tables) == embedding_dedup.table_codes(b, bits, tables)
        assert same.any(1).all()
    keys = embedding_dedup.table_keys(np.zeros((3, 2), np.uint32), np.array([0, 1, -1]), 64)
    assert len(np.unique(keys)) == 6


def test_each_label_has_its_own_keys(spark):
    """A small label keeps its few tables beside a large one, and pairs of both are found."""
    rng = np.random.default_rng(7)
    rows = []
    for label, n in ((0, 1500), (1, 20)):
        x = rng.standard_normal((n, 16))
        rows += [(label * 10_000 + i, v.tolist(), label) for i, v in enumerate(np.concatenate((x, x[:10] + 0.01 * rng.standard_normal((10, 16)))))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    for label in (0, 1):
        own = [(i, np.array(v)) for i, v, k in rows if k == label]
        x = np.stack([v for _, v in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert [got[i] for i, _ in own] == ((x @ x.T >= 0.98).sum(1) - 1).tolist()
    classes = spark.createDataFrame([(i, label, np.array(v).tobytes(), b) for i, v, label in rows[:2] + rows[-2:] for b in [15 if label == 0 else 12]], "node long, label long, vector binary, bits int")
    n = [len(r["keys"]) for r in embedding_dedup._keyed(classes, np.float64, 0.98).orderBy("node").collect()]
    assert n == [embedding_dedup.tables_for(15, 0.98)] * 2 + [embedding_dedup.tables_for(12, 0.98)] * 2 and n[0] > n[2]


def test_embeddings_with_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 0, "x", 5, b"y"), (2, [1.0, 0.001], 0, "x", 5, b"y"), (3, [0.0, 1.0], 0, "x", 5, b"y"), (4, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, bucket string, node int, digest binary")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicate_vectors(df).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
