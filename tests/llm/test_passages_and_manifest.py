import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfold.llm import merkle, suffix_dedup

from .conftest import DOCS, passage, texts


def without_repeats(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each of ``rows`` (doc_id, text), window by window."""
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49 if i is not None else 0):
            s = b[k : k + 50]
            first[s] = min(first.get(s, i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49 if i is not None else 0):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removed(spark, rows, slices=3):
    df = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], "doc_id long, text string, slot string, key int, low int, first string").repartition(slices)
    return sorted((tuple(r) for r in suffix_dedup.remove_repeats(df).collect()), key=str)


def test_repeats_of_cases(spark, docs, no_docs):
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()), key=str)
    assert got == without_repeats(texts())
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_repeats_in_random_texts(spark):
    rng = random.Random(5)
    shared = ["".join(rng.choices("ab é", k=rng.randint(40, 140))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = ["".join(rng.choices("abcdefgh \n", k=rng.randint(0, 90))) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randint(0, 6))]
        rows.append((rng.randint(-40, 90), "".join(parts)))
    rows += [(i, "z" * 49 + str(i)) for i in range(60)] + [(i, "z" * (48 + i)) for i in range(5)] + [(200, "ab" * 400), (201, "x" + "ab" * 100), (202, "ba" * 60)]
    rows += [((1 << 63) - 1, shared[0] * 2), (-(1 << 63), shared[1] + "q"), (7, None), (None, shared[0] * 3), (None, None)]
    assert removed(spark, rows) == without_repeats(rows)


def test_repeats_in_a_hot_slot(spark):
    """One passage in every document, between texts of its own, and a group of copies of a third of all rows."""
    rng = random.Random(6)
    own = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    hot = own(130)
    rows = [(i, own(rng.randint(0, 60)) + hot + own(rng.randint(0, 60))) for i in range(300)] + [(i, hot + "end") for i in range(1000, 1150)]
    rng.shuffle(rows)
    assert removed(spark, rows, 8) == without_repeats(rows)


def test_long_texts_are_scanned_in_parts(spark):
    rng = np.random.default_rng(3)
    long_ = rng.integers(97, 123, 700_000, dtype=np.uint8).tobytes().decode()
    part = suffix_dedup.PART
    rows = [(1, long_), (2, "x" + long_[part - 60 : part + 70] + "y" + long_[2 * part - 1 : 2 * part + 60]), (3, long_[: part + 10] + "é" + long_[600_000:]), (4, "k" * 600_000), (5, "k" * 70)]
    got = removed(spark, rows)
    n = [len(t.encode()) for _, t in rows]
    # 2: both passages; 3: all but the letter; 4: nothing is smaller; 5: all
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(1, n[0], 0, 0), (2, n[1], n[1] - 2, 2), (3, n[2], n[2] - 2, 2), (4, n[3], 0, 0), (5, n[4], 70, 1)]
    assert [r[4] for r in got][1:3] == [hashlib.sha256(t.encode()).hexdigest() for t in ("xy", "é")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9)), min_size=1, max_size=60))
def test_longest_previous_factors(rows):
    windows = np.array([b"x" * 40 + bytes([w % 3]) * (10 - w) + bytes(w) for w, _ in rows], "S50")
    doc = np.array([d for _, d in rows])
    want = [any(v == w and e < d for v, (_, e) in zip(windows, rows)) for w, (_, d) in zip(windows, rows)]
    assert suffix_dedup.longest_previous(windows, doc).tolist() == want


def test_windows_of_one_slot_are_carried(spark):
    rng = random.Random(2)
    # windows that are equal have one slot
    base = [["".join(rng.choices(letters, k=60)) for _ in range(6)] for letters in ("ab", "cd")]
    rows = [(i, 1, k % 2, 0, 10, base[k % 2][rng.randrange(6)].encode()) for k, i in enumerate(rng.sample(range(1000), 400))]
    df = spark.createDataFrame(rows, "doc_id long, key long, slot long, low long, high long, bytes binary")
    want = {(d, s) for d, *_, b in rows for s in range(11) if any(e < d and any(c[k : k + 50] == b[s : s + 50] for k in range(11)) for e, *_, c in rows)}
    for n in (1, 100, 1 << 18):
        got = {(r.doc_id, s) for r in suffix_dedup.repeated_windows(df, n).collect() for s in range(r.start, r.stop - 49)}
        assert got == want


def test_slots_are_counted_in_any_portions(spark, docs):
    rows = docs.where("doc_id is not null and text is not null").selectExpr("doc_id", "cast(text as binary) AS text", "0L AS key")
    whole, small = ({r.slot: r.n for r in suffix_dedup.shared_slots(rows, 6, n).collect()} for n in (suffix_dedup.COUNTED, 50))
    assert whole == small and len(whole) > 50
    found = suffix_dedup.anchors(rows, 6).groupBy("slot").agg(F.countDistinct("doc_id").alias("d"), F.count("*").alias("n")).where("n > 1").collect()
    # rows that repeat a doc_id count each
    assert {r.slot for r in found if r.d > 1} <= set(whole) <= {r.slot for r in found}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    for own in levels[:-1]:
        yield own, i
        i //= 2


def plain_manifest(rows):
    def leaf(r, more=0):
        values = [r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]]
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top, out = tree([own[g][-1][0] for g in order]), []
    for k, g in enumerate(order):
        for i, (_, _, found, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc, proof = leaf(r, 1) if changed else found, ""
            for level, at in [*path(own[g], i), *path(top, k)]:
                sibling = level[at ^ 1] if at ^ 1 < len(level) else ""
                proof += sibling
                acc = h(sibling, acc) if at % 2 else h(acc, sibling)
            out.append((r[0], found, own[g][-1][0], top[-1][0], h(proof), acc, acc == top[-1][0]))
            assert out[-1][-1] != changed
    return sorted(out, key=str)


@pytest.mark.parametrize("up", [1, 2, 12])
def test_manifest_against_a_plain_tree(spark, docs, no_docs, up):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rng = random.Random(1)
    rows += [(rng.randrange(-50, 500), f"text {k}", rng.choice(["fr", "de", "", "é", "zz", "Z"]), "s", rng.choice([None, 3, (1 << 63) - 1])) for k in range(37)]
    rows += [(900, "alone", "only one", None, 5)] * 2 + [(901, "", "single", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({"tree": F.lit("x"), "place": F.lit(1), "hash": F.lit(2), "size": F.lit(3)})
    got = sorted((tuple(r) for r in merkle.manifest(df, up).collect()), key=str)
    assert got == plain_manifest(rows)


def test_manifest_of_one_and_of_none(spark, no_docs):
    assert merkle.manifest(no_docs).count() == 0
    one = spark.createDataFrame([(None, None, None, None, None, 0.1, None, 1, None)], DOCS)
    assert [tuple(r) for r in merkle.manifest(one).collect()] == plain_manifest([(None, None, None, None, None)])


def test_manifest_of_a_very_long_text(spark):
    rows = [(7, passage(1, 900_000), "en", "s", 12), (8, "é" * 100_000, "en", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((tuple(r) for r in merkle.manifest(df).collect()), key=str) == plain_manifest(rows)
