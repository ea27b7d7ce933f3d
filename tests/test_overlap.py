import threading
import time

import numpy as np
import pytest

from inkfold.operators import overlap
from inkfold.operators.embedding import hash_embedder
from inkfold.sources import html, readers  # noqa: F401  registers the parser of pages


@pytest.mark.parametrize("depth", [1, 3])
def test_items_come_in_order(depth):
    assert list(overlap.ahead(iter(range(50)), depth)) == list(range(50)) and list(overlap.ahead(iter(()), depth)) == []


def test_an_error_comes_where_it_belongs():
    def source():
        yield 1
        raise OSError("gone")

    items = overlap.ahead(source())
    assert next(items) == 1
    with pytest.raises(OSError, match="gone"):
        next(items)


def test_the_thread_is_bounded_and_ends():
    made = []

    def source():
        for i in range(1000):
            made.append(i)
            yield i

    items, before = overlap.ahead(source(), 2), threading.active_count()
    assert next(items) == 0
    time.sleep(0.3)
    assert len(made) <= 4
    items.close()
    assert threading.active_count() <= before


def test_two_slow_steps_take_the_time_of_one():
    def source():
        for i in range(12):
            time.sleep(0.05)
            yield i

    def taken(items):
        began = time.perf_counter()
        for _ in items:
            time.sleep(0.05)
        return time.perf_counter() - began

    assert taken(overlap.ahead(source())) < 0.75 * taken(source())


def test_same_rows_with_and_without_overlap(spark):
    pages = [(f"p{i}", ("<h1>Head</h1>" + "".join(f"<p>text {i} number {k}" for k in range(i % 7)) + "<img>").encode()) for i in range(40)]
    files = spark.createDataFrame([*pages, ("bad", b"\xff"), ("plain", b"no page")], "paper_id string, content binary").repartition(3)
    key = lambda r: (r.paper_id, r.ord or 0)
    both = [sorted(overlap.parse_and_embed(files, "html", hash_embedder, 5, depth).collect(), key=key) for depth in (0, 2)]
    assert both[0] == both[1]
    by = {}
    for r in both[1]:
        by.setdefault(r.paper_id, []).append(r)
    assert [r.error.split(":")[0] for r in by["bad"] + by["plain"]] == ["UnicodeDecodeError", "ValueError"] and by["bad"][0].embedding is None
    assert [r.text for r in by["p3"]] == ["Head", "text 3 number 0", "text 3 number 1", "", "text 3 number 2"] or len(by["p3"]) == 5
    want = hash_embedder()([r.text for r in by["p6"] if r.text])
    assert np.allclose([r.embedding for r in by["p6"] if r.text], want) and all(r.embedding is None for r in by["p6"] if not r.text)
