import random

from pyspark.sql import functions as F

from inkfold.operators import layout, quality, statistics


def test_merged_statistics_against_exact_ones(spark):
    rng = random.Random(4)
    rows = [(f"{rng.randrange(300)}:{rng.choice(['c1', 'fig_p0_i1', 't0:r1', 'f3'])}", "x" * int(rng.lognormvariate(5, 1.2))) for _ in range(4000)]
    rows += [("1:c0", None), ("1:c0", "")]
    chunks = spark.createDataFrame([(*r, i % 7) for i, r in enumerate(rows)], "chunk_id string, content string, part int")
    parts = statistics.of_batch(chunks, "part").drop("part")
    got = {r.modality: r for r in statistics.estimates(statistics.merged(statistics.merged(parts.where("n_chunks > 150")).unionByName(parts.where("n_chunks <= 150")))).collect()}
    once = {r.modality: r for r in statistics.estimates(statistics.of_batch(chunks)).collect()}
    exact = {}
    for i, t in rows:
        kind = {"c": "text", "fi": "figure", "t0": "table", "f3": "formula"}
        exact.setdefault(kind.get(i.split(":")[1][:2], "text"), []).append((i.split(":")[0], len(t or "")))
    assert set(got) == set(exact)
    for kind, own in exact.items():
        n = sorted(k for _, k in own)
        r = got[kind]
        assert (r.n_chunks, r.n_chars, r.min_len, r.max_len) == (len(n), sum(n), n[0], n[-1]) and r.avg_len == sum(n) // len(n)
        edges = (0, *quality.EDGES_5, 10**9)
        assert r.histogram == [sum(a <= k < b for k in n) for a, b in zip(edges, edges[1:])] == once[kind].histogram
        assert abs(r.n_papers / len({p for p, _ in own}) - 1) <= statistics.PAPER_ERROR
        for q, found in zip((0.5, 0.9, 0.99), r.quantiles):
            assert sum(k < found for k in n) / len(n) <= q + statistics.RANK_ERROR and sum(k <= found for k in n) / len(n) >= q - statistics.RANK_ERROR
    assert statistics.merged(parts.limit(0)).count() == 0


def test_range_joins_of_a_page_of_very_many_blocks(spark):
    """Pairs as a plain loop finds them; coordinates on the edges of bands, below zero and null."""
    rng = random.Random(1)
    y = lambda: rng.choice([0.0, 250.0, 500.0, -250.0, 249.5, 750.0]) + rng.choice([0, 0, 1, -1, rng.uniform(-300, 300)])
    images = [("p", 0, i, 0, 10.0, 0.0, 90.0, y()) for i in range(80)] + [("q", 1, 0, 0, 0.0, 0.0, 9.0, None)]
    blocks = [("p", 0, i, f"Figure {i}. text", rng.uniform(0, 100), y(), rng.uniform(100, 200), 0.0) for i in range(300)] + [("p", 0, 999, "Figure 1", 10.0, None, 20.0, 0.0)]
    i = spark.createDataFrame(images, "paper_id string, page_no int, img_idx int, rect_no int, ix0 double, iy0 double, ix1 double, iy1 double")
    b = spark.createDataFrame(blocks, "paper_id string, page_no int, block_no int, text string, x0 double, y0 double, x1 double, y1 double")
    got = {r.img_idx: (r.distance, r.caption) for r in layout.captions_below(i, b).collect()}
    want = {}
    for im in images[:-1]:
        near = [(t[5] - im[7], t[2], t[3]) for t in blocks[:-1] if 0 <= t[5] - im[7] <= 250 and t[6] >= im[4] and t[4] <= im[6]]
        if near:
            want[im[2]] = (min(near)[0], min(near)[2])
    assert got == want and len(want) > 40
    regions = [("p", 0, k, 0.0, min(a, c), 150.0, max(a, c)) for k, (a, c) in enumerate((y(), y()) for _ in range(40))] + [("p", 0, 50, 0.0, 9.0, 9.0, 3.0)]
    r = spark.createDataFrame(regions, "paper_id string, page_no int, region_no int, rx0 double, ry0 double, rx1 double, ry1 double")
    lines = b.withColumn("y1", F.col("y0") + 4).withColumnRenamed("block_no", "line_no")
    got = {x.region_no: x.n_lines for x in layout.region_texts(r, lines).collect()}
    inside = lambda g, t: g[3] <= (t[4] + t[6]) / 2 <= g[5] and g[4] <= t[5] + 2 <= g[6]
    assert got == {g[2]: sum(inside(g, t) for t in blocks[:-1]) for g in regions}
