import random
import time

from inkfold.operators import adapters, evalset

SCHEMA = "paper_id string, ord long, text string, fonts array<string>, page int, y0 double, y1 double"


def plain(blocks, least=300):
    """Merged texts of one paper, block by block; True: a block that stands alone."""
    out, held, size = [], [], 0
    for text, alone in blocks:
        if alone or size >= least:
            out += [(" ".join(held), False)] if held else []
            held, size = [], 0
        if alone:
            out.append((text, True))
        else:
            held.append(text)
            size += len(text) + 1
    return out + ([(" ".join(held), False)] if held else [])


def kinds(rng, n):
    for _ in range(n):
        k = rng.random()
        yield ("long words here " * 25).strip() if k < 0.1 else "x² = ∑ y ≤ z" if k < 0.2 else "words in a row " * rng.randint(1, 12) + "end"


def rows_of(paper, texts):
    return [(paper, i, t, ["Times"] if "∑" not in t else ["CMMI10"], 3, 1.0, 2.0) for i, t in enumerate(texts)]


def test_merging_against_a_plain_loop(spark):
    rng = random.Random(8)
    papers = {f"p{k}": list(kinds(rng, rng.choice([0, 1, 2, 30, 200]))) for k in range(12)} | {"edge": ["a" * 149, "b" * 149, "c", "  ", "d" * 299, "e" * 300, "f"]}
    rows = [r for p, t in papers.items() for r in rows_of(p, t)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {}
    for r in sorted(adapters.merge_short_blocks(df).collect(), key=lambda r: (r.paper_id, r.ord)):
        assert r.ord == len(got.setdefault(r.paper_id, []))
        got[r.paper_id].append((r.text, not r.merged))
        assert (r.page, r.y0, r.y1) == ((0, 0.0, 0.0) if r.merged else (3, 1.0, 2.0))
    alone = lambda t: "∑" in t or len(t) >= 300
    assert got == {p: plain([(x, alone(x)) for x in (t.strip() for t in texts) if x]) for p, texts in papers.items() if any(t.strip() for t in texts)}


def test_a_paper_of_very_many_blocks_is_one_run(spark):
    n = 200_000
    df = spark.range(n).selectExpr("'p' AS paper_id", "id AS ord", "concat('some words of block ', id) AS text", "array('Times') AS fonts", "1 AS page", "0.0D AS y0", "1.0D AS y1")
    began = time.perf_counter()
    merged = adapters.merge_short_blocks(df).selectExpr("count(*) AS n", "sum(length(text) + 1) AS size", "max(length(text)) AS most").first()
    assert time.perf_counter() - began < 90
    blocks = [(f"some words of block {i}", False) for i in range(n)]
    want = plain(blocks)
    assert (merged.n, merged.size, merged.most) == (len(want), sum(len(t) + 1 for t, _ in want), max(len(t) for t, _ in want))


def greedy(links, n):
    accepted = {}
    for i in range(n):
        accepted[i] = not any(accepted[j] for j in links.get(i, ()))
    return accepted


def test_rejection_along_a_chain_of_thousands(spark, monkeypatch):
    """A chain of like questions, and random links among others: rounds go with the ranges, not with the chain."""
    rng = random.Random(3)
    links = {i: [i - 1] for i in range(1, 6000)}
    for i in range(6000, 7000):
        links[i] = rng.sample(range(6000, i), min(i - 6000, rng.randint(0, 3)))
    pairs = spark.createDataFrame([(a, b) for b, own in links.items() for a in own], "a long, b long")
    monkeypatch.setattr(evalset, "similar_questions", lambda rows, above: pairs)
    rounds, write = [], evalset.stored
    monkeypatch.setattr(evalset, "stored", lambda df, name: rounds.append(name) or write(df, name))
    df = spark.createDataFrame([(i, f"q {i}") for i in range(7000)], "query_id long, question string")
    got = {r.query_id: r.accepted for r in evalset.reject_near_duplicates(df).collect()}
    assert got == greedy(links, 7000)
    assert rounds.count("said") <= int(spark.conf.get("spark.sql.shuffle.partitions")) + 2
