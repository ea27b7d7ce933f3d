import json
import sys
import threading
import types
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from inkfold.__main__ import main
from inkfold.operators import embedding
from inkfold.plans.app import Store
from inkfold.sources import parsers, readers, remote

CATS = "# Cats\n\nRed cats chase grey mice through the garden every morning.\n\n# Dogs\n\nOld dogs sleep near the warm fireplace all winter long."


def test_from_folder_to_answers(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "21.md").write_text(CATS)
    (tmp_path / "docs" / "22.md").write_text("# Fish\n\nSilver fish swim in cold rivers and never chase anything.\n\nunrelated words follow")
    (tmp_path / "cases.jsonl").write_text(
        json.dumps({"question": "why do cats chase mice through gardens", "gold_source_ids": ["21:c0"], "answerable": True})
        + "\n" + json.dumps({"question": "zzz qqq", "gold_source_ids": [], "answerable": False}) + "\n"
    )
    args = ["--store", str(tmp_path / "store"), "--docs", str(tmp_path / "docs"), "--pattern", "*.md", "--parser", "utf8"]
    assert main([*args, "--run-all", "--cases", str(tmp_path / "cases.jsonl")]) == 0
    out = capsys.readouterr().out
    assert "recall: 100.0%" in out and "n_refused: 1" in out
    main([*args, "--query", "where do dogs sleep in winter near a fireplace"])
    assert "answered: Based on the retrieved source [21:c1]" in capsys.readouterr().out
    store = Store(spark, str(tmp_path / "store"))
    chunks = store.read("chunks").orderBy("ord").collect()
    assert [(r.chunk_id, r.section) for r in chunks] == [("21:c0", "Cats"), ("21:c1", "Dogs"), ("22:c0", "Fish"), ("22:c1", "Fish")]
    assert store.report().first().totals.n_papers == 2
    main([*args, "--reset"])
    assert store.read("chunks").count() == 4


def rows_of(content):
    if content == b"bad":
        raise ValueError("broken")
    box = {"x0": 50.0, "x1": 400.0}
    yield {"kind": "page", "page_no": 0, "text": "raw", "width": 600.0}
    for b, (y, text, font) in enumerate([(10.0, "A long paragraph " * 20, "Times"), (200.0, "x = ∑ y² + z²", "CMMI10"), (215.0, "≤ ∞ + q", "CMR7"), (420.0, "Figure 1. A caption", "Times")]):
        yield {"kind": "span", "page_no": 0, "block_no": b, "item_no": 0, "block_type": 0, "text": text, "font": font, "y0": y, "y1": y + 10, **box}
    yield {"kind": "image", "page_no": 0, "block_no": 0, "item_no": 0, "n_bytes": 9000, "content": b"i", "y0": 300.0, "y1": 400.0, **box}
    yield {"kind": "image", "page_no": 0, "block_no": 1, "item_no": 0, "n_bytes": 90, "y0": 300.0, "y1": 400.0, **box}
    yield {"kind": "table", "page_no": 0, "item_no": 0, "text": "| A | B |\n|---|---|\n| 1 | 2 |"}


def test_page_elements(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"good")
    (tmp_path / "q.pdf").write_bytes(b"bad")
    raw = parsers.extract_pages(readers.document_files(spark, str(tmp_path)), rows_of)
    assert [r.error for r in parsers.failed(raw).collect()] == ["ValueError: broken"]
    e = {k: [tuple(r) for r in v.collect()] for k, v in parsers.page_elements(raw).items()}
    assert [t[2] for t in e["texts"]] == [("A long paragraph " * 20).strip(), "Figure 1. A caption"]
    assert e["formulas"] == [("p", "f0", "x = ∑ y² + z² ≤ ∞ + q")]
    assert e["figures"] == [("p", "fig_p0_i0", "Figure 1. A caption", None)]
    assert [t[1] for t in e["tables"]] == ["tbl_p0_t0"]


def test_mupdf_rows(monkeypatch):
    class Page:
        rect = types.SimpleNamespace(width=600)

        def get_text(self, kind=None):
            return {"blocks": [{"type": 0, "bbox": (0, 1, 2, 3), "lines": [{"spans": [{"text": "a", "font": "F"}, {"text": "b"}]}]}, {"type": 1, "bbox": (0, 0, 0, 0)}]} if kind else "ab"

        def get_images(self, full):
            return [(7,)]

        def get_image_rects(self, xref):
            return [(1, 2, 3, 4), (5, 6, 7, 8)]

        def find_tables(self):
            return types.SimpleNamespace(tables=[types.SimpleNamespace(to_markdown=lambda: "|t|")])

    class Doc(list):
        def __enter__(self):
            return self

        def __exit__(self, *x):
            return None

        def extract_image(self, xref):
            return {"image": b"xyz"}

    monkeypatch.setitem(sys.modules, "pymupdf", types.SimpleNamespace(open=lambda stream, filetype: Doc([Page()])))
    kinds = [(r["kind"], r.get("text"), r.get("n_bytes")) for r in parsers._mupdf_rows(b"")]
    assert kinds == [("page", "ab", None), ("span", "a", None), ("span", "b", None), ("image", None, 3), ("image", None, 3), ("table", "|t|", None)]
    assert parsers._pymupdf()("n", b"")[0]["text"] == "ab"


def test_chat(monkeypatch):
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            ok = len(seen) > 1
            self.send_response(200 if ok else 500)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "[a] yes"}}]}).encode() if ok else b"")

        def log_message(self, *x):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("LLM_BASE_URL", f"http://127.0.0.1:{server.server_port}/v1")
    assert remote.chat_generator()(["q", "r"], [[{"source_id": "a", "snippet": "s"}], []]) == ["[a] yes", ""]
    assert len(seen) == 2 and "[a] s" in seen[0]["messages"][0]["content"]
    server.shutdown()
    calls = []

    def fails():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError):
        remote.retried(fails, wait=0)
    assert len(calls) == 3


def test_model_falls_back_to_hashing(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", "text", "one two one é"), ("b", "text", "")], "chunk_id string, modality string, content string")
    model = {r.chunk_id: r.embedding for r in embedding.embed_chunks(df, embedding.model_or_hash("no/such-model")).collect()}
    native = {r.chunk_id: r.embedding for r in embedding.dense(embedding.hash_vectors(df, "chunk_id", "content"), "chunk_id", df.select(F.col("chunk_id"))).collect()}
    assert model == native


def test_compare(spark):
    from inkfold.plans.compare import compare

    got = compare({"a": lambda: spark.range(10), "b": lambda: spark.range(1000)}, units=10)
    assert set(got) == {"a", "b"} and min(x["speed"] for x in got.values()) == 1.0


def test_vision_generator(monkeypatch):
    """A local model behind the usual interface of such libraries."""
    import numpy as np

    class Given(dict):
        def to(self, device):
            return self

    class Processor:
        def apply_chat_template(self, messages, tokenize, add_generation_prompt):
            return messages[0]["content"]

        def __call__(self, text, return_tensors):
            self.asked = text[0]
            return Given(input_ids=np.zeros((1, 4), int))

        def batch_decode(self, ids, skip_special_tokens):
            return [f" {ids.shape[1]} new; {'[a] s' in self.asked} "]

    loads = lambda made: types.SimpleNamespace(from_pretrained=lambda name, **k: made)
    net = types.SimpleNamespace(device="cpu", generate=lambda input_ids, max_new_tokens: np.zeros((1, 4 + max_new_tokens), int))
    monkeypatch.setitem(sys.modules, "transformers", types.SimpleNamespace(AutoProcessor=loads(Processor()), AutoModelForImageTextToText=loads(net)))
    assert remote.vision_generator(max_tokens=7)(["q", "r"], [[{"source_id": "a", "snippet": "s"}], []]) == ["7 new; True", ""]


def test_a_dense_search_of_ones_own(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "21.md").write_text(CATS)
    (tmp_path / "docs" / "22.md").write_text("# Fish\n\nSilver fish swim in cold rivers.")
    store = Store(spark, str(tmp_path / "store"))
    store.ingest(str(tmp_path / "docs"), "utf8", "*.md")
    store.index()
    asked = spark.createDataFrame([(1, "where do dogs sleep"), (2, "silver fish")], "query_id long, question string")

    def always_fish(questions, k=10):
        fish = store.read("chunks").where("paper_id = '22'").selectExpr("chunk_id", "ord", "1.0D AS score", "1 AS rank")
        return questions.select("query_id").crossJoin(fish)

    best = {r.query_id: r.chunk_id for r in store.search(asked, 3, always_fish).where("rank = 1").collect()}
    assert best == {1: "22:c0", 2: "22:c0"}
    assert {r.query_id: r.chunk_id for r in store.search(asked, 3).where("rank = 1").collect()} == {1: "21:c1", 2: "22:c0"}
    said = {r.query_id: r.status for r in store.ask(asked, k=3, dense=always_fish).collect()}
    assert said[2] == "answered"
