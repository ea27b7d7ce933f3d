"""Page extraction by external libraries, which are imported only where they run."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import adapters, layout
from .readers import register_parser

#: One row per span, image rectangle, table or page; columns that a kind doesn't have are null.
RAW = (
    "path string, paper_id string, kind string, page_no int, block_no int, item_no int, block_type int, text string, font string, "
    "x0 double, y0 double, x1 double, y1 double, width double, n_bytes long, content binary, error string"
)
LEAST_TABLE = 20
#: Rows of a file that are handed on at a time.
ROWS = 1000


def _mupdf_rows(content: bytes) -> Iterator[dict[str, Any]]:
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as doc:
        for no, page in enumerate(doc):
            yield {"kind": "page", "page_no": no, "text": page.get_text(), "width": float(page.rect.width)}
            for b, block in enumerate(page.get_text("dict")["blocks"]):
                spans = [s for line in block.get("lines", []) for s in line["spans"]]
                for i, s in enumerate(spans):
                    box = dict(zip(("x0", "y0", "x1", "y1"), map(float, block["bbox"])))
                    yield {"kind": "span", "page_no": no, "block_no": b, "item_no": i, "block_type": block["type"], "text": s["text"], "font": s.get("font", ""), **box}
            for i, image in enumerate(page.get_images(full=True)):
                body = doc.extract_image(image[0])["image"]
                for r, rect in enumerate(page.get_image_rects(image[0])):
                    box = dict(zip(("x0", "y0", "x1", "y1"), map(float, rect)))
                    yield {"kind": "image", "page_no": no, "block_no": i, "item_no": r, "n_bytes": len(body), "content": body if r == 0 else None, **box}
            for i, t in enumerate(page.find_tables().tables):
                yield {"kind": "table", "page_no": no, "item_no": i, "text": t.to_markdown()}


def extract_pages(files: DataFrame, rows_of: Callable[[bytes], Iterator[dict[str, Any]]] = _mupdf_rows) -> DataFrame:
    """Raw rows of files (path, paper_id, content). A file that can't be read gives one row with its error."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in RAW.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one file at a time, and its rows as they come
                r = b.slice(i, 1).to_pylist()[0]
                own = {"path": r["path"], "paper_id": r["paper_id"]}
                found = []
                try:
                    for x in rows_of(r["content"]):
                        found.append(own | x)
                        if len(found) >= ROWS:
                            yield pa.RecordBatch.from_pylist(found, schema)
                            found = []
                except Exception as x:  # belongs to this file alone; rows before it stay
                    found.append(own | {"kind": "error", "error": f"{type(x).__name__}: {x}"})
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema)

    return files.select("path", "paper_id", "content").mapInArrow(run, RAW)


def page_elements(raw: DataFrame) -> dict[str, DataFrame]:
    """texts, figures, tables and formulas of raw rows, as :func:`~inkfold.operators.chunking.document_chunks` takes them."""
    spans = raw.where("kind = 'span'").select(
        "paper_id", "page_no", "block_no", F.col("item_no").alias("span_no"), F.col("block_type").alias("kind"), "text", "font", "x0", "y0", "x1", "y1"
    )
    blocks = layout.page_blocks(spans)
    pages = raw.where("kind = 'page'").select("paper_id", "page_no", "width", F.col("text").alias("raw_text"))
    place = (F.col("page_no").cast("long") * 1_000_000 + F.col("block_no")).alias("ord")
    fonts = blocks.select("paper_id", place, F.col("font_text").alias("text"), "fonts", (F.col("page_no") + 1).alias("page"), "y0", "y1")
    elements = adapters.font_block_elements(fonts)
    ordered = layout.page_texts(layout.reading_order(blocks.join(pages.select("paper_id", "page_no", "width"), layout.PAGE)))
    texts = pages.join(ordered, layout.PAGE, "left").select(*layout.PAGE, F.coalesce("text", "raw_text").alias("text"))
    images = layout.large_images(raw.where("kind = 'image'")).select(
        *layout.PAGE, F.col("block_no").alias("img_idx"), F.col("item_no").alias("rect_no"), *[F.col(c).alias(f"i{c}") for c in ("x0", "y0", "x1", "y1")]
    )
    named = blocks.drop("text").withColumnRenamed("font_text", "text")
    figures = layout.figure_captions(images, named, texts)
    number = lambda head, sep, n: F.concat(F.lit(head), F.col("page_no").cast("string"), F.lit(sep), F.col(n).cast("string"))
    tables = raw.where("kind = 'table'").where(F.length(strip(F.col("text"))) > LEAST_TABLE)
    none = F.lit(None).cast("string")
    return {
        "texts": elements.where("kind = 'text'").select("paper_id", "ord", "text", none.alias("section")),
        "figures": figures.select("paper_id", number("fig_p", "_i", "img_idx").alias("fig_id"), "caption", none.alias("image_uri")),
        "tables": tables.select("paper_id", number("tbl_p", "_t", "item_no").alias("table_id"), F.col("text").alias("markdown"), none.alias("caption")),
        "formulas": elements.where("kind = 'formula'").select("paper_id", F.col("element_id").alias("formula_id"), F.col("text").alias("latex")),
    }


def _on_file(call: Callable[[str], list[dict]]) -> Callable[[str, bytes], list[dict]]:
    """A parser of bytes from one that wants a path: the worker's own temporary file, gone afterwards."""

    def parse(name: str, content: bytes) -> list[dict]:
        with tempfile.TemporaryDirectory() as d:
            path = os.path.join(d, f"{name}.pdf")
            with open(path, "wb") as f:
                f.write(content)
            return call(path)

    return parse


def _mineru() -> Callable[[str, bytes], list[dict]]:
    from mineru.cli.client import parse_pdf

    def call(path: str) -> list[dict]:
        found = parse_pdf(path, output_dir=os.path.dirname(path), lang="en", formula_enable=True, table_enable=True)
        return [{"kind": "markdown", "element_id": "m0", "text": found.get("markdown", "") if isinstance(found, dict) else str(found)}]

    return _on_file(call)


def _docling() -> Callable[[str, bytes], list[dict]]:
    from docling.document_converter import DocumentConverter

    convert = DocumentConverter()

    def call(path: str) -> list[dict]:
        doc = convert.convert(path).document
        parts = {
            "text": [(t.text, "c") for t in doc.texts],
            "table": [(t.export_to_markdown(), "t") for t in doc.tables],
            "figure": [("", "fig") for _ in doc.pictures],
        }
        return [{"kind": kind, "element_id": f"{head}{i}", "text": text} for kind, rows in parts.items() for i, (text, head) in enumerate(rows)]

    return _on_file(call)


def _surya() -> Callable[[str, bytes], list[dict]]:
    """OCR lines and layout regions of pages drawn at twice their size. No other parser stands in for it."""
    import pypdfium2
    from surya.detection import DetectionPredictor
    from surya.layout import LayoutPredictor
    from surya.recognition import RecognitionPredictor

    find, read, place = DetectionPredictor(), RecognitionPredictor(), LayoutPredictor()

    def parse(name: str, content: bytes) -> list[dict]:
        images = [page.render(scale=2.0).to_pil() for page in pypdfium2.PdfDocument(content)]
        out = []
        for i, (lines, regions) in enumerate(zip(read(images, det_predictor=find), place(images))):
            out += [{"kind": "line", "text": x.text, "page": i + 1} for x in lines.text_lines]
            out += [{"kind": "region", "text": x.label, "page": i + 1} for x in regions.bboxes]
        return out

    return parse


def _pymupdf() -> Callable[[str, bytes], list[dict]]:
    import pymupdf

    def parse(name: str, content: bytes) -> list[dict]:
        with pymupdf.open(stream=content, filetype="pdf") as doc:
            return [{"kind": "markdown", "element_id": f"m{i}", "text": p.get_text(), "page": i + 1} for i, p in enumerate(doc)]

    return parse


register_parser("mineru", _mineru)
register_parser("docling", _docling)
register_parser("surya", _surya)
register_parser("pymupdf", _pymupdf)


def failed(raw: DataFrame) -> DataFrame:
    """path, error of the files that couldn't be read."""
    return raw.where(F.col("error").isNotNull()).select("path", "error")


def records(parsed: DataFrame) -> dict[str, tuple[DataFrame, ...]]:
    """Parsed rows of :func:`~inkfold.sources.readers.parse_documents` as the tables that the adapter of each engine takes."""
    good = parsed.where(F.col("error").isNull())

    def texts(kind: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "text")))), lambda x: x["text"])

    whole = good.where(F.col("kind") == "markdown").groupBy("paper_id").agg(F.array_join(texts("markdown"), "\n\n").alias("markdown"))
    parts = good.where(F.col("kind").isin("text", "table", "figure") & (F.col("engine") != "html")).groupBy("paper_id")
    parts = parts.agg(texts("text").alias("texts"), texts("table").alias("tables"), texts("figure").alias("pictures"))
    place = ["paper_id", (F.col("page") - 1).alias("page_idx")]
    lines = good.where(F.col("kind") == "line").select(*place, F.col("ord").alias("line_no"), "text")
    regions = good.where(F.col("kind") == "region").select(*place, F.col("ord").alias("region_no"), F.col("text").alias("label"))
    page = good.where(F.col("engine") == "html").select("paper_id", "kind", "ord", "text", "section")
    return {"mineru": (whole,), "docling": (parts,), "surya": (lines, regions), "html": (page,)}
