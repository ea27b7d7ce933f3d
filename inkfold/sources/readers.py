"""Sources: document files, caches, evaluation cases, chunk corpora, listings."""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import strip

CASE = "question string, gold_source_ids array<string>, answerable boolean, modality string, notes string"
ELEMENT = (
    "path string, paper_id string, engine string, kind string, ord int, element_id string, text string, section string, page int, error string"
)
# The three demonstration cases.
DEMO_CASES = [
    ("What is the main finding of this paper?", [], True),
    ("What method was used in the experiments?", [], True),
    ("Which antibiotic prevents neonatal infection?", [], False),
]


def document_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, paper_id (the file's stem), length, modificationTime, content. Order by path where order matters."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("paper_id"), "length", "modificationTime", "content"
    )


class Parser(Protocol):
    """A parser: the bytes of a document to elements (dicts with kind, element_id, text, section, page)."""

    def __call__(self, name: str, content: bytes) -> Iterable[dict]: ...


#: Builders of parsers by name; one parser is built in each Python worker.
PARSERS: dict[str, Callable[[], Parser]] = {}
#: What stands in for a parser that fails; a scan parser has no stand-in.
FALLBACK = {"mineru": "docling", "docling": "pymupdf", "html": "utf8"}


def register_parser(name: str, build: Callable[[], Parser]) -> None:
    PARSERS[name] = build


def _utf8() -> Parser:
    return lambda name, content: [{"kind": "markdown", "element_id": "m0", "text": content.decode("utf-8")}]


register_parser("utf8", _utf8)


#: Elements that a worker holds before it hands them on, and those of one more file.
ELEMENTS = 2000


def parse_documents(files: DataFrame, parser: str | None = None, builders: dict[str, Callable[[], Parser]] | None = None) -> DataFrame:
    """Elements of files (path, paper_id, content and, without ``parser``, a column parser), with the engine that served.

    ``builders`` stand before the registered ones. Each parser is built once in a worker. A failing parser hands over to its stand-in; a document that none can read gives one row with its error, and no
    other document suffers.
    """
    registry, fallback = PARSERS | (builders or {}), dict(FALLBACK)
    rows = files.select("path", "paper_id", "content", (F.lit(parser) if parser else F.col("parser")).alias("parser"))

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        def table(out: list[tuple]) -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in ELEMENT.split(", ")])
            return frame.astype({"ord": "Int32", "page": "Int32"})

        built: dict[str, Parser] = {}
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if len(out) >= ELEMENTS:  # elements are handed on as they come, not a batch of files at once
                    yield table(out)
                    out = []
                name, errors = r.parser, []
                while name:
                    try:
                        if name not in built:
                            built[name] = registry[name]()
                        found = list(built[name](r.paper_id, bytes(r.content)))  # whole before any of it counts
                        for i, e in enumerate(found):
                            out.append((r.path, r.paper_id, name, e.get("kind"), i, e.get("element_id"), e.get("text"), e.get("section"), e.get("page"), None))
                        break
                    except Exception as x:  # any parser failure belongs to this document alone
                        errors.append(f"{name}: {type(x).__name__}: {x}")
                        name = fallback.get(name)
                else:
                    out.append((r.path, r.paper_id, None, None, None, None, None, None, None, "; ".join(errors)))
            yield table(out)

    return rows.mapInPandas(run, ELEMENT)


def new_files(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files that the cache doesn't hold in this path, length and modification time."""
    return files.join(cached.select("path", "length", "modificationTime").distinct(), ["path", "length", "modificationTime"], "left_anti")


def cache_is_current(files: DataFrame, cached: DataFrame, by_count: bool = False) -> bool:
    """Whether a cache can be used as it is; ``by_count`` compares the number of files only."""
    if by_count:
        return files.count() == cached.select("path").distinct().count()
    return new_files(files, cached).isEmpty() and new_files(cached, files).isEmpty()


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines; blank lines and lines that start with ``#`` are skipped."""
    line = strip(F.col("value"))
    return (
        spark.read.text(path).where((line != "") & ~F.startswith(line, F.lit("#"))).select(F.from_json(line, CASE).alias("c")).select("c.*")
    )


def demo_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEMO_CASES, "question string, gold_source_ids array<string>, answerable boolean")


def chunk_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A stored corpus; a missing one is an error when it is read."""
    return spark.read.parquet(path)


def load_env(path: str) -> dict[str, str]:
    """k=v lines into the environment where it has no such key yet; returns what was set."""
    done: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for raw in f:
                line = raw.strip()
                if line and not line.startswith("#") and "=" in line:
                    k, v = (x.strip() for x in line.split("=", 1))
                    if k not in os.environ:
                        os.environ[k] = done[k] = v.strip("\"'")
    return done


def listing_query(categories: list[str] | None = None, words: str | None = None) -> str:
    """The search expression of a paper listing: any of the categories, and all words; one fixed category without either."""
    parts = ["(" + " OR ".join(f"cat:{c}" for c in categories) + ")"] if categories else []
    parts += [f'all:"{words}"'] if words else []
    return " AND ".join(parts) or "cat:cs.CL"


class _Page(InputPartition):
    def __init__(self, entries: list[tuple]):
        self.entries = entries


def _atom_page(url: str, search: str, start: int, n: int) -> list[tuple]:
    """One page of a listing service that answers in Atom, newest first."""
    ask = {"search_query": search, "start": start, "max_results": n, "sortBy": "submittedDate", "sortOrder": "descending"}
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(ask)}", timeout=60) as r:
        root = ElementTree.fromstring(r.read())
    atom = "{http://www.w3.org/2005/Atom}"
    text = lambda e, tag: (e.findtext(atom + tag) or "").strip()
    return [(text(e, "id").rsplit("/", 1)[-1], text(e, "title"), text(e, "published")) for e in root.iter(atom + "entry")]


class _ListingReader(DataSourceReader):
    PAGE = 100

    def __init__(self, options: dict):
        self.options, self.most = dict(options), int(options.get("max", 100))

    def _pages(self) -> Iterator[list[tuple]]:
        if "url" not in self.options:
            with open(self.options["path"], encoding="utf-8") as f:
                entries = [(e["id"], e.get("title", ""), e["submitted"]) for e in json.load(f)]
            entries.sort(key=lambda e: (e[2], e[0]), reverse=True)
            yield from (entries[i : i + self.PAGE] for i in range(0, len(entries), self.PAGE))
            return
        search = self.options.get("query") or listing_query()
        for start in range(0, self.most, self.PAGE):
            if start:
                time.sleep(float(self.options.get("pause", 3)))
            found = _atom_page(self.options["url"], search, start, min(self.PAGE, self.most - start))
            if not found:
                return
            yield found

    def partitions(self) -> list[InputPartition]:
        """Pages are asked for one after the other, as services want it, by the driver; there are ``max`` entries at most."""
        out, n = [], 0
        for page in self._pages():
            out.append(_Page(page[: self.most - n]))
            n += len(page)
            if n >= self.most:
                break
        return out or [_Page([])]

    def read(self, partition: _Page) -> Iterator[tuple]:
        yield from partition.entries


class PaperListing(DataSource):
    """``spark.read.format("paper_listing")``: ids of papers, newest first, page by page up to ``max`` or an empty page.

    Options: ``url`` of a service that answers in Atom with ``query`` and ``pause`` (seconds between pages), or ``path`` of a
    JSON file with the entries.
    """

    @classmethod
    def name(cls) -> str:
        return "paper_listing"

    def schema(self) -> str:
        return "id string, title string, submitted string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ListingReader(self.options)


def base_id(paper: Column) -> Column:
    """A listing's id without its version: what stands before the first ``v``."""
    return F.substring_index(paper, "v", 1)
