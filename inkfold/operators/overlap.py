"""Parsing and embedding in one task at the same time: while a batch of texts is embedded, the next files are parsed."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator
from typing import Any, TypeVar

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame

from ..sources import readers
from .embedding import Embedder

T = TypeVar("T")
#: Parsed batches that wait for the embedder, at most.
DEPTH = 2
ROWS = "paper_id string, engine string, kind string, ord int, text string, section string, error string, embedding array<float>"


def ahead(items: Iterator[T], depth: int = DEPTH) -> Iterator[T]:
    """The same items in the same order, made by a thread that is at most ``depth`` ahead. An error of the source comes where it belongs,
    and the thread ends when nobody reads on."""
    held: queue.Queue = queue.Queue(depth)
    stop = threading.Event()

    def give(kind: str, value: Any) -> bool:
        while not stop.is_set():
            try:
                held.put((kind, value), timeout=0.1)
                return True
            except queue.Full:
                continue
        return False

    def work() -> None:
        try:
            for x in items:
                if not give("item", x):
                    return
            give("end", None)
        except BaseException as e:  # handed to the reader
            give("error", e)

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    try:
        while True:
            kind, value = held.get()
            if kind == "end":
                return
            if kind == "error":
                raise value
            yield value
    finally:
        stop.set()
        thread.join()


def parse_and_embed(
    files: DataFrame, parser: str, embedder: Callable[[], Embedder], batch: int = 32, depth: int = DEPTH, profile: ResourceProfile | None = None
) -> DataFrame:
    """Elements of files (paper_id, content) with the vectors of their texts; ``depth`` 0 does one after the other.

    A file that can't be read gives one row with its error and no vector, and an element without text has none. Files are parsed one at a time, texts embedded
    ``batch`` at a time, so a task holds ``depth`` + 1 batches. ``profile`` asks for the resources of the stage, such as a GPU for each task.
    """
    registry = dict(readers.PARSERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse, model = registry[parser](), embedder()
        names = [c.split()[0] for c in ROWS.split(", ")][:-1]

        def elements() -> Iterator[tuple]:
            for b in batches:
                for i in range(b.num_rows):
                    r = b.slice(i, 1).to_pylist()[0]
                    try:
                        found = list(parse(r["paper_id"], r["content"]))
                    except Exception as x:  # belongs to this file alone
                        yield r["paper_id"], None, None, None, None, None, f"{type(x).__name__}: {x}"
                        continue
                    for n, e in enumerate(found):
                        yield r["paper_id"], parser, e.get("kind"), n, e.get("text"), e.get("section"), None

        def groups() -> Iterator[list[tuple]]:
            held: list[tuple] = []
            for e in elements():
                held.append(e)
                if len(held) == batch:
                    yield held
                    held = []
            if held:
                yield held

        for rows in ahead(groups(), depth) if depth else groups():
            some = [i for i, r in enumerate(rows) if r[4]]
            vectors: list = [None] * len(rows)
            for i, v in zip(some, model([rows[i][4] for i in some]) if some else ()):
                vectors[i] = v.tolist()
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(vectors, pa.list_(pa.float32()))], [*names, "embedding"])

    return files.select("paper_id", "content").mapInArrow(run, ROWS, profile=profile)
