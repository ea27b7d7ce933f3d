"""Command line: ``python -m inkfold --store DIR [--docs DIR] [--parser NAME] [--query TEXT] [--cases FILE] [--run-all] [--reset]``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .plans.app import Store
from .sources import readers, writers


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="inkfold", description="Ingest documents, ask questions, evaluate answers.")
    p.add_argument("--store", required=True, help="folder of the tables")
    p.add_argument("--docs", "--pdf-dir", dest="docs", help="folder of documents to ingest")
    p.add_argument("--pattern", default="*.pdf")
    p.add_argument("--parser", help="a registered parser; without one, pages are extracted and laid out")
    p.add_argument("--generator", default="extractive")
    p.add_argument("--query", help="a question")
    p.add_argument("--cases", help="JSON lines of evaluation cases; the demonstration cases without it")
    p.add_argument("--run-all", action="store_true", help="ingest, index, evaluate")
    p.add_argument("--reset", action="store_true", help="ingest and index again")
    a = p.parse_args(args)
    readers.load_env(".env")
    running = SparkSession.getActiveSession()
    spark = running or SparkSession.builder.appName("inkfold").getOrCreate()
    try:
        return _run(spark, a)
    finally:
        if not running:
            spark.stop()


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    store = Store(spark, os.path.abspath(a.store) if "://" not in a.store else a.store)
    if a.docs and (a.run_all or a.reset or not a.query):
        files = readers.document_files(spark, a.docs, a.pattern)
        try:
            current = not a.reset and readers.cache_is_current(files, store.read("files"))
        except Exception as x:  # no store yet
            if "PATH_NOT_FOUND" not in str(x):
                raise
            current = False
        if not current:
            store.ingest(a.docs, a.parser, a.pattern)
            store.index()
    if a.query:
        asked = spark.createDataFrame([(0, a.query)], "query_id long, question string")
        r = store.ask(asked, a.generator).first()
        print(f"{r.status}: {r.answer}")
        for c in r.citations:
            print(f"  [{c.source_id}] {c.score:.3f}")
    if a.run_all or a.cases:
        cases = readers.cases(spark, a.cases) if a.cases else readers.demo_cases(spark)
        results, summary, _ = store.evaluate(cases, a.generator)
        print(writers.console_report(results, summary))
    return 0


if __name__ == "__main__":
    sys.exit(main())
