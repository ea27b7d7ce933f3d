"""The whole way from a folder of documents to answers and their evaluation, over tables in one store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.modality import embedding_text
from ..operators import adapters, answer, chunking, evaluate, quality, retrieval
from ..sources import parsers, readers, remote, tables  # noqa: F401  remote registers the chat generators


@dataclass
class Store:
    """Folders of Parquet tables: files, chunks, index."""

    spark: SparkSession
    path: str

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def ingest(self, folder: str, parser: str | None = None, pattern: str = "*.pdf") -> DataFrame:
        """Reads the folder into chunks. Without ``parser``, pages are extracted and laid out; with one, its elements are used."""
        files = readers.document_files(self.spark, folder, pattern)
        if parser is None:
            chunks = chunking.document_chunks(**parsers.page_elements(parsers.extract_pages(files)))
        else:
            # written, as the rows of each engine go their own way and a document is parsed once
            found = tables.stored(readers.parse_documents(files, parser), "parsed")
            e = adapters.adapt(parsers.records(found))
            of = lambda kind, *cols: e.where(F.col("kind") == kind).select("paper_id", *cols)
            none, text = F.lit(None).cast("string"), F.col("text")
            chunks = chunking.document_chunks(
                e.where("kind is null or kind = 'text'").select("paper_id", "ord", "text", "section"),
                of("figure", F.col("element_id").alias("fig_id"), text.alias("caption"), none.alias("image_uri")),
                of("table", F.col("element_id").alias("table_id"), text.alias("markdown"), none.alias("caption")),
                of("formula", F.col("element_id").alias("formula_id"), text.alias("latex")),
            )
        # the order of the corpus is the order of ids: a range partition numbers it without a window over all rows
        n = F.regexp_extract("chunk_id", r"([0-9]+)$", 1).cast("long")
        placed = chunks.withColumn("_n", n).repartitionByRange("paper_id", "modality", "_n", "chunk_id")
        placed = placed.sortWithinPartitions("paper_id", "modality", "_n", "chunk_id").withColumn("ord", F.monotonically_increasing_id())
        self._write(placed.drop("_n"), "chunks")
        self._write(files.drop("content"), "files")
        return self.read("chunks")

    def index(self) -> retrieval.SparseIndex:
        built = retrieval.build_sparse(self.read("chunks"))
        built.write(f"{self.path}/index", 8)
        return retrieval.SparseIndex.read(self.spark, f"{self.path}/index")

    def ask(self, questions: DataFrame, generator: str = "extractive", k: int = 10, dense: retrieval.Searcher | None = None) -> DataFrame:
        """Answers to (query_id, question), all by one plan."""
        return answer.answer_questions(questions, self.search(questions, k, dense), generator)

    def search(self, questions: DataFrame, k: int = 10, dense: retrieval.Searcher | None = None) -> DataFrame:
        """Hybrid search; ``dense`` takes the place of the hash embeddings (hits: query_id, chunk_id, ord, rank)."""
        chunks = self.read("chunks")
        index = retrieval.SparseIndex.read(self.spark, f"{self.path}/index")
        if dense is None:
            texts = chunks.select("chunk_id", "ord", embedding_text(F.col("modality"), F.col("content")).alias("content"))
            near = retrieval.search_hashed(texts, questions, k)
        else:
            near = dense(questions, k)
        fused = retrieval.fuse(near, retrieval.search_sparse(index, questions, k), k)
        return fused.join(chunks.select("chunk_id", "content"), "chunk_id")

    def evaluate(self, cases: DataFrame, generator: str = "extractive", k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Results, means and tally of cases (question, gold_source_ids, answerable)."""
        numbered = cases.select(
            F.xxhash64("question").alias("query_id"), "question", "answerable", F.coalesce("gold_source_ids", F.array().cast("array<string>")).alias("gold")
        )
        results = evaluate.evaluate(numbered, self.search(numbered, k), self.ask(numbered, generator), k)
        return results, evaluate.summary(results), evaluate.refusal_tally(results)

    def report(self) -> DataFrame:
        return quality.report(self.read("chunks").select("chunk_id", "content"))
