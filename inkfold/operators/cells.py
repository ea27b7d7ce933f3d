"""An inverted file: vectors in the cells of a coarse quantizer, so that a search reads only the cells next to its queries.

Centroids come from k-means on a bounded sample, by matrix products. Every vector goes to the cell of its nearest centroid, and the table is
written by cell, so a search that asks a few cells prunes the others before it reads. Inside the cells the search is exact. How many cells a
query has to ask depends on the vectors: :meth:`CellIndex.probes_for` measures it for a wished recall, against an exact search of sample queries.

Defined results: a null vector is left out, and so are vectors of another width than the centroids; a zero vector is in cell 0 and has score 0;
equal scores go by key; an empty table gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .retrieval import nearest, packed, search_vectors, top

#: Most vectors that centroids are fitted on, the rounds of k-means, and products that are held at a time.
SAMPLE, ROUNDS, AT_ONCE = 16_384, 6, 4096


def _unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def closest(x: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centroids of each row, nearest first; equal ones by their number."""
    out = np.empty((len(x), n), np.int64)
    for i in range(0, len(x), AT_ONCE):
        s = np.round(x[i : i + AT_ONCE] @ centroids.T, 9)
        out[i : i + AT_ONCE] = np.argsort(-s, axis=1, kind="stable")[:, :n]
    return out


def k_means(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows; the first n rows begin, and a cell that is left empty keeps its centroid."""
    centroids = x[:n].copy()
    for _ in range(rounds):
        cell = closest(x, centroids)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        some = np.linalg.norm(sums, axis=1) > 0
        centroids[some] = _unit_rows(sums[some])
    return centroids


def train(vectors: DataFrame, n_cells: int, key: str = "vec_id", sample: int = SAMPLE) -> np.ndarray:
    """Centroids from the ``sample`` vectors with the smallest hash of their key: a sample that doesn't depend on how the table lies."""
    usable = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    rows = usable.orderBy(F.md5(F.col(key).cast("string")), key).limit(sample).select("embedding").toArrow()
    found = [np.asarray(v, float) for v in rows.column("embedding").to_pylist()]
    width = max(map(len, found), default=1)
    x = _unit_rows(np.stack([v for v in found if len(v) == width])) if found else np.zeros((0, 1))
    x = x[np.isfinite(x).all(1) & x.any(1)]
    return k_means(x, min(n_cells, len(x)))


def _with_cells(rows: DataFrame, key: str, centroids: np.ndarray, n: int, place: str | None = None) -> DataFrame:
    """``key``, embedding and cell for each of the n nearest cells of a row, with its place among them if asked."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("embedding").to_pylist()
            at = [i for i, v in enumerate(vectors) if v is not None and len(v) == centroids.shape[1]]
            if not at or not len(centroids):
                continue
            x = np.nan_to_num(_unit_rows(np.array([vectors[i] for i in at], float)))
            cells = closest(x, centroids, n)
            take = pa.array(np.repeat(at, n))
            cols = [b.column(key).take(take), b.column("embedding").take(take), pa.array(cells.ravel())]
            names = [key, "embedding", "cell"]
            if place:
                cols, names = [*cols, pa.array(np.tile(np.arange(1, n + 1), len(at)))], [*names, place]
            yield pa.RecordBatch.from_arrays(cols, names)

    own = rows.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.mapInArrow(find, f"{key} long, embedding array<double>, cell long" + (f", {place} long" if place else ""))


@dataclass
class CellIndex:
    """vectors (key, embedding, cell), written by cell, and the centroids."""

    vectors: DataFrame
    centroids: np.ndarray
    key: str = "vec_id"

    @classmethod
    def write(cls, vectors: DataFrame, path: str, n_cells: int, key: str = "vec_id", sample: int = SAMPLE, files: int = 16) -> CellIndex:
        """Fits the cells and writes every vector to its own; a cell of very many vectors goes to several files."""
        spark, centroids = vectors.sparkSession, train(vectors, n_cells, key, sample)
        placed = _with_cells(vectors, key, centroids, 1)
        placed.repartitionByRange(files, "cell", key).sortWithinPartitions("cell", key).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        named = [(i, c.tolist()) for i, c in enumerate(centroids)]
        spark.createDataFrame(named, "cell long, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
        return cls.read(spark, path, key)

    @classmethod
    def read(cls, spark: SparkSession, path: str, key: str = "vec_id") -> CellIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow().column("centroid").to_pylist()
        vectors = spark.read.schema(f"{key} long, embedding array<double>, cell long").parquet(f"{path}/vectors")
        return cls(vectors, np.array(rows, float) if rows else np.zeros((0, 1)), key)

    def probed(self, queries: DataFrame, n_probe: int) -> DataFrame:
        """query_id, embedding, cell, place: the cells that each query asks, nearest first."""
        return _with_cells(queries, "query_id", self.centroids, min(n_probe, len(self.centroids)), "place")

    def read_for(self, asked: DataFrame) -> DataFrame:
        """The vectors of the cells that are asked; their numbers (at most the number of cells) prune the folders that are read."""
        cells = sorted(r["cell"] for r in asked.select("cell").distinct().collect())
        return self.vectors.where(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, n_probe: int, k: int = 10) -> DataFrame:
        """query_id, key, score, rank: the k best of each query (query_id, embedding) in its ``n_probe`` nearest cells."""
        asked = stored(self.probed(queries, n_probe), "probed-cells")
        blocks = packed(self.read_for(asked), self.key, "embedding", cell="cell")
        found = nearest(blocks, packed(asked, "query_id", "embedding", cell="cell"), k, self.key, unit=True, by_cell=True)
        return top(found, k, self.key)

    def probes_for(self, queries: DataFrame, recall: float = 0.95, k: int = 10) -> int:
        """The fewest cells to ask so that these sample queries find so much of their exact k best."""
        every = stored(self.probed(queries, len(self.centroids)).select("query_id", "cell", "place"), "probe-places")
        exact = search_vectors(self.vectors, queries, k, self.key).select("query_id", self.key)
        at = exact.join(self.vectors.select(self.key, "cell"), self.key).join(every, ["query_id", "cell"])
        counts = at.groupBy("place").agg(F.count(F.lit(1)).alias("n"))  # a row for each cell at most
        sums = counts.select("place", (F.sum("n").over(Window.orderBy("place")) / F.sum("n").over(Window.partitionBy())).alias("found"))
        reached = sums.where(F.col("found") >= recall).agg(F.min("place")).first()[0]
        return int(reached or max(1, len(self.centroids)))
