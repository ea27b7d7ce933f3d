"""Hash embeddings as sparse rows, cosine, and pluggable model embedders."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.modality import embedding_text

DIM = 384


class Embedder(Protocol):
    """A model: texts to unit vectors. It is built once in each Python worker."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def bucket(token: Column, dim: int = DIM) -> Column:
    """The first eight md5 bytes, little-endian and unsigned, modulo ``dim``."""
    h = F.md5(token.cast("binary"))
    half = lambda at: F.conv(F.concat(*[F.substring(h, at + 2 * i, 2) for i in (3, 2, 1, 0)]), 16, 10).cast("long")
    return ((half(1) % dim + (half(9) % dim) * ((1 << 32) % dim)) % dim).cast("int")


#: Words whose buckets a task remembers, and texts that are counted at a time.
MOST_WORDS, TEXTS = 1 << 17, 512


class Buckets(dict):
    """Buckets of words, by their first eight md5 bytes, little-endian and unsigned, modulo ``dim``. Up to ``MOST_WORDS`` are remembered."""

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        found = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little") % self.dim
        if len(self) < MOST_WORDS:
            self[word] = found
        return found

    def counts(self, texts: list[str]) -> np.ndarray:
        """How often each text, in lower case, has words of each bucket."""
        found: list[int] = []
        sizes = []
        for t in texts:
            w = t.split()
            found.extend(map(self.__getitem__, w))
            sizes.append(len(w))
        at = np.repeat(np.arange(len(texts)) * self.dim, sizes) + np.array(found, np.int64)
        return np.bincount(at, minlength=len(texts) * self.dim).reshape(-1, self.dim)

    def vectors(self, texts: list[str]) -> np.ndarray:
        """Unit vectors of the counts, in single precision; zeros for a text without words."""
        out = np.zeros((len(texts), self.dim), np.float32)
        for i in range(0, len(texts), TEXTS):
            n = self.counts(texts[i : i + TEXTS])
            norm = np.sqrt((n * n).sum(1, keepdims=True))
            out[i : i + TEXTS] = np.divide(n, norm, out=np.zeros(n.shape), where=norm > 0)
        return out


def hash_vector(text: Column, dim: int = DIM) -> Column:
    """array<struct<bucket, weight>>: the non-zero components of a text's unit vector of token counts; NULL for NULL."""

    def weighted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Buckets(dim)
        for texts in batches:
            parts = []
            for i in range(0, max(len(texts), 1), TEXTS):
                part = texts.slice(i, TEXTS)
                x = known.vectors(part.fill_null("").to_pylist())
                row, at = np.nonzero(x)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))]).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(x[row, at])], ["bucket", "weight"])
                parts.append(pa.ListArray.from_arrays(pa.array(offsets), values, mask=part.is_null()))
            yield pa.concat_arrays(parts)

    return F.arrow_udf(weighted, "array<struct<bucket:int,weight:float>>")(F.lower(text))


def hash_vectors(texts: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """key, bucket, weight: the non-zero components of each text's unit vector. Texts without tokens have no rows, and
    nothing is shuffled."""
    return texts.select(key, F.inline(hash_vector(F.col(text), dim)))


def dense(vectors: DataFrame, key: str, keys: DataFrame, dim: int = DIM) -> DataFrame:
    """key, embedding array<float> of ``keys`` from sparse rows; zeros where a key has none."""
    pairs = F.map_from_entries(F.collect_list(F.struct("bucket", "weight")))
    grouped = vectors.groupBy(key).agg(pairs.alias("_m"))
    at = lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0).cast("float"))
    return keys.select(key).join(grouped, key, "left").select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), at).alias("embedding"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one has length 0."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def embed_chunks(
    chunks: DataFrame, build: Callable[[], Embedder], batch: int = 8, clean_tables: bool = False, workers: int | None = None, resources: ResourceProfile | None = None
) -> DataFrame:
    """``chunks`` with embedding array<float> of the text that its modality is embedded with.

    ``workers`` bounds how many tasks run the model at a time, and ``resources`` tells what each needs (a GPU, say).
    """
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build()
        for f in frames:
            vectors = [v.astype("float32").tolist() for i in range(0, len(f), batch) for v in model(f["_text"].iloc[i : i + batch].tolist())]
            yield f.drop(columns="_text").assign(embedding=vectors)

    texts = chunks.withColumn("_text", embedding_text(F.col("modality"), F.col("content"), clean_tables))
    return (texts.repartition(workers) if workers else texts).mapInPandas(run, schema, profile=resources)


def hash_embedder(dim: int = DIM) -> Embedder:
    """The same vectors as :func:`hash_vectors`, for texts in a worker."""

    known = Buckets(dim)

    def embed(texts: list[str]) -> np.ndarray:
        return known.vectors([t.lower() for t in texts])

    return embed


def model_or_hash(name: str) -> Callable[[], Embedder]:
    """Builds a sentence model once in each worker; where that fails, hash embeddings stand in."""

    def build() -> Embedder:
        try:
            from sentence_transformers import SentenceTransformer

            model = SentenceTransformer(name)
            return lambda texts: np.asarray(model.encode(texts, normalize_embeddings=True), np.float32)
        except Exception:  # no library, no weights or no network
            return hash_embedder()

    return build


def vector_report(vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: count, dimensions and norms of ``embedding``, rounded to 6 digits."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.select(F.size("embedding").alias("d"), norm.alias("n")).agg(
        F.count(F.lit(1)).alias("n_vectors"), F.min("d").alias("min_dim"), F.max("d").alias("max_dim"),
        F.round(F.min("n"), 6).alias("min_norm"), F.round(F.max("n"), 6).alias("max_norm"), F.round(F.avg("n"), 6).alias("avg_norm"),
    )


# Pairs of texts for a look at a model; the first and third should be near, the others far.
PAIRS = [
    ("dose-response relationship", "dosage effect"),
    ("dose-response relationship", "quantum entanglement"),
    ("machine learning model", "neural network"),
    ("machine learning model", "chocolate cake recipe"),
]


def pair_similarities(spark: SparkSession, build: Callable[[], Embedder], pairs: list[tuple[str, str]] | DataFrame = PAIRS) -> DataFrame:
    """a, b, dtype, similarity (dot product) of pairs of texts (a, b) under a model."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build()
        for f in frames:
            for i in range(0, len(f), TEXTS):  # vectors of few pairs at a time
                part = f.iloc[i : i + TEXTS]
                x, y = model(part["a"].tolist()), model(part["b"].tolist())
                yield part.assign(dtype=str(x.dtype), similarity=(x.astype("float64") * y.astype("float64")).sum(1))

    rows = pairs if isinstance(pairs, DataFrame) else spark.createDataFrame(pairs, "a string, b string")
    return rows.select("a", "b").mapInPandas(run, "a string, b string, dtype string, similarity double")
