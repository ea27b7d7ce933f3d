"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are pairs of neighbouring byte classes of the whole text (``CLASSES`` squared),
weighted by the square root of their share and by inverse document frequency, and
projected on the ``RANK`` leading singular vectors of the labelled texts. Seven
standardised figures on repetition and shape (share of words that repeat the word
before, of repeated lines, of capitals, ...) stand beside the latent coordinates with
weight ``SHAPE``. Labelled vectors are broadcast; every document's cosines with all
of them are computed in blocks, and the ``NEIGHBOURS`` nearest vote with weights
similarity to the power ``SHARPNESS`` (ties with the last neighbour vote too).

Fitting uses a bounded sample of labelled rows: at most ``SAMPLE`` of each label, in
the order of a hash of doc_id, among those whose crc32(doc_id as text) mod 3 is not
1. That bounds what reaches the driver and what is broadcast. The labels, lang,
source and doc_id are no inputs of a score.

Defined results: a null text counts as empty and gets the score its shape figures
give; with no usable label at all every score is 0.5, with one label only, that
label; a labelled doc_id with several rows counts once, with its lowest label;
repeated rows are scored alike; a null doc_id is not held out; a very long text is counted
in parts, whole; an empty table gives an empty result; extra columns of any name are ignored by
:func:`quality_scores` and pass through :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, slices

SAMPLE = 1024
CLASSES = 64
RANK = 64
SHAPE = 0.2
NEIGHBOURS = 15
SHARPNESS = 8
BLOCK = 256
#: Bytes of a text that are counted at a time.
PART = 1 << 20


def _byte_classes() -> np.ndarray:
    cls = np.zeros(256, np.int64)
    for b in range(256):
        if 97 <= b <= 122:
            cls[b] = 1 + b - 97
        elif 65 <= b <= 90:
            cls[b] = 27
        elif 48 <= b <= 57:
            cls[b] = 28
        elif b == 32:
            cls[b] = 29
        elif b in (10, 13):
            cls[b] = 30
        elif b >= 128:
            cls[b] = 31 + b % 8
        else:
            cls[b] = 39 + b % 20
    return cls


_classes = _byte_classes()


def terms(text: str) -> np.ndarray:
    """Square roots of the shares of byte-class pairs: a vector of length 1, or 0."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    v = np.zeros(CLASSES * CLASSES, np.int64)
    for i in range(0, len(b) - 1, PART):  # parts share a byte, so that every pair counts once
        c = _classes[b[i : i + PART + 1]]
        v += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
    return np.sqrt(v / max(1, len(b) - 1)).astype(np.float32)


def shape(text: str) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * 7
    n, distinct = len(words), len(set(words))
    lines = [x for x in text.split("\n") if x]
    return [
        sum(map(str.__eq__, words[1:], words[:-1])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(2.0, distinct / n**0.75),
        min(1.0, np.log1p(n) / 10),
        sum(map(str.isupper, words)) / n,
        min(3.0, len(text) / n / 6),
        distinct / n,
    ]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def leading(g: np.ndarray, k: int, spare: int = 64, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` leading eigenvalues and eigenvectors of a positive matrix, by subspace iteration in little memory."""
    if len(g) <= 2 * (k + spare):
        w, u = np.linalg.eigh(g)
    else:
        q = np.random.default_rng(3).standard_normal((len(g), k + spare)).astype(g.dtype)
        for _ in range(rounds):
            q = np.linalg.qr(g @ q)[0]
        w, u = np.linalg.eigh(q.T @ g @ q)
        u = q @ u
    return w[::-1][:k], u[:, ::-1][:, :k]


class Voter:
    """Labelled vectors and the projection; small enough to broadcast."""

    def __init__(self, t: np.ndarray, s: np.ndarray, labels: np.ndarray):
        """``t`` is used up: it is weighted in place, as it is the largest thing on the driver."""
        self.labels = labels.astype(np.float32)
        self.idf = (np.log((1 + len(t)) / (1 + (t > 0).sum(0))) + 1).astype(np.float32)
        self.mean, self.std = s.mean(0), s.std(0) + 1e-6
        t *= self.idf
        t /= np.maximum(np.sqrt(np.einsum("ij,ij->i", t, t))[:, None], 1e-9)
        # the leading right singular vectors, from the smaller Gram matrix
        if len(t) <= t.shape[1]:
            w, u = leading(t @ t.T, RANK)
            self.axes = (t.T @ u) / np.sqrt(np.maximum(w, 1e-9))
        else:
            self.axes = leading(t.T @ t, RANK)[1]
        self.axes = self.axes.astype(np.float32)
        self.vectors = self._beside(t @ self.axes, s)

    def _beside(self, latent: np.ndarray, s: np.ndarray) -> np.ndarray:
        return _unit(np.hstack([_unit(latent), SHAPE * np.clip((s - self.mean) / self.std, -4, 4)])).astype(np.float32)

    def place(self, t: np.ndarray, s: np.ndarray) -> np.ndarray:
        return self._beside(_unit(t * self.idf) @ self.axes, s)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(texts), BLOCK):
            part = texts[i : i + BLOCK]
            c = self.place(np.array([terms(x) for x in part]), np.array([shape(x) for x in part])) @ self.vectors.T
            last = np.partition(c, -k, axis=1)[:, -k][:, None]
            w = np.where(c >= last, np.maximum(c, 1e-6) ** SHARPNESS, 0).astype(np.float64)
            out[i : i + BLOCK] = (w @ self.labels) / w.sum(1)
        return np.round(np.clip(out, 0, 1), 6)


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 3 is 1; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Voter | float:
    """A :class:`Voter`, or the score of every document where the labels leave nothing to learn."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_y"))
        .where("doc_id is not null and _y in (0, 1)")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.min("_y").alias("_y"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("_y = 0").orderBy(*order).limit(sample).union(known.where("_y = 1").orderBy(*order).limit(sample))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("_y"),
                    pa.array([terms(x).astype(np.float16).tobytes() for x in texts], pa.binary()),
                    pa.array([shape(x) for x in texts], pa.list_(pa.float64())),
                ],
                ["doc_id", "y", "t", "s"],
            )

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most 2 * sample rows
        .mapInArrow(vectors, "doc_id long, y int, t binary, s array<double>")
        .collect()
    )
    rows = sorted({r.doc_id: r for r in sorted(rows, key=lambda r: (r.doc_id, bytes(r.t)))}.values(), key=lambda r: r.doc_id)
    if len({r.y for r in rows}) < 2:
        return float(rows[0].y) if rows else 0.5
    t = np.empty((len(rows), CLASSES * CLASSES), np.float32)
    for i, r in enumerate(rows):
        t[i] = np.frombuffer(r.t, np.float16)
    s, y = np.array([r.s for r in rows]), np.array([r.y for r in rows])
    del rows
    return Voter(t, s, y)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """_row (all columns of ``docs`` as one struct), _score and _predicted for every row of ``docs`` (doc_id, text, ...).

    Only texts go to the workers, and only scores come back.
    """
    model = fit(docs, labels, sample)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    if isinstance(model, float):
        scored = rows.withColumn("_score", F.lit(model))
    else:
        held = docs.sparkSession.sparkContext.broadcast(model)

        @F.arrow_udf("double")
        def score(text: pa.Array) -> pa.Array:
            parts = [held.value.scores(text.slice(i, TEXT_ROWS).to_pylist()) for i in range(0, len(text), TEXT_ROWS)]
            return pa.array(np.concatenate(parts) if parts else [], pa.float64())

        # said to vary, so that a filter on it isn't moved below the exchange that deals few files to all cores
        scored = rows.withColumn("_score", score.asNondeterministic()(F.coalesce("_row.text", F.lit(""))))
    return scored.withColumn("_predicted", (F.col("_score") >= 0.5).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    return score_quality(docs.select("doc_id", "text"), labels, sample).select(
        F.col("_row.doc_id").cast("long").alias("doc_id"), held_out("_row.doc_id").alias("held_out"),
        F.col("_score").alias("score"), F.col("_predicted").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` predicted to be of label 1, with their own columns."""
    return score_quality(docs, labels, sample).where("_predicted = 1").select("_row.*")
