"""Token counts of whole texts under a public byte-level BPE vocabulary.

Arrow batches are regrouped so that the encoders get about ``BATCH_BYTES`` of
UTF-8 at a time, and a text longer than ``SPLIT_CHARS`` is cut where the
vocabulary's splitting pattern always starts a new piece: between a character that is
no white space and a blank or line feed, and between a Han, kana or Hangul letter and a
full-width mark. No alternative of the pattern reaches over such a place, none looks
behind, and the special string holds no such place. Only lengths leave the function.
A text without any such place in it is one piece, as it is for the vocabulary.

Two encoders of the same vocabulary are used. Texts made only of the characters in
``PLAIN`` go to tiktoken; a text with any other character, or with the vocabulary's
special string, goes to tokenizers itself, whose tables of Unicode classes and
handling of special strings then apply. Tests hold one against the other, and cut
texts against whole ones.

Defined results: null counts as empty (0 bytes, 0 tokens, not over the limit); an
empty table gives an empty result; repeated rows are counted each; other columns of
any name are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

VOCABULARY = "byte_bpe_50k"
BATCH_BYTES = 1 << 20
SPLIT_CHARS = 1 << 16
LIMIT = 1024
#: ASCII and the Latin letters that both libraries class alike.
PLAIN = "\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ſ"

_odd = re.compile(f"[^{PLAIN}]|<\\|")
_safe = re.compile(
    r"[^\s\u180e](?=[ \n])|[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3](?=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])"
)
_uniform = re.compile(r"[A-Za-z]{1000}|[0-9]{1000}|\s{1000}|[^\sA-Za-z0-9]{1000}")


@lru_cache(maxsize=2)
def fast_encoder(vocabulary: str = VOCABULARY):
    """The tiktoken encoding of a vocabulary; loaded once per process."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def full_encoder(vocabulary: str = VOCABULARY):
    """The tokenizers tokenizer of a vocabulary; loaded once per process, and only if a text needs it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


def _plain(text: str) -> bool:
    """Whether tiktoken takes the text: no odd character, and no run of 2000 letters, digits, blanks or marks, which take it
    time that grows with their square; such a run holds a whole one of the stretches that are looked at."""
    return not _odd.search(text) and not any(_uniform.match(text, i) for i in range(0, len(text) - 999, 1000))


def pieces(text: str, size: int = SPLIT_CHARS) -> list[str]:
    """``text`` cut at safe boundaries, each part about ``size`` characters long."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        m = _safe.search(text, start + size - 1)
        if not m:
            break
        out.append(text[start : m.end()])
        start = m.end()
    return [*out, text[start:]] if start < len(text) else out


def by_bytes(texts: list[tuple[int, str]], size: int = BATCH_BYTES) -> Iterator[list[tuple[int, str]]]:
    """(index, text) in order, in lists of about ``size`` bytes of UTF-8."""
    part: list[tuple[int, str]] = []
    total = 0
    for i, t in texts:
        part.append((i, t))
        total += len(t) if t.isascii() else len(t.encode())
        if total >= size:
            yield part
            part, total = [], 0
    if part:
        yield part


def encoded(texts: list[str], vocabulary: str = VOCABULARY) -> Iterator[tuple[int, list[int]]]:
    """(index of the text, ids) of the pieces of each text in order, as tokenizers gives the whole text without added
    special tokens; a batch of about ``BATCH_BYTES`` is encoded at a time."""
    plain: list[tuple[int, str]] = []
    rest: list[tuple[int, str]] = []
    for i, t in enumerate(texts):
        (plain if _plain(t) else rest).extend((i, p) for p in pieces(t))
    for part in by_bytes(plain):
        encode = fast_encoder(vocabulary).encode_ordinary  # its own batches only add threads
        yield from [(i, encode(t)) for i, t in part]
    for part in by_bytes(rest):
        found = full_encoder(vocabulary).encode_batch([t for _, t in part], add_special_tokens=False)
        yield from zip([i for i, _ in part], (e.ids for e in found))


def lengths(texts: list[str], vocabulary: str = VOCABULARY) -> list[int]:
    """The number of tokens of each text."""
    out = [0] * len(texts)
    for i, ids in encoded(texts, vocabulary):
        out[i] += len(ids)
    return out


def id_arrays(texts: list[str], vocabulary: str = VOCABULARY) -> list[np.ndarray]:
    """The ids of each text, as little-endian unsigned 32-bit numbers."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for i, ids in encoded(texts, vocabulary):
        out[i].append(np.array(ids, "<u4"))
    return [np.concatenate(x) if x else np.empty(0, "<u4") for x in out]


def token_counts(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(lengths(texts, vocabulary), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
