"""Secret scan: three base patterns, and a token-efficiency test for random strings.

Base kinds, each leftmost and without overlap, offsets in code points of the whole
text: ``assign`` (a keyword, a separator and a value of 6 or more characters),
``access`` (an access key id of 20 or more characters), ``hex`` (24 or more lower-case
hexadecimal digits). A match that is too short uses up its text and is dropped.

The method adds ``token`` spans: runs of 20 or more characters of a key alphabet, with
a letter, whose characters per token under the tiktoken vocabulary are below ``RATIO``.
Random strings split into many short tokens; words do not. Left out are known digests
(32, 40, 64, 96 or 128 hexadecimal digits and nothing else), UUIDs and identifiers, whose
letters are all in words (4 or more letters, with ``WORD_RATIO`` characters per token or
more on their own) or in single tokens of up to 3 letters between separators. Base spans,
which are reported already, are cut out of the runs first.

A run that passes as a whole may hide a key behind host, path or names. Its windows of 20
or more characters are held against ``RATIO`` too; parts between separators that are
identifiers or digests, or letters alone that pass as a whole (a long word of some
language), don't count for a window there, only against it. What is reported is every
part that such a window reaches.

Defined results: null counts as empty, with no spans and the sha256 of the empty
string; a very long text is scanned whole; repeated rows are scanned each; other columns
of any name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import fast_encoder

KINDS = ("assign", "access", "hex", "token")
RATIO = 2.2
LEAST = 20
#: Least characters per token of a word of an identifier, in the best of its own case, lower case and lower case after a space.
WORD_RATIO = 2.5

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")

#: What any match of ASSIGN needs; found much faster than the pattern itself.
_separator = re.compile(r"[:=]")
_long_hex = re.compile(r"[0-9a-f]{24,}")
_run = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST},}}")
_digest = re.compile(r"[0-9A-Fa-f]+")
_uuid = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_letters = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_separators = "_./=-"
_part = re.compile(r"[A-Za-z0-9+]+")
DIGEST_LENGTHS = (32, 40, 64, 96, 128)


@lru_cache(maxsize=1 << 14)
def _n_tokens(word: str) -> int:
    return min(len(fast_encoder().encode_ordinary(w)) for w in (word, word.lower(), " " + word.lower()))


def _is_name(run: str) -> bool:
    """Whether all letters of ``run`` are in words, or in short single tokens between separators."""
    if "+" in run:
        return False
    for m in _letters.finditer(run):
        a, b = m.span()
        if b - a > 3:
            if b - a < WORD_RATIO * _n_tokens(m[0]):
                return False
        elif run[a - 1 : a] not in _separators or run[b : b + 1] not in _separators or _n_tokens(m[0]) > 1:
            return False
    return True


def _is_random(run: str) -> bool:
    if not re.search("[A-Za-z]", run):
        return False
    if len(run) in DIGEST_LENGTHS and _digest.fullmatch(run) or _uuid.fullmatch(run):
        return False
    return len(run) < RATIO * len(fast_encoder().encode_ordinary(run)) and not _is_name(run)


def _hidden(run: str) -> list[tuple[int, int]]:
    """The stretches of parts of ``run`` in which some window of ``LEAST`` or more characters is random."""
    known = bytearray(len(run))  # characters that don't count for a window
    parts = [m.span() for m in _part.finditer(run)]
    first, last = [0] * len(run), [0] * len(run)
    for a, b in parts:
        first[a:b], last[a:b] = [a] * (b - a), [b] * (b - a)
        word = _letters.fullmatch(run, a, b) and b - a >= RATIO * _n_tokens(run[a:b])
        if word or b - a in DIGEST_LENGTHS and _digest.fullmatch(run, a, b) or _is_name(run[a:b]):
            known[a:b] = b"\1" * (b - a)
    for m in _uuid.finditer(run):
        known[m.start() : m.end()] = b"\1" * len(m[0])
    if all(known[a] for a, _ in parts):
        return []
    ends = list(accumulate(map(len, fast_encoder().decode_tokens_bytes(fast_encoder().encode_ordinary(run)))))
    starts = [0, *ends[:-1]]
    score, odd, edge = [], [], []
    for a, b in zip(starts, ends):
        inside = [i for i in range(a, b) if last[i]]
        odd.append(bool(inside) and not known[inside[-1]])
        edge.append(not inside or odd[-1] or last[inside[-1]] - first[inside[-1]] <= 3)
        near = [i for i in ((inside[-1],) if inside else (a - 1, b)) if 0 <= i < len(run)]
        score.append(RATIO - (b - a) if not any(known[i] for i in near) else min(0.0, RATIO - (b - a)))

    def reached(allowed: list[bool]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for i, a in enumerate(starts):
            if not allowed[i]:
                continue
            total, j = 0.0, i
            # a longer window that is random has a random half
            while j < len(ends) and starts[j] - a < 2 * LEAST:
                total += score[j]
                if allowed[j] and total > 0 and ends[j] - a >= LEAST:
                    x = next(k for k in range(a, ends[j]) if last[k])
                    y = next(k for k in range(ends[j] - 1, a - 1, -1) if last[k])
                    if out and first[x] <= out[-1][1]:
                        out[-1] = (out[-1][0], max(out[-1][1], last[y]))
                    else:
                        out.append((first[x], last[y]))
                j += 1
        return [(a, b) for a, b in out if re.search("[A-Za-z]", run[a:b])]

    # a key of little more than LEAST may itself begin or end with a separator or a short part
    return reached(odd) or reached(edge)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base kinds, in order."""
    out = []
    if _separator.search(text):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(*m.span(), 2) for m in _long_hex.finditer(text)]  # a run of 24 or more is a whole match of HEX
    return sorted((a, k, b) for a, b, k in out)


def token_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of kind ``token`` that touch none of ``base`` (in order of their starts)."""
    out = []
    starts = [a for a, _, _ in base]
    ends = [0, *accumulate((b for _, _, b in base), max)]  # ends[i]: the furthest end of the first i
    for m in _run.finditer(text):
        a = m.start()
        for i in range(bisect_right(ends, a) - 1, bisect_left(starts, m.end()) + 1):
            b = min(starts[i], m.end()) if i < len(starts) else m.end()
            if b - a >= LEAST:
                if _is_random(text[a:b]):
                    out.append((a, 3, b))
                else:
                    out += [(a + x, 3, a + y) for x, y in _hidden(text[a:b])]
            if i < len(starts):
                a = max(a, ends[i + 1])
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, n_token, spans for every row of ``docs`` (doc_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts: list[list[int]] = [[], [], [], []]
            sha, spans = [], []
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                more = token_spans(text, base)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                counts[3].append(len(more))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + more))
            n = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), n[0], n[1], n[2], pa.array(sha, pa.string()), pa.array(spans, pa.string()), n[3]],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(
        scan,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long",
    )
