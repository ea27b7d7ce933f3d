"""White space, words and character counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that str.strip() and str.split() know, as the inside of a regex class.
SPACE = (
    "\\t-\\r\\x1c-\\x20\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
)

#: The same characters as a text.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: Texts that are split at a time.
TEXTS = 512

# Words that carry no content.
STOPWORDS = (
    "the and for are was with this that from have has been which what how does can will not but all any one"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def trimmed(c: Column) -> Column:
    """As :func:`strip`, reading only the ends of a text that has been cut from a longer one."""
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def words(c: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(c), f"[{SPACE}]+"), lambda w: w != "")


def lines(c: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def count_of(c: Column, chars: str) -> Column:
    """How many characters of ``c`` are among ``chars``."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


def content_terms(c: Column) -> Column:
    """Distinct lower-case runs of three or more ASCII letters, without stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-zA-Z]{3,})"), 1)
    return F.array_except(found, F.array(*[F.lit(w) for w in STOPWORDS]))


def counted(values: Column) -> Column:
    """array<struct<value, n>> in the order of the values: how often each stands in an array. One sort inside the row."""

    def runs(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)))
        starts = F.filter(places, lambda i: (i < F.size(s)) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        end = lambda b, k: F.coalesce(F.get(b, k + 1), F.size(s))
        return let(starts, lambda b: F.transform(b, lambda at, k: F.struct(F.get(s, at).alias("value"), (end(b, k) - at).alias("n"))))

    return let(F.sort_array(values), runs)


def word_counts(c: Column) -> Column:
    """struct<dl, t array<struct<value, n>>>: how many :func:`words` a text has, and how often each, in any order; NULL for NULL."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("dl", pa.int32()), ("t", pa.list_(pa.struct([("value", pa.string()), ("n", pa.int32())])))])
        for texts in batches:
            parts = [pa.array([], kind)]
            for i in range(0, len(texts), TEXTS):
                part = texts.slice(i, TEXTS)
                found, n, sizes, lengths = [], [], [0], []
                for t in part.fill_null("").to_pylist():
                    w = t.split()
                    own = Counter(w)
                    found.extend(own)
                    n.extend(own.values())
                    sizes.append(len(own))
                    lengths.append(len(w))
                pairs = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(n, pa.int32())], ["value", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pairs)
                parts.append(pa.StructArray.from_arrays([pa.array(lengths, pa.int32()), lists], ["dl", "t"], mask=part.is_null()))
            yield pa.concat_arrays(parts)

    return F.arrow_udf(count, "struct<dl:int,t:array<struct<value:string,n:int>>>")(F.lower(c))


def texts_with(texts: pa.Array) -> list[pa.Array]:
    """The different :func:`words` of lower-cased texts, and how many of the texts have each."""
    found = pc.utf8_split_whitespace(texts.drop_null())
    each = found.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(found)), pc.list_value_length(found))
    pairs = each.indices.to_numpy().astype(np.int64) << 32 | row
    pairs.sort()
    n = pa.array(np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] >> 32, minlength=len(each.dictionary)), pa.int64())
    there = pc.not_equal(each.dictionary, "")  # before and after white space at the ends
    return [each.dictionary.filter(there), n.filter(there)]
