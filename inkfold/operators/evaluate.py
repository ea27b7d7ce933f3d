"""Retrieval, citation, groundedness and refusal metrics over batches of questions. NULL means undefined."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, TEXTS, strip
from ..sources.tables import stored


def _set(c: Column) -> Column:
    return F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))


def recall_at(ids: Column, gold: Column, k: int | None = None) -> Column:
    """Share of the gold ids among the first k; NULL without gold."""
    top = ids if k is None else F.slice(ids, 1, k)
    return F.try_divide(F.size(F.array_intersect(_set(gold), _set(top))), F.size(_set(gold)))


def reciprocal_rank(ids: Column, gold: Column) -> Column:
    """1 / the first rank with a gold id; 0.0 where there is none."""
    places = F.transform(_set(gold), lambda g: F.nullif(F.array_position(ids, g), F.lit(0)))
    return F.coalesce(1 / F.array_min(places), F.lit(0.0))


def citation_precision(cited: Column, gold: Column) -> Column:
    """Share of citations that are gold, repeated ones counted each; NULL without citations."""
    good = F.filter(cited, lambda c: F.array_contains(_set(gold), c))
    return F.try_divide(F.size(good), F.size(cited))


def citation_recall(cited: Column, gold: Column) -> Column:
    return recall_at(cited, gold)


def inline_markers(answer: Column) -> Column:
    """What stands in square brackets, stripped, in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[([^\[\]]+)\]"), 1), strip)


def marker_labels(citations: Column, fields: tuple[str, ...] = ("source_id",)) -> Column:
    """Lower-cased labels that a marker may name: ids, and sections and figure labels where the citations have them."""

    def lowered(field: str) -> Column:
        return F.transform(citations, lambda c: F.lower(c[field]))

    parts = [lowered(f) for f in fields]
    return F.array_distinct(F.filter(F.array_compact(F.concat(*parts)), lambda x: x != ""))


def groundedness(answer: Column, labels: Column) -> Column:
    """Share of markers that equal, contain or lie in a label; NULL without markers or labels."""
    markers = F.transform(inline_markers(answer), F.lower)
    good = F.filter(
        markers, lambda m: (m != "") & F.exists(labels, lambda x: F.contains(m, x) | F.contains(x, m))
    )
    return F.when(F.size(labels) > 0, F.try_divide(F.size(good), F.size(markers)))


def cited_ids(answer: Column, citations: Column, section: str | None = None, figure: str | None = None) -> Column:
    """Ids that the markers name: an exact id, else the last citation of that section, else of that figure label.
    Unknown markers are ignored; where none is known, all ids are cited."""
    ids = F.transform(citations, lambda c: c["source_id"])

    def named(field: str | None, marker: Column) -> Column:
        if field is None:
            return F.lit(None).cast("string")
        same = F.filter(citations, lambda c: (F.lower(c[field]) == F.lower(marker)) & (c[field] != ""))
        return F.try_element_at(same, F.lit(-1))["source_id"]

    found = F.array_compact(
        F.transform(
            inline_markers(answer),
            lambda m: F.when(F.array_contains(ids, m), m).otherwise(F.coalesce(named(section, m), named(figure, m))),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(ids)


def refusal_tally(rows: DataFrame) -> DataFrame:
    """One row of the confusion of answerable and answered, and its ratios (NULL on a zero denominator)."""
    answered, able = F.col("status") == "answered", F.col("answerable")
    cells = rows.agg(
        F.count_if(able & answered).alias("answered_answerable"), F.count_if(able & ~answered).alias("refused_answerable"),
        F.count_if(~able & ~answered).alias("refused_unanswerable"), F.count_if(~able & answered).alias("answered_unanswerable"),
    )
    a, b, c, d = (F.col(x) for x in cells.columns)
    return cells.select(
        "*", F.try_divide(a + c, a + b + c + d).alias("answer_accuracy"), F.try_divide(c, c + d).alias("refusal_recall"),
        F.try_divide(c, b + c).alias("refusal_precision"),
    )


#: Most passages of one or two words that are looked for by a broadcast.
MOST_SHORT = 10_000
#: Most keys of passages that go to each worker.
MOST_KEYS = 1 << 17


def _with_keys(corpus: DataFrame, keys: list[str]) -> DataFrame:
    """chunk_id, _g of the chunks that have a key, one word or five with a space between. Texts are split in the task that reads them."""
    held = corpus.sparkSession.sparkContext.broadcast(keys)
    kind = dict(corpus.dtypes)["chunk_id"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(held.value)
        heads = {k.split(" ", 1)[0] for k in known}
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                part = b.slice(i, TEXTS)
                at: list[int] = []
                found: list[str] = []
                for row, t in enumerate(part.column("content").to_pylist()):
                    w = (t or "").split()
                    if heads.isdisjoint(w):
                        continue
                    own = {g for j, x in enumerate(w) if x in heads for g in (x, " ".join(w[j : j + 5])) if g in known}
                    at += [row] * len(own)
                    found += own
                if at:
                    yield pa.RecordBatch.from_arrays([part.column("chunk_id").take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["chunk_id", "_g"])

    return corpus.select("chunk_id", "content").mapInArrow(find, f"chunk_id {kind}, _g string")


def gold_by_passage(corpus: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, chunk_id of chunks that contain a whole passage (query_id, question).

    The second to last but one word of a passage stand between white space in any text that holds it. A passage of seven or
    more words meets the chunks by equality of five of them, one of three to six by its longest one, and only then is the
    text searched. Up to ``MOST_KEYS`` such keys go to each worker and are looked up where a text is read; beyond that, all keys of all
    chunks meet them by a join. One or two words may lie inside other words: up to ``MOST_SHORT`` such passages go to every task.
    """
    space = f"[{SPACE}]+"  # as in the workers
    w = F.filter(F.split("content", space), lambda x: x != "")
    grams = F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.size("_w") - 4), lambda i: F.array_join(F.slice("_w", i, 5), " "))
    )
    # keys travel without the text they are from
    keyed = corpus.select("chunk_id", w.alias("_w"))
    by_five = keyed.where(F.size("_w") >= 5).select("chunk_id", F.explode(grams).alias("_g"))
    by_one = keyed.select("chunk_id", F.explode(F.array_distinct("_w")).alias("_g"))
    q = passages.select("query_id", "question", F.filter(F.split("question", space), lambda x: x != "").alias("_w")).withColumn("_n", F.size("_w"))
    inner = F.slice("_w", 2, F.greatest(F.col("_n") - 2, F.lit(0)))
    longest = F.get(F.array_sort(inner, lambda a, b: F.length(b) - F.length(a)), F.lit(0))
    long_ = q.where("_n >= 7").select("query_id", "question", F.array_join(F.slice("_w", 2, 5), " ").alias("_g"))
    middle = q.where("_n between 3 and 6").select("query_id", "question", longest.alias("_g"))
    short = q.where("_n < 3").select("query_id", "question")
    hit = F.contains("content", "question")
    keys = [r["_g"] for r in long_.union(middle).select("_g").distinct().limit(MOST_KEYS + 1).collect()]
    if len(keys) <= MOST_KEYS:
        asked = [_with_keys(corpus if keys else corpus.limit(0), keys).join(long_.union(middle), "_g")]
    else:
        asked = [by_five.join(long_, "_g"), by_one.join(middle, "_g")]
    # written: few chunks share a key with a passage, and their number is known before the texts are looked at
    asked = stored(reduce(DataFrame.unionByName, [a.select("query_id", "question", "chunk_id") for a in asked]).distinct(), "passage-candidates")
    found = corpus.select("chunk_id", "content").join(asked, "chunk_id").where(hit).select("query_id", "chunk_id").distinct()
    n = short.count()
    if n:
        short = F.broadcast(short) if n <= MOST_SHORT else short
        found = found.unionByName(corpus.join(short, hit).select("query_id", "chunk_id").distinct())
    return found


def evaluate(cases: DataFrame, hits: DataFrame, answers: DataFrame, k: int = 5) -> DataFrame:
    """One row per case: cases (query_id, question, gold, answerable), hits at k, and answers made with their own hits.

    Citation and groundedness metrics belong to answerable cases only.
    """
    got = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    found = hits.groupBy("query_id").agg(F.transform(got, lambda h: h["chunk_id"]).alias("retrieved"))
    ids = F.coalesce("retrieved", F.array().cast("array<string>"))
    able = lambda c: F.when(F.col("answerable"), c)
    cited = F.when(F.col("status") == "answered", cited_ids(F.col("answer"), F.col("citations"))).otherwise(F.array().cast("array<string>"))
    return (
        cases.join(found, "query_id", "left")
        .join(answers.select("query_id", "status", "answer", "citations"), "query_id", "left")
        .withColumn("retrieved", ids)
        .withColumn("cited", cited)
        .select(
            "query_id", "question", "answerable", "status", "gold", "retrieved", "cited", "answer",
            recall_at(F.col("retrieved"), F.col("gold"), k).alias("recall"),
            reciprocal_rank(F.col("retrieved"), F.col("gold")).alias("rr"),
            able(citation_precision(F.col("cited"), F.col("gold"))).alias("citation_precision"),
            able(citation_recall(F.col("cited"), F.col("gold"))).alias("citation_recall"),
            able(groundedness(F.col("answer"), marker_labels(F.col("citations")))).alias("groundedness"),
        )
    )


def summary(results: DataFrame) -> DataFrame:
    """One row of means over the defined values; the mean reciprocal rank is over answerable cases."""
    return results.agg(
        F.count(F.lit(1)).alias("n_cases"), F.avg("recall").alias("recall"), F.avg(F.when(F.col("answerable"), F.col("rr"))).alias("mrr"),
        F.avg("citation_precision").alias("citation_precision"), F.avg("citation_recall").alias("citation_recall"),
        F.avg("groundedness").alias("groundedness"), F.count_if(F.col("status") == "refused").alias("n_refused"),
    )


