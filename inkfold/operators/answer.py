"""Context within a budget, extractive answers, refusals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_terms, let, strip

#: Characters of context, uses of one source, snippet and quote lengths, least shared terms, least score.
BUDGET, PER_SOURCE, SNIPPET, QUOTE, OVERLAP, LEAST_SCORE = 4000, 2, 500, 200, 2, 0.3
# Phrases of an answer that refuses in its own words.
SOFT_REFUSALS = (
    "cannot find information", "cannot find any information", "can't find information", "no information",
    "not directly address", "does not directly address", "sources are largely unrelated", "sources are unrelated",
    "not addressed in the", "the provided sources do not", "the sources do not contain", "i don't have information",
    "there is no information",
)
# The texts of the three refusals.
NO_HITS = "I couldn't find anything in the corpus that supports an answer."
WEAK_HITS = "I couldn't find anything relevant enough to answer that question."
NO_ANSWER = "The sources don't support a reliable answer."


def context(hits: DataFrame, budget: int = BUDGET, per_source: int = PER_SOURCE) -> DataFrame:
    """query_id, position (from 1), source_id, score, snippet: hits in rank order until the budget is spent.

    A source is used at most ``per_source`` times. The first hit always counts; the first one that goes beyond the
    budget ends the list, which is a running sum, as lengths are never negative.
    """
    uses = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    taken = Window.partitionBy("query_id").orderBy("rank")
    return (
        hits.withColumn("_use", F.row_number().over(uses))
        .where(F.col("_use") <= per_source)
        .withColumn("_used", F.sum(F.length("content")).over(taken.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("position", F.row_number().over(taken))
        .where((F.col("position") == 1) | (F.col("_used") <= budget))
        .select("query_id", "position", F.col("chunk_id").alias("source_id"), "score", F.substring("content", 1, SNIPPET).alias("snippet"))
    )


def extractive_answer(question: Column, source_id: Column, snippet: Column, overlap: int = OVERLAP) -> Column:
    """A fixed sentence quoting the best snippet, or '' when it shares too few terms with the question."""
    shared = F.size(F.array_intersect(content_terms(question), content_terms(snippet)))
    text = F.concat(
        F.lit("Based on the retrieved source ["), source_id, F.lit("], here is the relevant content: "),
        F.substring(snippet, 1, QUOTE), F.lit("..."),
    )
    return F.when(shared >= overlap, text).otherwise("")


def soft_refusal(answer: Column) -> Column:
    """Whether an answer refuses in its own words and cites nothing."""
    phrases = F.array(*[F.lit(p) for p in SOFT_REFUSALS])
    # the head is made once, not for each phrase
    says = let(F.substring(strip(F.lower(answer)), 1, 200), lambda head: F.exists(phrases, lambda p: F.contains(head, p)))
    return F.coalesce((answer == "") | (says & ~answer.rlike(r"(?U)\[[\w.\-:]+:\w+\]")), F.lit(True))


Generator = Callable[[list[str], list[list[dict]]], list[str]]


def _no_answer() -> Generator:
    return lambda questions, citations: ["" for _ in questions]


#: Builders of generators by name; one is built in each Python worker. ``extractive`` needs no worker.
GENERATORS: dict[str, Callable[[], Generator] | None] = {"extractive": None, "none": _no_answer}


def register_generator(name: str, build: Callable[[], Generator]) -> None:
    GENERATORS[name] = build


def generated(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (question, citations, ...) with ``answer`` of a registered generator; NO_ANSWER counts as none."""
    if name not in GENERATORS:
        raise ValueError(f"unknown generator: {name}")
    build = GENERATORS[name]
    if build is None:
        top = F.get("citations", F.lit(0))
        text = F.coalesce(extractive_answer(F.col("question"), top["source_id"], top["snippet"]), F.lit(""))
        return rows.withColumn("answer", text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = build()
        for f in frames:
            cites = [[dict(c) if isinstance(c, dict) else c.asDict() for c in (cs if cs is not None else [])] for cs in f["citations"]]
            yield f.assign(answer=make(f["question"].tolist(), cites))

    schema = rows.withColumn("answer", F.lit("")).schema
    out = rows.mapInPandas(run, schema)
    return out.withColumn("answer", F.when(F.startswith(F.upper("answer"), F.lit("NO_ANSWER")), "").otherwise(F.col("answer")))


def answer_questions(
    questions: DataFrame, hits: DataFrame, generator: str = "extractive", least: float = LEAST_SCORE, soft: bool = False
) -> DataFrame:
    """query_id, question, status, answer, confidence, citations for every question, hits or not.

    Refused: no hit; a best score below ``least``; a blank answer, which loses its citations (with ``soft``, also one
    that refuses in its own words).
    """
    cited = F.array_sort(F.collect_list(F.struct("position", "source_id", "score", "snippet")))
    top = F.get("citations", F.lit(0))
    asked = (
        questions.select("query_id", "question")
        .join(context(hits).groupBy("query_id").agg(cited.alias("citations")), "query_id", "left")
        .withColumn("_best", top["score"])
    )
    said = generated(asked, generator)
    blank = strip(F.col("answer")) == ""
    if soft:
        blank = blank | soft_refusal(F.col("answer"))
    none = F.col("citations").isNull()
    weak = F.col("_best") < least
    status = F.when(none | weak | blank, "refused").otherwise("answered")
    text = F.when(none, NO_HITS).when(weak, WEAK_HITS).when(blank, NO_ANSWER).otherwise(F.col("answer"))
    empty = F.slice(F.coalesce("citations", F.array().cast(dict(asked.dtypes)["citations"])), 1, 0)
    return said.select(
        "query_id", "question", status.alias("status"), text.alias("answer"),
        F.when(status == "answered", F.col("_best")).alias("confidence"),
        F.when(status == "answered", F.col("citations")).otherwise(empty).alias("citations"),
    )
