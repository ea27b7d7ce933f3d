"""Building evaluation sets: seeded samples, template questions, gates and near-duplicate rejection."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.modality import modality_of_id, paper_of_id
from ..functions.text import strip
from ..sources.remote import retried
from ..sources.tables import stored

SEED = 7
#: Shares and shortest contents by modality; sizes of prompts and questions.
SHARES = {"text": 0.60, "figure": 0.15, "table": 0.15, "formula": 0.10}
LEAST = {"text": 200, "figure": 10, "table": 10, "formula": 5}
PROMPT_CUT, LEAST_QUESTION, SAME_ABOVE = 1500, 10, 0.5
#: Words of a sentence that identifies its passage.
LEAST_WORDS = 8


def shuffled(key: str | Column, seed: int = SEED) -> Column:
    """A reproducible random order: the md5 of the seed and the id."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), c).cast("binary"))


def diverse_sample(chunks: DataFrame, n: int, per_paper: int = 2, seed: int = SEED) -> DataFrame:
    """chunk_id, content, position of at most n chunks: first up to ``per_paper`` of each paper, then any others."""
    paper = Window.partitionBy("_paper").orderBy("_r", "chunk_id")
    ranked = chunks.withColumn("_paper", paper_of_id(F.col("chunk_id"))).withColumn("_r", shuffled("chunk_id", seed))
    ranked = ranked.withColumn("_fill", (F.row_number().over(paper) > per_paper).cast("int"))
    top = ranked.orderBy("_fill", "_r", "chunk_id").limit(n)
    order = Window.orderBy(shuffled("chunk_id", seed + 1), "chunk_id")  # over the n rows of the sample
    return top.select("chunk_id", "content", F.row_number().over(order).alias("position"))


def template_question(content: Column) -> Column:
    """A fixed question about the first sentence."""
    first = strip(F.get(F.split(content, "\\."), F.lit(0)))
    short = F.when(F.length(first) > 80, F.concat(F.substring(first, 1, 80), F.lit("..."))).otherwise(first)
    return F.concat(F.lit("According to the paper, what does this passage describe: "), short, F.lit("?"))


def stratified_sample(chunks: DataFrame, n: int, per_paper: int = 2, seed: int = SEED) -> DataFrame:
    """chunk_id, content, modality of a quota of each modality, at most ``per_paper`` chunks of a paper.

    Papers come in the order of their first chunk (``ord``), as many as the quota takes.
    """
    kind = modality_of_id(F.col("chunk_id"), "builder")
    rows = chunks.withColumn("modality", kind).withColumn("_paper", paper_of_id(F.col("chunk_id")))
    quota, least = F.lit(0), F.lit(0)
    for m, share in SHARES.items():
        quota = F.when(F.col("modality") == m, int(n * share + 1e-9)).otherwise(quota)
        least = F.when(F.col("modality") == m, LEAST[m]).otherwise(least)
    pool = rows.where(F.length("content") >= least).withColumn("_r", shuffled("chunk_id", seed))
    paper = Window.partitionBy("modality", "_paper")
    pool = pool.withColumn("_first", F.min("ord").over(paper)).withColumn("_n", F.row_number().over(paper.orderBy("_r", "chunk_id")))
    order = Window.partitionBy("modality").orderBy("_first", "_paper", "_n")
    kept = pool.where(F.col("_n") <= per_paper).withColumn("_k", F.row_number().over(order))
    # the fixed limit lets each task hand on only that many rows of a modality
    most = max(int(n * share + 1e-9) for share in SHARES.values())
    return kept.where(F.col("_k") <= most).where(F.col("_k") <= quota).select("chunk_id", "content", "modality")


def topic_snippets(chunks: DataFrame, papers: int = 20, least: int = 100, cut: int = 150) -> DataFrame:
    """paper_id, snippet of the first chunk longer than ``least`` of the first papers."""
    rows = chunks.where(F.length("content") > least)
    first = rows.groupBy(paper_of_id(F.col("chunk_id")).alias("paper_id")).agg(F.min(F.struct("ord", "content")).alias("_f"))
    return first.orderBy("_f.ord").limit(papers).select("paper_id", F.substring("_f.content", 1, cut).alias("snippet"))


def question_tokens(question: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit("([a-z]{4,})"), 1))


def similar_questions(questions: DataFrame, above: float = SAME_ABOVE) -> DataFrame:
    """a, b, jaccard of all pairs of questions above the threshold (a < b).

    Two token sets that are alike share a token among the rarest of each: of n tokens, the first n - ceil(above * n) + 1 in
    the order of frequency. So only those meet, and a token that is in most questions hardly ever does.
    """
    rows = stored(questions.select("query_id", question_tokens(F.col("question")).alias("_t")), "question-tokens")
    each = rows.select("query_id", F.size("_t").alias("_n"), F.explode("_t").alias("_w"))
    often = each.groupBy("_w").agg(F.count(F.lit(1)).alias("_f"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("_f", "_w"))
    rare = each.join(often, "_w").withColumn("_k", rank).where(F.col("_k") <= F.col("_n") - F.ceil(F.col("_n") * above) + 1)
    one = rare.select(F.col("query_id").alias("a"), F.col("_n").alias("_na"), "_w")
    two = rare.select(F.col("query_id").alias("b"), F.col("_n").alias("_nb"), "_w")
    near = F.least("_na", "_nb") > above * F.greatest("_na", "_nb")
    pairs = one.join(two, "_w").where(near & (F.col("a") < F.col("b"))).select("a", "b").distinct()
    sets = pairs.join(rows.select(F.col("query_id").alias("a"), F.col("_t").alias("_ta")), "a").join(
        rows.select(F.col("query_id").alias("b"), F.col("_t").alias("_tb")), "b"
    )
    jaccard = F.size(F.array_intersect("_ta", "_tb")) / F.size(F.array_union("_ta", "_tb"))
    return sets.select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") > above)


def reject_near_duplicates(questions: DataFrame, above: float = SAME_ABOVE) -> DataFrame:
    """query_id, question, accepted: in order of query_id, a question too like an accepted one is rejected.

    Questions without an earlier like one are accepted at once. The others are settled in rounds: pairs are dealt by ranges of the later
    question, and a task goes through its range in order, with what it has just found for its own questions and what earlier rounds have
    found for others. A round settles at least the first range that is open, so there are no more rounds than ranges, however long a chain
    of like questions is; each is written.
    """
    rows = questions.select(F.col("query_id").cast("long").alias("query_id"), "question")
    pairs = stored(similar_questions(rows, above).select("a", "b"), "like-questions")
    later = pairs.select(F.col("b").alias("q")).distinct()
    first = pairs.select(F.col("a").alias("q")).distinct().join(later, "q", "left_anti").select("q", F.lit(True).alias("ok"))
    said = stored(first.unionByName(later.select("q", F.lit(None).cast("boolean").alias("ok"))), "said")
    while not said.where("ok is null").isEmpty():
        open_ = said.where("ok is null").select(F.col("q").alias("b"))
        asked = pairs.join(open_, "b").join(said.select(F.col("q").alias("a"), "ok"), "a")
        found = asked.repartitionByRange("b").sortWithinPartitions("b", "a").mapInArrow(_settled, "q long, ok boolean")
        said = stored(said.where("ok is not null").unionByName(found), "said")
    return rows.join(said.select(F.col("q").alias("query_id"), "ok"), "query_id", "left").select(
        "query_id", "question", F.coalesce("ok", F.lit(True)).alias("accepted")
    )


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """q, ok of each ``b`` in the rows (a, b, ok of a), in order: false after an accepted one, null where one is still open, else true."""
    known: dict[int, bool | None] = {}
    b, any_, open_ = None, False, False
    out: list[tuple[int, bool | None]] = []

    def end() -> None:
        known[b] = False if any_ else None if open_ else True
        out.append((b, known[b]))

    for batch in batches:
        for x, q, ok in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ok"))):
            if q != b:
                if b is not None:
                    end()
                b, any_, open_ = q, False, False
            ok = known.get(x, ok)
            any_, open_ = any_ or ok is True, open_ or ok is None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], pa.int64()), pa.array([k for _, k in out], pa.bool_())], ["q", "ok"])
            out.clear()
    if b is not None:
        end()
        yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], pa.int64()), pa.array([k for _, k in out], pa.bool_())], ["q", "ok"])


def generated_cases(sample: DataFrame, build: Callable[[], Callable[[str, str], tuple[str, str]]], tries: int = 3, wait: float = 2.0) -> DataFrame:
    """Cases from a plug-in that maps (modality, content) to (question, verdict): question, gold, answerable, modality, kept.

    Contents are cut before the call, a call is tried up to ``tries`` times with growing waits, and a case is kept when its
    question is long enough and the verdict says YES. A call that fails every time gives a case that isn't kept.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = build()
        for f in frames:
            out: list[tuple[str | None, str | None]] = []
            for m, c in zip(f["modality"], f["content"]):
                try:
                    out.append(retried(lambda: ask(m, c[:PROMPT_CUT]), tries, wait))
                except Exception:  # belongs to this case alone
                    out.append((None, None))
            yield f.assign(question=[q for q, _ in out], verdict=[v for _, v in out]).drop(columns="content")

    made = sample.select("chunk_id", "content", "modality").mapInPandas(run, "chunk_id string, modality string, question string, verdict string")
    kept = F.coalesce((F.length("question") >= LEAST_QUESTION) & F.contains(F.upper("verdict"), F.lit("YES")), F.lit(False))
    return made.select("question", F.array("chunk_id").alias("gold"), F.lit(True).alias("answerable"), "modality", kept.alias("kept"))


def first_sentence_writer() -> Callable[[str, str], tuple[str, str]]:
    """A writer that needs no model: it asks for the passage that begins with a chunk's first sentence, and vouches for sentences of
    ``LEAST_WORDS`` words or more. A chunk that begins without a sentence is an error."""

    def ask(modality: str, content: str) -> tuple[str, str]:
        sentence = " ".join(re.split(r"[.!?]", content, maxsplit=1)[0].split())
        if not sentence:
            raise ValueError("no sentence")
        return f"Which {modality} begins with: {sentence[:80]}?", "YES" if len(sentence.split()) >= LEAST_WORDS else "NO"

    return ask


def build_cases(
    sample: DataFrame, build: Callable[[], Callable[[str, str], tuple[str, str]]], target: int, factor: int = 3, wait: float = 2.0
) -> DataFrame:
    """At most ``target`` kept cases from at most ``factor`` times as many attempts, in the order of ``sample``'s position.

    Attempts are made in rounds of what is still missing, each of them one distributed batch; the cases are few by design.
    """
    got, tried, rounds = 0, 0, []
    while got < target and tried < factor * target:
        n = min(target - got, factor * target - tried)
        batch = sample.where((F.col("position") > tried) & (F.col("position") <= tried + n))
        cases = stored(generated_cases(batch, build, wait=wait), "cases")
        made = cases.agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("k")).first()
        if not made["n"]:
            break
        rounds.append(cases)
        tried, got = tried + n, got + made["k"]
    if not rounds:
        return generated_cases(sample.limit(0), build)
    return reduce(lambda a, b: a.unionByName(b), rounds)


def build_stats(cases: DataFrame) -> DataFrame:
    """modality, n_sampled, n_kept, n_failed, success_rate."""
    return cases.groupBy("modality").agg(
        F.count(F.lit(1)).alias("n_sampled"), F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_failed"),
        (F.count_if("kept") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("success_rate"),
    )
