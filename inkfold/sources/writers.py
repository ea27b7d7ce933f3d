"""Sinks: keyed upserts, resets, evaluation files, reports, vector dumps, downloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.embedding import DIM


def last_wins(rows: DataFrame, key: str = "chunk_id", order: str = "ord") -> DataFrame:
    """One row a key: the last one written. A maximum per key, combined before the shuffle, not a sort."""
    rest = [c for c in rows.columns if c not in (key, order)]
    best = F.max_by(F.struct(order, *rest), F.col(order)).alias("_r")
    return rows.groupBy(key).agg(best).select(key, "_r.*")


def upsert(stored: DataFrame, new: DataFrame, key: str = "chunk_id", order: str = "ord") -> DataFrame:
    """Stored rows with new ones over them: a new row replaces a stored one of its key."""
    fresh = last_wins(new, key, order)
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def dense_records(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    """id, vector, content, modality, paper_id for the vector table; a missing embedding is a zero vector."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return chunks.select(F.col("chunk_id").alias("id"), F.coalesce("embedding", zero).alias("vector"), "content", "modality", "paper_id")


def create_vector_table(spark: SparkSession, name: str, dim: int = DIM, metric: str = "COSINE", path: str | None = None) -> None:
    """A table for :func:`dense_records`, only if there is none; its dimension and metric are table properties."""
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (id STRING, vector ARRAY<FLOAT>, content STRING, modality STRING, paper_id STRING) USING parquet"
        f"{place} TBLPROPERTIES ('dimension' = '{dim}', 'metric' = '{metric}')"
    )


def vector_table_properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect() if r["key"] in ("dimension", "metric")}


def insert_vectors(spark: SparkSession, name: str, records: DataFrame) -> None:
    """Append records; a vector of another dimension than the table's is an error."""
    dim = int(vector_table_properties(spark, name)["dimension"])
    same = F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("wrong dimension: "), "id")).cast("array<float>"))
    records.select("id", same.alias("vector"), "content", "modality", "paper_id").write.insertInto(name)


def reset_vector_table(spark: SparkSession, name: str, dim: int = DIM, metric: str = "COSINE", path: str | None = None) -> None:
    """An empty table, whatever was there."""
    if spark.catalog.tableExists(name):
        spark.sql(f"DROP TABLE {name}")
    create_vector_table(spark, name, dim, metric, path)


def write_cases(cases: DataFrame, path: str) -> None:
    """JSON lines in UTF-8."""
    cases.select(F.to_json(F.struct(*cases.columns)).alias("value")).write.mode("overwrite").text(path)


def json_report(summary: DataFrame, tally: DataFrame, results: DataFrame) -> DataFrame:
    """One row with one JSON text: means, tally and every case. All cases are held in one row: for evaluation sets, which are small."""
    cases = results.agg(F.array_sort(F.collect_list(F.struct("query_id", *[c for c in results.columns if c != "query_id"]))).alias("cases"))
    return (
        summary.select(F.struct("*").alias("aggregate"))
        .join(F.broadcast(tally.select(F.struct("*").alias("tally"))), F.lit(True))
        .join(F.broadcast(cases), F.lit(True))
        .select(F.to_json(F.struct("aggregate", "tally", "cases")).alias("report"))
    )


def percent(c: Column) -> Column:
    """Percent with one decimal, ``n/a`` for NULL. Rounded as the double it is, a half to the even digit (6.25 is 6.2), as in Python and SQL;
    a format string would round the shortest decimal, and halves up."""
    return F.when(c.isNull(), "n/a").otherwise(F.concat(F.call_function("format_number", c * 100, F.lit("0.0")), F.lit("%")))


def _cut(c: Column, n: int) -> Column:
    return F.substring(F.regexp_replace(c, r"[\r\n|]", " "), 1, n)


def report_lines(results: DataFrame, cut: int, form: str) -> DataFrame:
    """query_id, line: a formatted line of question, status, recall and reciprocal rank for each case."""
    cells = _cut(F.col("question"), cut), F.coalesce("status", F.lit("-")), percent(F.col("recall")), percent(F.col("rr"))
    return results.select("query_id", F.format_string(form, *cells).alias("line"))


def _whole_report(figures: list[tuple[str, Column]], summary: DataFrame, form: str, before: list[str], between: list[str], cases: DataFrame) -> DataFrame:
    """place, line: 0 to 99 for the head, from 100 on a line for each case in the order of query_id."""
    head = [F.lit(x) for x in before] + [F.format_string(form, F.lit(k), v.cast("string")) for k, v in figures] + [F.lit(x) for x in between]
    top = summary.select(F.posexplode(F.array(*head)).alias("_n", "line"))
    return top.select(F.struct(F.col("_n").cast("long").alias("part"), F.lit(0).cast("long").alias("query_id")).alias("place"), "line").unionByName(
        cases.select(F.struct(F.lit(100).cast("long").alias("part"), F.col("query_id").cast("long").alias("query_id")).alias("place"), "line")
    )


def markdown_lines(results: DataFrame, summary: DataFrame, cut: int = 50) -> DataFrame:
    """The lines of two Markdown tables, the means and a line per question, by place (part, query_id)."""
    figures = [("n_cases", F.col("n_cases")), *((c, percent(F.col(c))) for c in ("recall", "mrr")), ("n_refused", F.col("n_refused"))]
    between = ["", "| question | status | recall | rr |", "| --- | --- | --- | --- |"]
    cases = report_lines(results, cut, "| %s | %s | %s | %s |")
    return _whole_report(figures, summary, "| %s | %s |", ["| metric | value |", "| --- | --- |"], between, cases)


def console_lines(results: DataFrame, summary: DataFrame, cut: int = 45) -> DataFrame:
    """The same figures as plain lines."""
    names = ["recall", "mrr", "citation_precision", "citation_recall", "groundedness"]
    figures = [(c, F.col(c)) for c in ("n_cases", "n_refused")] + [(c, percent(F.col(c))) for c in names]
    return _whole_report(figures, summary, "%s: %s", [], [""], report_lines(results, cut, "%-" + str(cut) + "s %-9s %8s %8s"))


def _text(lines: DataFrame) -> str:
    return "\n".join(r["line"] for r in lines.orderBy("place").toLocalIterator())


def markdown_report(results: DataFrame, summary: DataFrame, cut: int = 50) -> str:
    return _text(markdown_lines(results, summary, cut))


def console_report(results: DataFrame, summary: DataFrame, cut: int = 45) -> str:
    return _text(console_lines(results, summary, cut))


def vector_dump(vectors: DataFrame, path: str, n: int = 20, key: str = "chunk_id") -> None:
    """The first n vectors by key."""
    vectors.orderBy(key).limit(n).write.mode("overwrite").parquet(path)


def numbered_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Every row with ``is_last``: whether it is the last of its key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("is_last", F.row_number().over(w) == 1)


def download(listing: DataFrame, fetch: Callable[[], Callable[[str], bytes]], store: Callable[[], Callable[[str, bytes | None], bool]]) -> DataFrame:
    """id, ok: files of a listing, fetched by the executors. ``store(name, None)`` tells whether a file is there already."""

    def run(frames: Iterator) -> Iterator:
        get, put = fetch(), store()
        for f in frames:
            ok = []
            for name in f["id"]:
                try:
                    ok.append(put(name, None) or put(name, get(name)))
                except Exception:  # a failed download is an answer, not an end
                    ok.append(False)
            yield f.assign(ok=ok)

    from .readers import base_id

    return listing.select(base_id(F.col("id")).alias("id")).distinct().mapInPandas(run, "id string, ok boolean")
