"""The jobs as registered queries, and their DuckDB SQL."""

from __future__ import annotations

from inkfold.plans.fixtures import CHUNKS, words_sql
from inkfold.plans.retrieval_queries import sweep_sql

from . import ingest_documents, sweep_fusion

QUERIES = {f.__name__: f for f in (ingest_documents.job1_ingest_documents, sweep_fusion.job2_sweep_fusion)}
ORACLES = {
    "job1_ingest_documents": f"""WITH RECURSIVE {CHUNKS}, w AS (SELECT chunk_id, CAST(paper_id AS BIGINT) AS doc_id, content, {words_sql('content')} AS w FROM chunks)
SELECT chunk_id, doc_id, CAST(split_part(chunk_id, ':c', 2) AS INTEGER) AS "window", content, CAST(len(w) AS INTEGER) AS dl,
       CAST(len(list_distinct(w)) AS BIGINT) AS n_terms, CAST(len(w) AS BIGINT) AS n_counted FROM w""",
    "job2_sweep_fusion": sweep_sql(sweep_fusion.DEFAULTS["alphas"], sweep_fusion.DEFAULTS["k"], sweep_fusion.DEFAULTS["depth"]),
}
