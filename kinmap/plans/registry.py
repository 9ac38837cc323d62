"""All registered queries of the alignment engine."""

from __future__ import annotations

from kinmap.plans import queries_files, queries_graph, queries_more, queries_pairs, queries_sparse, queries_text, queries_train

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (queries_sparse, queries_pairs, queries_graph, queries_more, queries_text, queries_files, queries_train):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
