"""All registered queries outside the training-data subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from taxolyte.plans import graphs, hypotheses, jobs, merges, pairs, texts

_ALL = {**jobs.QUERIES, **texts.QUERIES, **graphs.QUERIES, **pairs.QUERIES, **hypotheses.QUERIES, **merges.QUERIES}

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
