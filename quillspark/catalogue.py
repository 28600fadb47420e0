"""All registered queries of the engine's own operators and their SQL, by name."""

from __future__ import annotations

from quillspark.plans import audit, code, corpus, curation, evaluation, graphs, hidden, history, intake, planted, poisoned, relations, scanning, selection, training

PARTS = (scanning, evaluation, curation, audit, graphs, history, selection, corpus, code, hidden, training, relations, intake, planted, poisoned)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in PARTS for name, sql in part.SQL.items()}
