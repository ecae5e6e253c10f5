"""All queries of the engine's own operators, with the SQL that must give the same rows."""

from __future__ import annotations

from lexloom.plans import q_analysis, q_models, q_text

PARTS = [q_text, q_analysis, q_models]
QUERIES = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLES = {k: v for part in PARTS for k, v in part.ORACLES.items()}
