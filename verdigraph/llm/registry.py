"""Queries and SQL of the text operators and of the pipeline, for the driver's entry."""

from __future__ import annotations

import corpus_pipeline

from . import queries

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLES = dict(queries.ORACLES)
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
