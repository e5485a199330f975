"""Imports the queries, which registers them, and the pipeline."""

import corpus_pipeline
from quillgraph.llm import queries  # noqa: F401
from quillgraph.llm.registry import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
