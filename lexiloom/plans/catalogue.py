"""The registered queries of the library and their independent DuckDB SQL."""

from __future__ import annotations

from lexiloom.plans import alignment, cascade, corpus, enrichment, graph, identifiers, layout, matching, questions, rdf, references, retrieval, tables, topicflow, topics  # noqa: F401
from lexiloom.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
