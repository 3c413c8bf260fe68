"""All registered queries with their SQL."""

from __future__ import annotations

from ..operators import algebra, codec, documents, fingerprints, graph, hologram, opq, phrases, residual, scores, spectral, state, telemetry

QUERIES = fingerprints.QUERIES | algebra.QUERIES | scores.QUERIES | codec.QUERIES | graph.QUERIES | hologram.QUERIES | opq.QUERIES | residual.QUERIES | spectral.QUERIES | documents.QUERIES | phrases.QUERIES | telemetry.QUERIES | state.QUERIES


def queries() -> dict:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql is not None}
