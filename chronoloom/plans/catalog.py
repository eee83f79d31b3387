"""Every query of the library, by name, with its SQL."""

from __future__ import annotations

from . import define, q_batch, q_edges, q_model, q_partition, q_sampling, q_sources, q_stats, q_windows  # noqa: F401  each module registers its queries


def queries():
    return dict(define.QUERIES)


def oracle_sql():
    return dict(define.ORACLES)
