"""Registered queries of the engine and the DuckDB SQL they are checked against."""

from __future__ import annotations

from tessera.plans import discovery, evidence, ingested, ingestion, reads, temporal  # noqa: F401  importing registers the queries
from tessera.plans.registry import ORACLES, QUERIES


def flagship(spark, sf_dir):
    """Orders within three discovered reference hops of region ASIA."""
    return reads.asia_orders(spark, sf_dir)


def queries():
    return QUERIES


def oracles():
    return ORACLES
