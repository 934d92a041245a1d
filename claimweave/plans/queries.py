"""All queries of the engine's own operators."""

from __future__ import annotations

from claimweave.plans import aggregates, boundary, clusters, filters, joins, registry, scans, texts  # noqa: F401

scans.register_sinks()


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
