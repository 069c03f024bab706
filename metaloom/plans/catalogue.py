"""Imports every operator module, so that the registry is complete."""

from metaloom.operators import code, docs, graph, incremental, index, inference, merkle, names, queries, search, service, stats, telemetry, traverse, vectors  # noqa: F401
from metaloom.operators.registry import QUERIES, SQL
from metaloom.sources import containers, metadata_xml, pages  # noqa: F401
from metaloom.streaming import events  # noqa: F401

__all__ = ["QUERIES", "SQL"]
