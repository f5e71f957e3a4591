"""All named queries and their check SQL."""

from __future__ import annotations

from . import catalog, extraction, purifying, reading, searching, segments, shelving, streams

MODULES = (catalog, extraction, searching, reading, segments, purifying, shelving, streams)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
