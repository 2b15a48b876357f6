"""Every catalogue query by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from . import search, shapes, transfer

QUERIES = {**search.QUERIES, **shapes.QUERIES, **transfer.QUERIES}
ORACLES = {**search.ORACLES, **shapes.ORACLES, **transfer.ORACLES}
