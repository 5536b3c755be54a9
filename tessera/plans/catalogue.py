"""The registered queries by name, with their SQL."""

from __future__ import annotations

from . import files, geometry, grids, learning, maps, more, numerics, spectral, vectors, volumes

_MODULES = (vectors, grids, learning, more, maps, geometry, volumes, spectral, numerics, files)
QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
FLAGSHIP = learning.quality_metrics
