"""Every query of the library by name, with the SQL it is held against."""

from __future__ import annotations

from tilth.plans import crops, field, flights, ground, messages, readings, satellite, store, streams

FLAGSHIP = "climatology"
_PARTS = (satellite, field, messages, flights, readings, store, ground, crops, streams)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
