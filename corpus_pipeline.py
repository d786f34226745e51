"""A corpus pipeline: language ID, line dedup, n-gram Jaccard join, decontamination, packing."""

from __future__ import annotations

from tilth.llm.pipeline import STAGES, run

#: The language and packing stages have no SQL form.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
