"""A corpus pipeline of five stages, each over all that its predecessor kept."""

from __future__ import annotations

from mainspring.llm.stages import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: SQL can express neither the classifier nor SimHash; the tests hold run() against brute force.
ORACLE_SQL = None
