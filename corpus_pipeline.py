"""A corpus pipeline over `documents`."""

from veilmap.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
