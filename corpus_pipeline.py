"""The corpus pipeline at the repository's top: see ``triagelake.llm.pipeline``."""

from triagelake.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
