"""The corpus pipeline (see ``millrace.llm.pipeline``): STAGES, run and ORACLE_SQL."""

from millrace.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
