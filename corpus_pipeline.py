"""The corpus pipeline: STAGES, run() and ORACLE_SQL of tidebook.llm.pipeline."""

from tidebook.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
