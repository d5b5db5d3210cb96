"""The corpus pipeline: documents through the training-data operators, stage by stage; see ``webloom.llm.pipeline``."""

from webloom.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
