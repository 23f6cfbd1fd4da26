"""A corpus pipeline of five stages over ``documents``; the stages are in ``lacuna.llm.pipeline``, which ships with the package."""

from lacuna.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
