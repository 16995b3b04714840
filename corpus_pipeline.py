"""The corpus pipeline; its stages are in the subpackage of training-data operators."""

from parlance.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
