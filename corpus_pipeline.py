"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, then packing; see logfold.llm.pipeline."""

from logfold.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
