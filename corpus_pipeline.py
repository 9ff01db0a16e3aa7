"""The corpus pipeline: quality classifier, near-dedup, suffix dedup, mixing, BPE (:mod:`condmon.llm.stages`)."""

from condmon.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
