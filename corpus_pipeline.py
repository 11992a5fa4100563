"""The corpus pipeline's stages, their run and its SQL, from the corpus operators."""

from termweave.llm.pipeline import ORACLE_SQL, STAGES, encode_stage, line_stage, materialize, mix_stage, near_duplicate_stage, quality_stage, run

__all__ = ["ORACLE_SQL", "STAGES", "encode_stage", "line_stage", "materialize", "mix_stage", "near_duplicate_stage", "quality_stage", "run"]
