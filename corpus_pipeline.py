"""The corpus pipeline: STAGES over documents, each written as Parquet and reread by the next; see tidemark.llm.pipeline."""

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
