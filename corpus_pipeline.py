"""A training corpus from `documents`, stage by stage; the stages are in chronoloom.llm.pipeline."""

from __future__ import annotations

from chronoloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
