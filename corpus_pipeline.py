"""The corpus pipeline: quality rules, near copies, secrets, mixture, tokens (see tessera/llm/pipeline.py)."""

from __future__ import annotations

from tessera.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
