"""A corpus cleaned and packed by five stages: language ID, near-dedup, decontamination, personal data, packing."""

from __future__ import annotations

from lanewright.llm.pipeline import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: Trained profiles and near-duplicate classes have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None
