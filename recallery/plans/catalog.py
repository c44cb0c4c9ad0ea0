"""Every registered query of the engine's own operators, with its SQL twin."""

from __future__ import annotations

from . import alike, answers, care, code, extra, more, network, retrieval, search, threats, training, upkeep  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
