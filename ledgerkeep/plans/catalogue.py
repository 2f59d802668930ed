"""Imports every query module, so that the registry is complete."""

from __future__ import annotations

from ledgerkeep.plans import QUERIES, SQL
from ledgerkeep.plans import answers, knowledge, learning, retention, search, streams  # noqa: F401

__all__ = ["QUERIES", "SQL"]
