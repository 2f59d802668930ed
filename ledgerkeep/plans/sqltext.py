"""Shared SQL fragments of the oracles."""

from __future__ import annotations


def with_sql(*parts: str) -> str:
    """Common table expressions followed by the final select."""
    *ctes, final = [p.strip() for p in parts]
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + final
