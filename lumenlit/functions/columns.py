"""Small helpers on column names."""

from __future__ import annotations

from collections.abc import Iterable


def unused(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until no column has it (case is ignored, as Spark does)."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name = "_" + name
    return name
