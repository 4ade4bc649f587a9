"""Column names that a table does not use."""

from __future__ import annotations

from collections.abc import Iterable


def free(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each followed by as many underscores as set it apart from the columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
