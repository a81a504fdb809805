"""Names of helper columns that a caller's columns can't clash with."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put in front until none of them is a column of the frame (without regard to case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def refuse(df: DataFrame, *new: str) -> None:
    """Raises where an output column would stand beside one of the same name."""
    clash = {c.lower() for c in df.columns} & {n.lower() for n in new}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are already there")
