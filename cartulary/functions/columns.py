"""Names for columns that an operator adds for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(name: str, *frames: DataFrame) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
