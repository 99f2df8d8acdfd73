"""Path and URL scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_path(path: Column) -> Column:
    """The path with forward slashes and without empty and `.` segments; null stays null.

    Only paths that need it pay for splitting.
    """
    slashed = F.translate(path, "\\", "/")
    clean = F.array_join(F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != ".")), "/")
    return F.when(path.rlike(r"\\|^/|//|/$|^$|(^|/)\.(/|$)"), clean).otherwise(path)
