"""Small fixed tables inside column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_table(values) -> Column:
    """An array literal of doubles; Catalyst folds it to one constant."""
    return F.split(F.lit(" ".join(repr(float(v)) for v in values)), " ").cast("array<double>")
