"""Keys and values as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8(x: Column) -> Column:
    """Bytes as text; null where they are no valid UTF-8."""
    return F.try_validate_utf8(x.cast("string"))
