"""Instants as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(instant: Column) -> Column:
    """ISO 8601 in UTC with microseconds and offset; an instant without a zone counts as UTC."""
    return F.concat(F.date_format(instant.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
