"""Time expressions that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp, or of a zone-less one as if in UTC."""
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", origin, F.col(col))
    return F.unix_micros(col)
