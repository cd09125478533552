"""Clock arithmetic that depends on no session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Seconds since 1970 on the timestamp's own clock, with its fraction."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    return days * 86400.0 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")
