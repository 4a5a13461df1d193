"""Date normalisation ``dd.mm.yyyy`` -> ``yyyyMMdd``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Input and output date layouts of the article pages.
DATE_IN = "d.M.yyyy"
DATE_OUT = "yyyyMMdd"


def normalise_date(d: Column) -> Column:
    """Null passes; an unparseable date becomes null (count it with ``malformed_date``)."""
    parsed = F.try_to_timestamp(F.trim(d), F.lit(DATE_IN))
    return F.date_format(parsed, DATE_OUT)


def malformed_date(d: Column) -> Column:
    return (d.isNotNull() & normalise_date(d).isNull()).cast("int")
