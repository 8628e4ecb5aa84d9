"""Public holidays, one table for all that asks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public holidays of South Korea, January to March 2024.
HOLIDAYS = ("2024-01-01", "2024-02-09", "2024-02-10", "2024-02-11", "2024-02-12", "2024-03-01")
#: The same as days from 1970.
HOLIDAY_NUMBERS = tuple((date.fromisoformat(d) - date(1970, 1, 1)).days for d in HOLIDAYS)
IN_HOLIDAYS = "IN ({})".format(", ".join(f"DATE '{d}'" for d in HOLIDAYS))


def is_holiday(day: Column) -> Column:
    return day.isin(*[F.to_date(F.lit(d)) for d in HOLIDAYS])
