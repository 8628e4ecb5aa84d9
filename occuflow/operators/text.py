"""Names and addresses in one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(c: Column | str) -> Column:
    """Lower case, without what is in parentheses and without anything but letters and digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\([^)]*\)", ""), "[^a-z0-9]+", "")
