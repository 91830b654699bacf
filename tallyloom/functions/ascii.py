"""ASCII-only text functions on columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other character stays (``lower`` would fold all of Unicode)."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
