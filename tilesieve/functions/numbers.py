"""Text forms of numbers (FN-24, FN-25)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def significant(column: Column, digits: int) -> Column:
    """A double with so many significant digits, as C's ``%g`` prints it; NA for null.

    Spark's ``format_string`` pads and never drops the exponent form's zeros, so
    the text is made in Arrow batches; only audits use it.
    """

    @F.pandas_udf(T.StringType())
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: "NA" if pd.isna(v) else f"{v:.{digits}g}")

    return text(column.cast("double"))


def with_commas(value: float | int) -> str:
    return f"{value:,}" if isinstance(value, int) else f"{value:,.2f}"


def duration(seconds: float) -> str:
    """Hours, minutes and seconds, as many of them as it takes."""
    minutes, rest = divmod(max(0, round(seconds)), 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours}h{minutes:02d}m{rest:02d}s" if hours else f"{minutes}m{rest:02d}s" if minutes else f"{rest}s"
