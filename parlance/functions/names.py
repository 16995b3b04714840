"""Names of characters, which only Python knows; used on counted rows."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def name_of(emoji: str | None) -> str | None:
    """The name of the first code point that has one."""
    return next((n for n in (unicodedata.name(c, None) for c in emoji or "") if n), None)


@F.pandas_udf(StringType())
def emoji_name(x: pd.Series) -> pd.Series:
    return x.map(name_of)
