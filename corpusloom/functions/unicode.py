"""Unicode forms that Spark has no built-in for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(col: Column | str) -> Column:
    """The canonical composition of a string; null stays null."""
    return _nfc(col)


WHITE = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"


def strip(col: Column) -> Column:
    """Trim all Unicode white space, not spaces only."""
    return F.regexp_replace(col, WHITE, "")


def base_name(col: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(col, "/"), -1)


def file_key(col: Column) -> Column:
    """File identity: before the first ``#``, trimmed, after the last ``/``, composed; null stays null."""
    return nfc(base_name(strip(F.substring_index(col, "#", 1))))
