"""Text and path functions that Spark has no builtin for, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _nfc(s):
    return s if s is None or s.isascii() else unicodedata.normalize("NFC", s)


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition (null stays null)."""
    return s.map(_nfc, na_action="ignore")


def _fold(p: str) -> str:
    p = p.replace("\\", "/")
    return p.lower() if p.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", p).lower())


@F.pandas_udf(T.StringType())
def fold_path(s: pd.Series) -> pd.Series:
    """A path apart from letter case, separator and canonical Unicode form."""
    return s.map(_fold, na_action="ignore")
