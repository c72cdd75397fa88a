"""Entity decoding and NFC, the two text repairs Spark SQL has no function for."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = r"&[#A-Za-z]"
# Every character below U+0300 and in U+2002..U+20CF is its own NFC form and
# composes with nothing, so a text made of those alone needs no repair.
UNSTABLE = r"[^\x00-\u02ff\u2002-\u20cf]"


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def _unescape_nfc(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda t: unicodedata.normalize("NFC", html.unescape(t)), na_action="ignore"
    )


# Marked non-deterministic so that Catalyst keeps filters on the repaired text
# above the repair instead of copying the Python call below joins and shuffles.
_nfc = _nfc.asNondeterministic()
_unescape_nfc = _unescape_nfc.asNondeterministic()


def _only_where(needed: Column, repair, text: Column) -> Column:
    # Rows that need no repair cross to Python as nulls and keep the JVM string.
    return F.coalesce(repair(F.when(needed, text)), text)


def nfc(text: Column) -> Column:
    return _only_where(text.rlike(UNSTABLE), _nfc, text)


def unescape_nfc(text: Column) -> Column:
    return _only_where(text.rlike(ENTITY) | text.rlike(UNSTABLE), _unescape_nfc, text)
