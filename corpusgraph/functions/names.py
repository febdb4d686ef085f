"""Name keys: three different ones, each native on ASCII and by Unicode rules otherwise."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _normal(x: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).casefold().strip())


@F.pandas_udf(T.StringType())
def _normal_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _normal(x))


@F.pandas_udf(T.StringType())
def _compact_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else re.sub(r"\s+", "", x).casefold())


def _ascii(name: Column) -> Column:
    return F.rlike(name, F.lit(r"^[\x00-\x1b\x20-\x7f]*$"))


def normalize_name(name: Column) -> Column:
    """NFKC, case folding, outer white space gone, inner runs one space."""
    return F.when(_ascii(name), F.trim(F.regexp_replace(F.lower(name), r"[\x09-\x0D\x20]+", " "))).otherwise(_normal_udf(F.when(~_ascii(name), name)))


def reference_key(name: Column) -> Column:
    """normalize_name without any white space."""
    return F.regexp_replace(normalize_name(name), r"(?U)\s+", "")


def compact(name: Column) -> Column:
    """White space gone, then case folding, without NFKC: the key of duplicates in one chunk."""
    return F.when(_ascii(name), F.lower(F.regexp_replace(name, r"[\x09-\x0D\x20]+", ""))).otherwise(_compact_udf(F.when(~_ascii(name), name)))


def ascii_normalize(name: Column) -> Column:
    """normalize_name for names known to be ASCII, without a Python branch in the plan."""
    return F.trim(F.regexp_replace(F.lower(name), r"[\x09-\x0D\x20]+", " "))


def ascii_reference(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[\x09-\x0D\x20]+", "")


def rejection_category(message: Column) -> Column:
    """Class of a rejection message; the first rule that holds decides."""
    has = lambda x: F.contains(message, F.lit(x))
    starts = lambda x: F.startswith(message, F.lit(x))
    return (
        F.when(starts("endpoint unresolved"), "unresolved_endpoint")
        .when(starts("verdict insufficient"), "insufficient")
        .when(starts("verdict contradicts"), "contradicted")
        .when(has("passage_ids"), "invalid_passage")
        .when(has("over limit"), "limit")
        .when(starts("entity[") | starts("claim["), "invalid_extraction")
        .otherwise("other")
    )
