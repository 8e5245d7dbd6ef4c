"""Guards that operators share. The checks that need data run one small aggregate job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"repeated {', '.join(keys)}")
    return df


def assert_no_conflict(df: DataFrame, key: str, *values: str) -> DataFrame:
    """One combination of values at most for each key."""
    clash = df.groupBy(key).agg(F.countDistinct(F.struct(*values)).alias("n")).where("n > 1")
    if clash.limit(1).count():
        raise ValueError(f"conflicting {', '.join(values)} for one {key}")
    return df


def assert_none(df: DataFrame, what: str) -> None:
    if df.limit(1).count():
        raise ValueError(what)
