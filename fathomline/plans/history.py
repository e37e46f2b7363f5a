"""Queries of the attribute history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import history
from fathomline.session import read

#: The moment of the ``p2_as_of`` report: 2026-01-01 UTC in microseconds.
AS_OF_US = 1_767_225_600_000_000


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.validity(read(spark, sf_dir, "profile")).select(
        F.col("entity").alias("user_id"), F.col("attribute").alias("field"), "valid_from_us", "valid_to_us"
    )


def p2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.validity(read(spark, sf_dir, "profile")).select(
        F.col("entity").alias("user_id"), F.col("attribute").alias("field"), "value", "valid_from_us", "valid_to_us"
    )


def p2_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.as_of(read(spark, sf_dir, "profile"), AS_OF_US).select(
        F.col("entity").alias("user_id"), F.col("attribute").alias("field"), "value", "since_us"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_history, p2_as_of)
}

_SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def _fold(column: str) -> str:
    return (
        f"lower(regexp_replace(regexp_replace({column}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'), '[{_SPACE}]+', ' ', 'g'))"
    )


_VERSIONS = f"""
WITH said AS (
  SELECT {_fold("user_id")} AS user_id, {_fold("field")} AS field, {_fold("value")} AS value,
         epoch_us(created_at) AS ts, id
  FROM profile WHERE created_at IS NOT NULL AND regexp_matches(value, '[^{_SPACE}\\x{{200B}}\\x{{FEFF}}]')
),
moments AS (
  SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY user_id, field, ts ORDER BY id DESC) = 1
),
changes AS (
  SELECT * FROM moments
  QUALIFY coalesce(lag(value) OVER (PARTITION BY user_id, field ORDER BY ts) <> value, true)
),
versions AS (
  SELECT user_id, field, value, ts AS valid_from_us,
         coalesce(lead(ts) OVER (PARTITION BY user_id, field ORDER BY ts), -1) AS valid_to_us
  FROM changes
)"""
ORACLE: dict[str, str] = {
    "p2_found": f"{_VERSIONS} SELECT user_id, field, valid_from_us, valid_to_us FROM versions",
    "p2_history": f"{_VERSIONS} SELECT * FROM versions",
    "p2_as_of": f"""{_VERSIONS}
SELECT user_id, field, value, valid_from_us AS since_us FROM versions
WHERE valid_from_us <= {AS_OF_US} AND (valid_to_us > {AS_OF_US} OR valid_to_us = -1)""",
}
