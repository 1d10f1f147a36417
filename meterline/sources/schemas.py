"""Declared schemas of the four source tables and of the result tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _schema(*cols: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


SALES_REPS = _schema(
    ("rep_id", T.StringType(), False),
    ("name", T.StringType(), False),
    ("region", T.StringType(), False),
    ("segment", T.StringType(), False),
)
ACCOUNTS = _schema(
    ("account_id", T.StringType(), False),
    ("company_name", T.StringType(), False),
    ("industry", T.StringType(), False),
    ("rep_id", T.StringType(), False),
)
CONTRACTS = _schema(
    ("contract_id", T.StringType(), False),
    ("account_id", T.StringType(), False),
    ("start_date", T.DateType(), False),
    ("end_date", T.DateType(), False),
    ("annual_commit_dollars", MONEY, False),
    ("included_monthly_compute_credits", T.LongType(), False),
)
DAILY_USAGE_LOGS = _schema(
    ("log_id", T.StringType(), False),
    ("account_id", T.StringType(), True),
    ("date", T.DateType(), False),
    ("compute_credits_consumed", MONEY, False),
)
ACCOUNT_ARCHETYPES = _schema(
    ("account_id", T.StringType(), False),
    ("archetype", T.StringType(), False),
)

SOURCES: dict[str, T.StructType] = {
    "sales_reps": SALES_REPS,
    "accounts": ACCOUNTS,
    "contracts": CONTRACTS,
    "daily_usage_logs": DAILY_USAGE_LOGS,
}

ASSERTION_RESULTS = _schema(
    ("run_id", T.StringType(), False),
    ("run_ts", T.TimestampType(), False),
    ("assertion_id", T.StringType(), False),
    ("severity", T.StringType(), False),
    ("status", T.StringType(), False),
    ("observed_value", T.StringType(), True),
    ("threshold", T.StringType(), True),
    ("rows_affected", T.LongType(), True),
    ("owning_team", T.StringType(), True),
)
EVAL_RESULTS = _schema(
    ("run_id", T.StringType(), False),
    ("run_ts", T.TimestampType(), False),
    ("test_id", T.StringType(), False),
    ("tier", T.StringType(), False),
    ("status", T.StringType(), False),
    ("observed", T.StringType(), True),
    ("threshold", T.StringType(), True),
    ("commit_sha", T.StringType(), True),
)
RESTATEMENTS = _schema(
    ("as_of_month", T.DateType(), False),
    ("account_id", T.StringType(), False),
    ("old_value", T.DoubleType(), True),
    ("new_value", T.DoubleType(), True),
    ("delta", T.DoubleType(), False),
    ("needs_restatement", T.BooleanType(), True),
    ("rationale", T.StringType(), True),
    ("approvers", T.StringType(), True),
    ("changelog_link", T.StringType(), True),
)
ROW_COUNTS = _schema(
    ("run_id", T.StringType(), False),
    ("run_ts", T.TimestampType(), True),
    ("table_name", T.StringType(), False),
    ("n_rows", T.LongType(), False),
)

# Columns that people type.
FREE_TEXT = ("name", "company_name")

# Enumerations of the mapped fixture. Open strings in the data, checked by the quality plans.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
SEGMENTS = ["Enterprise", "Mid-Market"]
INDUSTRIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
