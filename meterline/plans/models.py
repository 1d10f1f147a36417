"""The thirteen tables of a snapshot: staging, intermediate, metric, mart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.edges import CARR_SUM, carr_sum
from ..operators import usage as U
from ..operators.skew import salted_join
from ..params import Params
from ..sources import schemas

# The tables in the order in which they depend on each other.
TABLES = [
    "stg_sales_reps",
    "stg_accounts",
    "stg_contracts",
    "stg_daily_usage_logs",
    "int_orphan_usage",
    "int_account_active_contracts",
    "int_usage_rolled",
    "metric_healthscore",
    "metric_carr",
    "mart_carr_current",
    "mart_carr_by_rep",
    "mart_carr_by_region",
    "mart_dq_summary",
]
# Roll-ups that several tables and reports read; written along with the tables.
SHARED = ["usage_daily", "active_usage"]
# A shared roll-up is written right after the table it belongs to.
WRITE_ORDER = [t for name in TABLES for t in (name, *{"int_orphan_usage": SHARED[:1], "int_account_active_contracts": SHARED[1:]}.get(name, []))]


# ---- staging ----


def canonical(column: str, values: list[str]) -> Column:
    """Trimmed, and in the known spelling if it differs from a known value in case only."""
    text = F.trim(F.col(column).cast("string"))
    known = F.create_map(*[F.lit(x) for v in values for x in (v.lower(), v)])
    return F.coalesce(F.try_element_at(known, F.lower(text)), text)


def stg_sales_reps(reps: DataFrame) -> DataFrame:
    return reps.select(
        F.col("rep_id").cast("string").alias("rep_id"),
        F.trim(F.col("name").cast("string")).alias("rep_name"),
        canonical("region", schemas.REGIONS).alias("region"),
        canonical("segment", schemas.SEGMENTS).alias("segment"),
    )


def stg_accounts(accounts: DataFrame, reps: DataFrame, p: Params) -> DataFrame:
    """Accounts with the region and segment of their rep. One rep may own a third of all accounts."""
    placed = salted_join(
        accounts, reps.select("rep_id", "region", "segment"), ["rep_id"], ["account_id"], p.skew_salts
    )
    return placed.select(
        "account_id",
        F.trim("company_name").alias("company_name"),
        canonical("industry", schemas.INDUSTRIES).alias("industry"),
        "rep_id",
        "region",
        "segment",
    )


def stg_contracts(contracts: DataFrame, p: Params) -> DataFrame:
    t = F.lit(p.as_of)
    start, end = F.col("start_date").cast("date"), F.col("end_date").cast("date")
    return contracts.select(
        "contract_id",
        "account_id",
        start.alias("start_date"),
        end.alias("end_date"),
        F.col("annual_commit_dollars").cast("decimal(18,2)").alias("annual_commit_dollars"),
        F.col("included_monthly_compute_credits").cast("bigint").alias("included_monthly_credits"),
        ((start <= t) & (t <= end)).alias("is_active_as_of"),
        F.datediff(t, start).cast("bigint").alias("contract_age_days"),
    )


def stg_daily_usage_logs(logs: DataFrame) -> DataFrame:
    return logs.select(
        "log_id",
        "account_id",
        F.col("date").cast("date").alias("usage_date"),
        F.col("compute_credits_consumed").cast("decimal(18,2)").alias("credits_consumed"),
    )


# ---- intermediate ----


def int_orphan_usage(logs: DataFrame, spans: DataFrame, p: Params) -> DataFrame:
    """Every log with its class. Logs of one account are spread over salts for the lookup."""
    looked_up = salted_join(logs, spans, ["account_id"], ["log_id"], p.skew_salts)
    return looked_up.select(*logs.columns, U.usage_class().alias("usage_class"))


def int_account_active_contracts(contracts: DataFrame, p: Params) -> DataFrame:
    """Active contracts of an account add up."""
    return (
        contracts.where("is_active_as_of")
        .groupBy("account_id")
        .agg(
            F.count("*").alias("n_active_contracts"),
            F.sum("annual_commit_dollars").alias("active_committed_arr"),
            F.sum("included_monthly_credits").alias("included_monthly_credits"),
            F.min("start_date").alias("oldest_active_start"),
        )
        .withColumn("contract_age_days", F.datediff(F.lit(p.as_of), F.col("oldest_active_start")).cast("bigint"))
    )


def active_usage(active: DataFrame, valid_daily: DataFrame, p: Params) -> DataFrame:
    """Active accounts with their window usage and ratios; the shared input of the three tables below."""
    joined = active.join(U.window_totals(valid_daily, p), "account_id", "left")
    zero = F.lit(0).cast("decimal(28,2)")
    c90 = F.coalesce(F.col("credits_90d"), zero)
    m1 = F.coalesce(F.col("credits_month_1"), zero)
    return joined.select(
        *active.columns,
        c90.alias("credits_90d"),
        m1.alias("credits_month_1"),
        (F.col("included_monthly_credits") * 3).alias("expected_credits_90d"),
        S.utilization(c90, F.col("included_monthly_credits")).alias("utilization_u"),
        S.share(m1, c90).alias("m1_share"),
    )


def int_usage_rolled(active_usage: DataFrame) -> DataFrame:
    return active_usage.select(
        "account_id", "credits_90d", "credits_month_1", "expected_credits_90d", "utilization_u", "m1_share"
    )


# ---- metric ----


def scored(df: DataFrame, p: Params) -> DataFrame:
    """Adds base_score, modifier and healthscore to a frame with u, m1, age and contract count."""
    u = F.col("utilization_u")
    spike = S.is_spike(F.col("m1_share"), F.col("contract_age_days"), p)
    expanding = S.is_expanding(F.col("n_active_contracts"), u, p)
    return (
        df.withColumn("base_score", S.base_score(u, p))
        .withColumn("modifier", S.modifier(spike, expanding, p))
        .withColumn("healthscore", S.healthscore(F.col("base_score"), F.col("modifier"), p))
    )


def metric_healthscore(active_usage: DataFrame, accounts: DataFrame, p: Params) -> DataFrame:
    return (
        scored(active_usage, p)
        .join(accounts.select("account_id", "segment"), "account_id", "left")
        .select(
            "account_id",
            "segment",
            "contract_age_days",
            "n_active_contracts",
            "utilization_u",
            "m1_share",
            "credits_90d",
            "expected_credits_90d",
            "base_score",
            "modifier",
            "healthscore",
        )
    )


def metric_carr(active_usage: DataFrame, accounts: DataFrame, p: Params) -> DataFrame:
    """Accounts that are not in the account table drop out here."""
    return (
        scored(active_usage, p)
        .join(accounts.drop("company_name"), "account_id")
        .select(
            "account_id",
            "rep_id",
            "region",
            "segment",
            "industry",
            "n_active_contracts",
            F.col("active_committed_arr").alias("committed_arr"),
            "utilization_u",
            "m1_share",
            "base_score",
            "modifier",
            "healthscore",
            (F.col("active_committed_arr").cast("double") * F.col("healthscore")).alias("carr"),
            "contract_age_days",
            "oldest_active_start",
            F.lit(p.as_of).alias("as_of_date"),
        )
    )


# ---- mart ----


def with_band(df: DataFrame, p: Params) -> DataFrame:
    cols = [F.col(c) for c in ("healthscore", "m1_share", "contract_age_days", "n_active_contracts", "utilization_u")]
    return df.withColumn("band", S.band(*cols, p))


def mart_carr_current(carr: DataFrame, p: Params) -> DataFrame:
    return with_band(carr, p)


def weighted_hs() -> Column:
    """Ratio of the summed columns carr and committed_arr."""
    return F.when(
        F.col("committed_arr") > 0, F.col("carr").cast("double") / F.col("committed_arr").cast("double")
    ).alias("weighted_healthscore")


def n_band(name: str) -> Column:
    return F.count_if(F.col("band") == name)


def sums() -> list[Column]:
    return [
        F.count("account_id").alias("n_accounts"),
        F.sum("committed_arr").alias("committed_arr"),
        carr_sum().alias("carr"),
    ]


def mart_carr_by_rep(reps: DataFrame, current: DataFrame) -> DataFrame:
    """Summed per rep before the join, so a rep with very many accounts is one row when it is shuffled."""
    counts = {"n_at_risk": "at_risk_shelfware", "n_spike_drop": "spike_drop", "n_expansion": "expansion",
              "n_overage": "overage"}
    per_rep = current.groupBy("rep_id").agg(*sums(), *[n_band(b).alias(n) for n, b in counts.items()])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return reps.join(per_rep, "rep_id", "left").select(
        "rep_id",
        "rep_name",
        "region",
        "segment",
        zero("n_accounts"),
        "committed_arr",
        "carr",
        weighted_hs(),
        *[zero(n) for n in counts],
    )


def mart_carr_by_region(current: DataFrame) -> DataFrame:
    return (
        current.groupBy("region", "segment")
        .agg(*sums(), n_band("at_risk_shelfware").alias("n_at_risk"))
        .select("region", "segment", "n_accounts", "committed_arr", "carr", weighted_hs(), "n_at_risk")
        .orderBy(F.col("carr").desc(), "region", "segment")
    )


def one_row(frames: list[DataFrame]) -> DataFrame:
    """Merge one-row frames with distinct columns into a single row, without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def mart_dq_summary(
    sources: dict[str, DataFrame], usage_daily: DataFrame, active: DataFrame, current: DataFrame, p: Params
) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias(name))
    n_class = lambda c: F.coalesce(F.sum(F.when(F.col("usage_class") == c, F.col("n_logs"))), F.lit(0))
    logs = usage_daily.agg(
        F.coalesce(F.sum("n_logs"), F.lit(0)).alias("n_usage_logs"),
        n_class(U.BAD_ACCOUNT).alias("n_orphan_bad_account"),
        n_class(U.OUT_OF_WINDOW).alias("n_orphan_out_of_window"),
        F.sum(F.when(F.col("usage_class") != U.VALID, F.col("credits_consumed"))).alias("orphan_credits_total"),
    )
    mart = current.agg(
        F.count("*").alias("n_accounts_in_metric"),
        n_band("at_risk_shelfware").alias("n_shelfware"),
        *[n_band(b).alias(f"n_{b}") for b in ("spike_drop", "expansion", "overage", "healthy")],
        F.sum("committed_arr").alias("total_committed_arr"),
        F.sum(F.col("carr").cast(CARR_SUM)).alias("total_carr"),
    )
    row = one_row(
        [
            count(sources["sales_reps"], "n_reps"),
            count(sources["accounts"], "n_accounts"),
            count(sources["contracts"], "n_contracts"),
            count(active, "n_accounts_with_active_contract"),
            logs,
            mart,
        ]
    )
    ratio = F.when(
        F.col("total_committed_arr") > 0,
        F.col("total_carr").cast("double") / F.col("total_committed_arr").cast("double"),
    )
    return row.select(
        "n_reps",
        "n_accounts",
        "n_contracts",
        "n_usage_logs",
        "n_accounts_with_active_contract",
        "n_accounts_in_metric",
        "n_orphan_bad_account",
        "n_orphan_out_of_window",
        "orphan_credits_total",
        "n_shelfware",
        "n_spike_drop",
        "n_expansion",
        "n_overage",
        "n_healthy",
        "total_committed_arr",
        "total_carr",
        ratio.alias("weighted_healthscore"),
        F.lit(p.as_of).alias("as_of_date"),
    )
