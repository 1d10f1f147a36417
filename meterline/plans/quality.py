"""The sixteen assertions on the tables of a snapshot, and the gate over them.

Assertions that read the same table share one aggregation; every aggregation is partial before it is
shuffled. Each row carries its violation count; 0 passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.usage import VALID
from .models import one_row

# Id, name, severity of the assertions.
ASSERTIONS = {
    "A01": ("rep_id is unique", "block"),
    "A02": ("account_id is unique", "block"),
    "A03": ("contract_id is unique", "block"),
    "A04": ("log_id is unique", "block"),
    "A05": ("every account references a valid rep", "block"),
    "A06": ("every contract references a valid account", "block"),
    "A07": ("annual_commit_dollars is non-negative", "block"),
    "A08": ("included_monthly_credits is non-negative", "block"),
    "A09": ("contract end_date ≥ start_date", "block"),
    "A10": ("credits_consumed is non-negative", "block"),
    "A11": ("HealthScore within [0.40, 1.30]", "block"),
    "A12": ("cARR equals Committed_ARR × HealthScore", "block"),
    "A13": ("orphan rate below 5% of usage logs", "warn"),
    "A14": ("at least 50% of accounts have an active contract as of AS_OF_DATE", "warn"),
    "A15": ("shelfware rate within 5-25% band", "warn"),
    "A16": ("no rep concentrates > 30% of total cARR", "warn"),
}


def rows(frame: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """Unpivot named expressions of a one-row frame to (assertion_id, violations)."""
    lines = [
        F.struct(F.lit(k).alias("assertion_id"), v.cast("bigint").alias("violations")) for k, v in cells.items()
    ]
    return frame.select(F.inline(F.array(*lines)))


def duplicates(key: str) -> Column:
    """Rows beyond the distinct non-NULL keys, so NULL keys count as violations."""
    return F.count("*") - F.countDistinct(key)


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def violations(b) -> DataFrame:
    b = b.settled
    n = F.count("*")
    contracts = b.stg_contracts.agg(
        duplicates("contract_id").alias("A03"),
        F.count_if(F.col("annual_commit_dollars") < 0).alias("A07"),
        F.count_if(F.col("included_monthly_credits") < 0).alias("A08"),
        F.count_if(F.col("end_date") < F.col("start_date")).alias("A09"),
    )
    logs = one_row([b.log_facts.select("n", "n_negative"), b.log_ids]).select(
        (F.col("n") - F.col("n_ids")).alias("A04"), F.col("n_negative").alias("A10")
    )
    p = b.p
    bad_hs = (F.col("healthscore") < p.hs_floor) | (F.col("healthscore") > p.hs_cap + 1e-9)
    scores = b.metric_healthscore.agg(F.count_if(bad_hs).alias("A11"))
    off = F.abs(F.col("carr") - F.col("committed_arr").cast("double") * F.col("healthscore"))
    carr = b.metric_carr.agg(F.count_if(off > 1e-6).alias("A12"))
    usage = b.usage_daily.agg(
        F.sum("n_logs").alias("n"), F.sum(F.when(F.col("usage_class") != VALID, F.col("n_logs"))).alias("bad")
    )
    coverage = (
        b.sources["accounts"]
        .select("account_id", F.lit(1).alias("known"), F.lit(0).alias("active"))
        .unionByName(b.int_account_active_contracts.select("account_id", F.lit(0).alias("known"), F.lit(1).alias("active")))
        .agg(F.coalesce(F.sum("known"), F.lit(0)).alias("known"), F.coalesce(F.sum("active"), F.lit(0)).alias("active"))
    )
    mart = b.mart_carr_current.agg(n.alias("n"), F.count_if(F.col("band") == "at_risk_shelfware").alias("shelf"))
    reps = b.mart_carr_by_rep.agg(F.max("carr").alias("top"), F.sum("carr").alias("total"))
    shelf_share = F.col("shelf") / F.col("n")
    frames = [
        rows(b.stg_sales_reps.agg(duplicates("rep_id").alias("v")), {"A01": F.col("v")}),
        rows(b.stg_accounts.agg(duplicates("account_id").alias("v")), {"A02": F.col("v")}),
        rows(contracts, {k: F.col(k) for k in ("A03", "A07", "A08", "A09")}),
        rows(logs, {k: F.col(k) for k in ("A04", "A10")}),
        rows(b.orphan_accounts.agg(n.alias("v")), {"A05": F.col("v")}),
        rows(b.orphan_contracts.agg(n.alias("v")), {"A06": F.col("v")}),
        rows(scores, {"A11": F.col("A11")}),
        rows(carr, {"A12": F.col("A12")}),
        rows(usage, {"A13": flag((F.col("n") > 0) & (F.coalesce("bad", F.lit(0)) / F.col("n") > 0.05))}),
        rows(
            coverage,
            {"A14": F.when(F.col("known") == 0, 1).otherwise(flag(F.col("active") / F.col("known") < 0.50))},
        ),
        rows(mart, {"A15": F.when(F.col("n") == 0, 1).otherwise(flag(~shelf_share.between(0.05, 0.25)))}),
        rows(
            reps,
            {
                "A16": flag(
                    (F.col("total") != 0) & (F.col("top").cast("double") / F.col("total").cast("double") > 0.30)
                )
            },
        ),
    ]
    return reduce(DataFrame.unionByName, frames)


def dq_assertions(b) -> DataFrame:
    known = F.create_map(
        *[x for k, (name, sev) in ASSERTIONS.items()
          for x in (F.lit(k), F.struct(F.lit(name).alias("name"), F.lit(sev).alias("severity")))]
    )
    meta = F.element_at(known, F.col("assertion_id"))
    severity = meta["severity"]
    return violations(b).select(
        "assertion_id",
        meta["name"].alias("name"),
        severity.alias("severity"),
        "violations",
        F.when(F.col("violations") == 0, "pass").otherwise(severity).alias("status"),
    )


def dq_gate(b) -> DataFrame:
    """Pass, block and warn counts with the exit codes of a normal and of a strict run."""
    n = lambda s: F.count_if(F.col("status") == s)
    tally = dq_assertions(b).agg(n("pass").alias("n_pass"), n("block").alias("n_block"), n("warn").alias("n_warn"))
    return tally.select(
        "n_pass",
        "n_block",
        "n_warn",
        flag(F.col("n_block") > 0).alias("exit_code"),
        flag((F.col("n_block") > 0) | (F.col("n_warn") > 0)).alias("exit_code_strict"),
    )
