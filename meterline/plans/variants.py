"""Labels from raw data, and the reading of the metric that works day by day and contract by contract."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.edges import publish_early
from ..operators import intervals as I
from ..operators import ordered as O
from ..operators.skew import salted_join
from ..operators.usage import reconcile
from .history import active_days
from .models import one_row


def rule_archetype(b) -> DataFrame:
    """Label per account by definition: no logs, front-loaded use, use over the included credits, else normal."""
    p = b.p
    seen = b.usage_rollup.select("account_id").distinct().withColumn("has_logs", F.lit(True))
    active = b.active_usage.select(
        "account_id", "credits_90d", "expected_credits_90d", "m1_share", "contract_age_days"
    )
    over = F.col("credits_90d") >= F.col("expected_credits_90d") * F.lit(p.overage_label_ratio).cast("decimal(4,2)")
    label = (
        F.when(F.col("has_logs").isNull(), "shelfware")
        .when(S.is_spike(F.col("m1_share"), F.col("contract_age_days"), p), "spike_drop")
        .when(over & (F.col("expected_credits_90d") > 0), "overage")
        .otherwise("normal")
    )
    return (
        b.sources["accounts"]
        .select("account_id")
        .join(seen, "account_id", "left")
        .join(active, "account_id", "left")
        .select("account_id", label.alias("archetype"))
    )


def archetype_counts(b) -> DataFrame:
    return b.rule_archetype.groupBy("archetype").agg(F.count("*").alias("n_accounts"))


# ---- usage inside a contract ----


def covered_account_days(b) -> DataFrame:
    """Account-days of usage that fall inside at least one contract of a known account.

    Usage days and contract changes form one stream per account; a usage day is covered while the running
    number of contracts is positive. No usage row is compared with a contract row.
    """
    deltas = I.daily_deltas(b.stg_contracts).select("account_id", "day", "d_n", F.lit(False).alias("used"))
    used = b.usage_rollup.where(F.col("account_id").isNotNull()).select(
        "account_id", F.col("usage_date").alias("day"), F.lit(0).cast("bigint").alias("d_n"), F.lit(True).alias("used")
    )
    line = W.partitionBy("account_id").orderBy(I.daynum("day")).rangeBetween(W.unboundedPreceding, 0)
    return (
        deltas.unionByName(used)
        .withColumn("n_active", F.sum("d_n").over(line))
        .where("used AND n_active > 0")
        .join(b.sources["accounts"].select("account_id"), "account_id", "left_semi")
        .select("account_id", F.col("day").alias("usage_date"))
    )


def clean_daily(b) -> DataFrame:
    return b.usage_rollup.join(b.covered_days, ["account_id", "usage_date"])


def join_semi_range_usage_contract(b) -> DataFrame:
    """Logs of known accounts dated inside some contract. (account, day) is a fine key, so nothing is salted."""
    return b.stg_daily_usage_logs.join(b.covered_days, ["account_id", "usage_date"], "left_semi")


def split_clean_orphan(b) -> DataFrame:
    """Every log once, tagged clean or orphan; writers filter the tag into the two tables."""
    covered = b.covered_days.withColumn("_covered", F.lit(True))
    tagged = b.stg_daily_usage_logs.join(covered, ["account_id", "usage_date"], "left")
    side = F.when(F.col("_covered"), "clean").otherwise("orphan")
    return tagged.withColumn("side", side).drop("_covered")


# ---- the day-by-day reading of the score ----


def spec_included_90d(b) -> DataFrame:
    """Included credits summed over the days of the window, per contract in closed form, then per account."""
    p = b.p
    first = F.date_add(F.lit(p.window_start), 1)
    days = F.datediff(F.least(F.col("end_date"), F.lit(p.as_of)), F.greatest(F.col("start_date"), first)) + 1
    touching = b.stg_contracts.where(
        (F.col("end_date") >= first) & (F.col("start_date") <= F.lit(p.as_of)) & (F.col("end_date") >= F.col("start_date"))
    )
    return touching.groupBy("account_id").agg(
        (F.sum(days.cast("bigint") * F.col("included_monthly_credits")).cast("double") / 30.0).alias("included_90d")
    )


def oldest_contract(b) -> DataFrame:
    """The oldest active contract per account; ties go to the smallest id."""
    return (
        b.stg_contracts.where("is_active_as_of")
        .groupBy("account_id")
        .agg(F.min(F.struct("start_date", "contract_id")).alias("c"))
        .select("account_id", F.col("c.start_date").alias("oldest_start"), F.col("c.contract_id").alias("oldest_id"))
    )


def spec_m1_share(b) -> DataFrame:
    """Share of the window's clean credits that fall in the first 30 days of the oldest active contract."""
    p = b.p
    window = b.clean_daily.where(
        (F.col("usage_date") > F.lit(p.window_start)) & (F.col("usage_date") <= F.lit(p.as_of))
    )
    early = F.col("usage_date").between(F.col("oldest_start"), F.date_add("oldest_start", p.m1_days - 1))
    credits = F.col("credits_consumed")
    used = window.join(oldest_contract(b), "account_id").groupBy("account_id").agg(
        F.sum(credits).alias("credits_90d"), F.sum(F.when(early, credits).otherwise(0)).alias("credits_month_1")
    )
    joined = oldest_contract(b).join(used, "account_id", "left")
    return joined.select(
        "account_id",
        F.col("oldest_id").alias("contract_id"),
        F.coalesce("credits_90d", F.lit(0)).alias("credits_90d"),
        F.coalesce("credits_month_1", F.lit(0)).alias("credits_month_1"),
        S.share(F.col("credits_month_1"), F.col("credits_90d")).alias("m1_share"),
    )


def overlap_365d(b) -> DataFrame:
    """Accounts with two contracts active on the same day of the last 365."""
    p = b.p
    low = p.as_of - timedelta(days=p.expansion_lookback_days - 1)
    return I.max_concurrency(b.stg_contracts, low, p.as_of).where("max_active >= 2")


def expanded_flag(b) -> DataFrame:
    return overlap_365d(b).select("account_id", F.lit(True).alias("expanded"))


def spec_healthscore(b) -> DataFrame:
    """The score in the day-by-day reading, with no signal trusted for young accounts without use."""
    p = b.p
    m1 = b.spec_m1.select("account_id", "credits_90d", "m1_share")
    base = (
        b.int_account_active_contracts.join(b.sources["accounts"].select("account_id"), "account_id", "left_semi")
        .join(spec_included_90d(b), "account_id", "left")
        .join(m1, "account_id", "left")
        .join(b.expanded_flag, "account_id", "left")
    )
    unseen = (F.col("credits_90d") == 0) & (F.col("contract_age_days") < p.pre_signal_days)
    u = F.when(~unseen & (F.col("included_90d") > 0), F.col("credits_90d").cast("double") / F.col("included_90d"))
    spike = S.is_spike(F.col("m1_share"), F.col("contract_age_days"), p)
    scored = (
        base.withColumn("utilization_u", u)
        .withColumn("expanded", F.coalesce("expanded", F.lit(False)))
        .withColumn("base_score", S.base_score(F.col("utilization_u"), p))
        .withColumn("modifier", S.modifier(spike, F.col("expanded"), p))
        .withColumn("healthscore", S.healthscore(F.col("base_score"), F.col("modifier"), p))
    )
    return scored.select(
        "account_id",
        F.col("active_committed_arr").alias("committed_arr"),
        "contract_age_days",
        "included_90d",
        "credits_90d",
        "utilization_u",
        "m1_share",
        "expanded",
        "base_score",
        "modifier",
        "healthscore",
        (F.col("active_committed_arr").cast("double") * F.col("healthscore")).alias("carr"),
    )


# ---- score functions over the data ----


def score_base(b) -> DataFrame:
    return b.int_usage_rolled.select(
        "account_id", "utilization_u", S.base_score(F.col("utilization_u"), b.p).alias("base_score")
    )


def score_modifier(b) -> DataFrame:
    p = b.p
    a = b.active_usage
    spike = S.is_spike(F.col("m1_share"), F.col("contract_age_days"), p)
    expanding = S.is_expanding(F.col("n_active_contracts"), F.col("utilization_u"), p)
    return a.select(
        "account_id",
        F.coalesce(spike, F.lit(False)).alias("spike"),
        F.coalesce(expanding, F.lit(False)).alias("expanding"),
        S.modifier(spike, expanding, p).alias("modifier"),
    )


# ---- contract shapes ----


def contract_day(b) -> DataFrame:
    """One row per contract and day it is active on within the observation window (first to last day of usage known on the as-of date)."""
    return I.contract_days(publish_early(b.stg_contracts, ["annual_commit_dollars"]), *b.observed)


def primary_contract_day(b) -> DataFrame:
    return I.primary_contract_days(b.stg_contracts, *b.observed)


def account_day(b) -> DataFrame:
    """Contract sums per account and active day of the observation window, from running sums of daily changes."""
    return active_days(b, *b.observed)


def overlap_pairs(b) -> DataFrame:
    return I.overlap_counts(b.stg_contracts).where("n_overlapping_pairs > 0")


PAIR = ["contract_id", "start_date", "end_date", "included_monthly_credits"]


def with_previous_contract(contracts: DataFrame, cols: list[str], into: str) -> DataFrame:
    return O.with_previous(contracts, ["account_id"], ["start_date", "contract_id"], cols, into)


def overlap_non_expansion(b) -> DataFrame:
    """Consecutive contracts that overlap by more than 30 days while included credits fell twice in a row."""
    once = with_previous_contract(b.stg_contracts.select("account_id", *PAIR), PAIR, "prev")
    twice = with_previous_contract(
        once.withColumn("prev_included", F.col("prev.included_monthly_credits")), ["prev_included"], "before"
    )
    overlap = F.datediff(F.least("end_date", "prev.end_date"), F.greatest("start_date", "prev.start_date")) + 1
    fell = (F.col("included_monthly_credits") < F.col("prev_included")) & (
        F.col("prev_included") < F.col("before.prev_included")
    )
    return twice.where(fell & (overlap > 30)).select(
        "account_id",
        "contract_id",
        F.col("prev.contract_id").alias("prev_contract_id"),
        overlap.alias("overlap_days"),
        "included_monthly_credits",
        "prev_included",
    )


def renewal_pattern(b) -> DataFrame:
    """Each contract against the account's previous one: overlapping, back_to_back, gap, or first."""
    pairs = with_previous_contract(b.stg_contracts.select("account_id", *PAIR), PAIR, "prev")
    gap = F.datediff("start_date", "prev.end_date")
    kind = (
        F.when(F.col("prev").isNull(), "first")
        .when(gap <= 0, "overlapping")
        .when(gap == 1, "back_to_back")
        .otherwise("gap")
    )
    return pairs.select(
        "account_id",
        "contract_id",
        F.col("prev.contract_id").alias("prev_contract_id"),
        gap.alias("days_after_previous_end"),
        kind.alias("pattern"),
    )


def overage_month_audit(b) -> DataFrame:
    """Per account: its calendar months of valid usage against the largest included credits active in each.

    Both sides are put side by side by one more grouping, not by a join: the unfolded months would look as small as the
    contracts they come from, and be broadcast.
    """
    used = b.valid_daily.groupBy("account_id", F.trunc("usage_date", "month").alias("month")).agg(
        F.sum("credits_consumed").alias("credits")
    )
    months = F.sequence(F.trunc("start_date", "month"), F.trunc("end_date", "month"), F.expr("INTERVAL 1 MONTH"))
    offered = (
        b.stg_contracts.where(F.col("end_date") >= F.col("start_date"))
        .groupBy("account_id", F.trunc("start_date", "month").alias("start_date"),
                 F.trunc("end_date", "month").alias("end_date"))
        .agg(F.max("included_monthly_credits").alias("included"))
        .select("account_id", F.explode(months).alias("month"), "included")
        .groupBy("account_id", "month")
        .agg(F.max("included").alias("included"))
    )
    ratio = F.when(F.col("included") > 0, F.col("credits").cast("double") / F.col("included"))
    both = (
        used.withColumn("used", F.lit(True))
        .unionByName(offered.withColumn("offered", F.lit(True)), allowMissingColumns=True)
        .where(F.col("account_id").isNotNull() & F.col("month").isNotNull())
        .groupBy("account_id", "month")
        .agg(*[F.max(c).alias(c) for c in ("credits", "included", "used", "offered")])
        .where("used AND offered")
    )
    return (
        both.withColumn("ratio", ratio)
        .groupBy("account_id")
        .agg(
            F.count("*").alias("n_months"),
            F.min("ratio").alias("min_ratio"),
            F.count_if(F.col("ratio") >= b.p.overage_label_ratio).alias("n_over"),
        )
        .withColumn("every_month_over", F.col("n_over") == F.col("n_months"))
    )


def orphans_daily(b) -> DataFrame:
    """Orphan logs and credits per day and class, and per account where it is named."""
    return (
        b.usage_daily.where("usage_class <> 'valid'")
        .groupBy("usage_date", "usage_class", "account_id")
        .agg(F.sum("n_logs").alias("n_logs"), F.sum("credits_consumed").alias("credits"))
    )


def usage_reconcile(b) -> DataFrame:
    return reconcile(b.stg_daily_usage_logs)


# ---- keys without a partner ----


def join_anti_account_rep(b) -> DataFrame:
    reps = b.stg_sales_reps.select("rep_id").distinct()
    return salted_join(
        b.sources["accounts"].select("account_id", "rep_id"), reps, ["rep_id"], ["account_id"], b.p.skew_salts,
        "left_anti",
    )


def join_anti_contract_account(b) -> DataFrame:
    known = b.sources["accounts"].select("account_id").distinct()
    return salted_join(
        b.stg_contracts.select("contract_id", "account_id"), known, ["account_id"], ["contract_id"], b.p.skew_salts,
        "left_anti",
    )


def join_anti_usage_account(b) -> DataFrame:
    """Logs of unknown or missing accounts; a missing account never matches."""
    known = b.sources["accounts"].select("account_id").distinct()
    return salted_join(
        b.stg_daily_usage_logs, known, ["account_id"], ["log_id"], b.p.skew_salts, "left_anti"
    )


def data_invariants(b) -> DataFrame:
    """The fixture's own promises as counted checks."""
    p = b.p
    usage = b.usage_daily
    inside = F.col("usage_date").between(F.lit(p.observed_from), F.lit(p.observed_to))
    shelf = b.rule_archetype.where("archetype = 'shelfware'").select("account_id")
    row = one_row(
        [
            usage.agg(
                F.coalesce(F.sum(F.when(~inside, F.col("n_logs"))), F.lit(0)).alias("logs_outside_window"),
                F.coalesce(
                    F.sum(F.when(F.col("usage_class") == "orphan_bad_account", F.col("n_logs"))), F.lit(0)
                ).alias("logs_unknown_account"),
            ),
            usage.join(shelf, "account_id", "left_semi").agg(F.count("*").alias("shelfware_usage_days")),
            join_anti_account_rep(b).agg(F.count("*").alias("accounts_without_rep")),
            overlap_pairs(b).agg(F.count("*").alias("accounts_with_overlap")),
        ]
    )
    check = lambda name, ok: F.struct(F.lit(name).alias("invariant"), F.col(name).alias("n"), ok.alias("holds"))
    return row.select(
        F.inline(
            F.array(
                check("logs_outside_window", F.col("logs_outside_window") == 0),
                check("shelfware_usage_days", F.col("shelfware_usage_days") == 0),
                check("accounts_without_rep", F.col("accounts_without_rep") == 0),
                check("logs_unknown_account", F.col("logs_unknown_account") > 0),
                check("accounts_with_overlap", F.col("accounts_with_overlap") > 0),
            )
        )
    )
