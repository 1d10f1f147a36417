"""The sixteen checks of the scored mart against labels, and their gate.

One conditional aggregation over the labelled mart feeds all account-level checks; medians come from the
sliced order statistics. A check over no accounts fails, it does not raise.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edges import CARR_SUM
from ..operators import ordered as O
from ..operators.usage import VALID
from .models import one_row

# Tiers whose failures stop a release, and tiers whose failures only warn.
BLOCKING = ["T1", "T4", "T5"]
ADVISORY = ["T2", "T3"]

CAUGHT = ["spike_drop", "at_risk_shelfware"]


def labelled(b) -> DataFrame:
    """The current mart with the label of each account; unlabelled accounts count as normal."""
    return b.mart_carr_current.join(b.labels, "account_id", "left").withColumn(
        "archetype", F.coalesce("archetype", F.lit("normal"))
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def measures(b) -> DataFrame:
    """One row with everything the checks read."""
    b = b.settled
    p = b.p
    hs, age = F.col("healthscore"), F.col("contract_age_days")
    arr, carr = F.col("committed_arr").cast("double"), F.col("carr")
    is_ = lambda a: F.col("archetype") == a
    in_band = lambda x: F.col("band") == x
    n = F.count_if
    money_of = lambda c, who: F.sum(F.when(who, c.cast(CARR_SUM)))
    mature = is_("normal") & (age >= 90)
    cut = F.greatest(F.lit(p.hs_floor), F.least(F.lit(p.hs_cap), F.col("base_score") * F.col("modifier")))
    over_cap = F.when(arr != 0, carr / arr)
    mart = labelled(b)
    accounts = mart.agg(
        n(is_("shelfware")).alias("shelf_n"),
        n(is_("shelfware") & (hs <= p.hs_floor + 1e-6)).alias("shelf_floor"),
        n(is_("shelfware") & in_band("at_risk_shelfware")).alias("shelf_visible"),
        n(is_("overage")).alias("over_n"),
        n(is_("overage") & hs.between(1.0, p.hs_cap)).alias("over_in"),
        n(is_("spike_drop")).alias("spike_n"),
        n(is_("spike_drop") & F.col("band").isin(CAUGHT)).alias("spike_caught"),
        (F.sum(F.when(is_("spike_drop"), hs.cast("decimal(28,12)"))).cast("double")).alias("spike_hs_sum"),
        n(mature).alias("mature_n"),
        n(mature & hs.between(0.60, p.hs_cap)).alias("mature_in"),
        n(~hs.between(p.hs_floor, p.hs_cap + 1e-9)).alias("hs_out"),
        F.max(F.abs(hs - cut)).alias("hs_gap"),
        F.max(F.abs(carr - arr * hs)).alias("carr_gap"),
        n(over_cap > p.hs_cap + 1e-9).alias("cap_n"),
        F.max(over_cap).alias("cap_max"),
        money_of(F.col("committed_arr"), is_("shelfware")).alias("shelf_arr"),
        money_of(carr, is_("shelfware")).alias("shelf_carr"),
        money_of(F.col("committed_arr"), is_("spike_drop")).alias("spike_arr"),
        money_of(carr, is_("spike_drop")).alias("spike_carr"),
        n(in_band("overage")).alias("band_over_n"),
        money_of(F.col("committed_arr"), in_band("overage")).alias("band_over_arr"),
        money_of(carr, in_band("overage")).alias("band_over_carr"),
        n(in_band("expansion")).alias("band_exp_n"),
        money_of(F.col("committed_arr"), in_band("expansion")).alias("band_exp_arr"),
        money_of(carr, in_band("expansion")).alias("band_exp_carr"),
    )
    reps = b.mart_carr_by_rep.agg(
        F.count("weighted_healthscore").alias("rep_n"),
        (F.max("weighted_healthscore") - F.min("weighted_healthscore")).alias("rep_spread"),
        F.stddev_samp("weighted_healthscore").alias("rep_stdev"),
    )
    side = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("credits_consumed"))), F.lit(0)).cast("double")
    valid = F.col("usage_class") == VALID
    usage = b.usage_daily.agg(
        side(valid).alias("valid_credits"),
        side(~valid).alias("orphan_credits"),
        F.coalesce(F.sum(F.when(~valid, F.col("n_logs"))), F.lit(0)).alias("orphan_n"),
    )
    rolled = b.int_usage_rolled.agg(F.coalesce(F.sum("credits_90d"), F.lit(0)).cast("double").alias("rolled_credits"))
    groups = mart.where(is_("overage") | mature).select("archetype", "healthscore")
    med = O.percentiles(groups, ["archetype"], "healthscore", {"med": 0.5})
    medians = med.agg(
        F.max(F.when(is_("overage"), F.col("med"))).alias("over_med"),
        F.max(F.when(is_("normal"), F.col("med"))).alias("mature_med"),
    )
    return one_row([accounts, reps, usage, rolled, medians])


def checks(p) -> list[Column]:
    c = F.col

    def row(check: str, n: Column, observed: Column, second: Column, passed: Column) -> Column:
        return F.struct(
            F.lit(check).alias("check_id"),
            F.lit(check[:2]).alias("tier"),
            n.cast("bigint").alias("n"),
            observed.cast("double").alias("observed"),
            second.cast("double").alias("second"),
            F.coalesce(passed, F.lit(False)).alias("passed"),
        )

    none = F.lit(None).cast("double")
    d = lambda name: c(name).cast("double")
    loss = lambda who: F.when(c(f"{who}_arr") > 0, (d(f"{who}_arr") - d(f"{who}_carr")) / d(f"{who}_arr")).otherwise(0.0)
    lift = lambda who: -loss(who)
    share = lambda part, whole: _ratio(c(part), c(whole))
    within = c("rolled_credits") <= c("valid_credits") + 1e-6
    return [
        row("T1a", c("shelf_n"), share("shelf_floor", "shelf_n"), none, share("shelf_floor", "shelf_n") >= 0.98),
        row("T1b", c("over_n"), share("over_in", "over_n"), c("over_med"), share("over_in", "over_n") >= 0.90),
        row("T1c", c("spike_n"), share("spike_caught", "spike_n"), share("spike_hs_sum", "spike_n"),
            share("spike_caught", "spike_n") >= 0.80),
        row("T1d", c("mature_n"), share("mature_in", "mature_n"), c("mature_med"),
            (share("mature_in", "mature_n") >= 0.95) & c("mature_med").between(0.80, 1.05)),
        row("T2a", c("hs_out"), c("hs_out"), none, c("hs_out") == 0),
        row("T2b", F.lit(None), c("hs_gap"), none, c("hs_gap") < 1e-6),
        row("T2c", F.lit(None), c("carr_gap"), none, c("carr_gap") < 1e-6),
        row("T3a", c("shelf_n"), share("shelf_visible", "shelf_n"), none, share("shelf_visible", "shelf_n") >= 0.98),
        row("T3b", c("rep_n"), c("rep_spread"), c("rep_stdev"), (c("rep_spread") >= 0.15) & (c("rep_stdev") >= 0.03)),
        row("T4a", c("cap_n"), c("cap_max"), none, c("cap_n") == 0),
        row("T4b", F.lit(None), c("rolled_credits"), c("orphan_credits"), within),
        row("T5a", c("shelf_n"), loss("shelf"), none, (c("shelf_n") > 0) & (loss("shelf") >= 0.45)),
        row("T5b", c("band_over_n"), lift("band_over"), none, (c("band_over_n") > 0) & (lift("band_over") >= 0.05)),
        row("T5c", c("spike_n"), share("spike_caught", "spike_n"), loss("spike"),
            (share("spike_caught", "spike_n") >= 0.80) & (loss("spike") >= 0.20)),
        row("T5d", c("band_exp_n"), lift("band_exp"), none, (c("band_exp_n") > 0) & (lift("band_exp") >= 0.05)),
        row("T5e", c("orphan_n"), c("orphan_credits") * p.price_per_credit, c("rolled_credits"),
            (c("orphan_n") > 0) & within),
    ]


def eval_results(b) -> DataFrame:
    return measures(b).select(F.inline(F.array(*checks(b.p))))


def eval_tier_summary(b) -> DataFrame:
    tally = eval_results(b).groupBy("tier").agg(
        F.count("*").alias("n_checks"), F.count_if("passed").alias("n_pass"), F.count_if(~F.col("passed")).alias("n_fail")
    )
    return tally.withColumn("stops_release", F.col("tier").isin(BLOCKING) & (F.col("n_fail") > 0))


def eval_report_delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Checks of two runs side by side: what changed in status and in the observed value."""
    side = lambda df, name: df.select(
        "check_id", F.col("passed").alias(f"{name}_passed"), F.col("observed").alias(f"{name}_observed")
    )
    both = side(previous, "prev").join(side(current, "curr"), "check_id", "full_outer")
    return both.withColumn(
        "status_changed", ~F.col("prev_passed").eqNullSafe(F.col("curr_passed"))
    ).withColumn("observed_change", F.col("curr_observed") - F.col("prev_observed"))


def stored_report_delta(spark, folder: str) -> DataFrame:
    """The two latest runs of the stored ``eval_results`` under ``folder`` side by side, as ``eval_report_delta`` gives them,
    with ``prev_run_id`` and ``curr_run_id``. Latest by run time, ties by run id; one run only: the earlier side is empty.

    Runs are few (one a day), so their times are one small aggregate; only the two chosen run folders are then read.
    """
    from ..sources import schemas
    from ..sources.sinks import read_runs

    runs = read_runs(spark, f"{folder}/eval_results", schemas.EVAL_RESULTS)
    times = runs.groupBy("run_id").agg(F.max("run_ts").alias("t"))
    picked = [r.run_id for r in times.orderBy(F.desc("t"), F.desc("run_id")).limit(2).collect()]
    if not picked:
        raise ValueError(f"no stored evaluation runs under {folder}")

    def of(run_id):
        rows = runs.where(F.col("run_id") == F.lit(run_id)) if run_id else runs.where("false")
        return rows.select(F.col("test_id").alias("check_id"), (F.col("status") == "pass").alias("passed"),
                           F.col("observed").cast("double").alias("observed"))

    current, previous = picked[0], picked[1] if len(picked) > 1 else None
    return eval_report_delta(of(previous), of(current)).withColumn("prev_run_id", F.lit(previous).cast("string")).withColumn(
        "curr_run_id", F.lit(current))


def eval_report_delta_run(b) -> DataFrame:
    """The report of the as-of date against the one of the earlier date; both read one written roll-up."""
    return eval_report_delta(eval_results(b.at(b.p.prior_as_of)), eval_results(b))


