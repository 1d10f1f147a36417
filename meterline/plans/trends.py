"""Reports that compare days: month-end trends, quarter growth, rank movement, entries and drops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.edges import CARR_SUM, carr_sum
from ..operators import ordered as O
from ..operators.skew import salted_join
from .marts import AT_RISK, desc, money
from .models import sums, weighted_hs


def month(b) -> DataFrame:
    return b.month_end_metric.withColumnRenamed("as_of_date", "month_end")


def trend_12m(b) -> DataFrame:
    t = month(b).groupBy("month_end").agg(carr_sum().alias("carr"), F.sum("committed_arr").alias("committed_arr"))
    return t.withColumn("gap_dollars", money("committed_arr") - money("carr")).orderBy("month_end")


def trend_band_mix(b) -> DataFrame:
    return month(b).groupBy("month_end", "band").agg(carr_sum().alias("carr"), F.count("*").alias("n_accounts"))


def mom_delta(b) -> DataFrame:
    """Month-over-month change of the total; the window runs over one row per month."""
    prev = F.lag("carr").over(W.orderBy("month_end"))
    t = month(b).groupBy("month_end").agg(carr_sum().alias("carr")).withColumn("carr", money("carr"))
    return t.withColumn("delta", F.col("carr") - prev).withColumn(
        "delta_pct", F.when(prev > 0, (F.col("carr") - prev) / prev)
    )


def rep_trend_12m(b) -> DataFrame:
    return month(b).groupBy("rep_id", "month_end").agg(carr_sum().alias("carr"))


def rep_at_risk_accounts(b) -> DataFrame:
    """The at-risk accounts of every rep, for the rep drill."""
    return b.mart_carr_current.where(F.col("healthscore") < b.p.band_at_risk_max).select(
        "rep_id", "account_id", "carr", "healthscore", "band"
    )


def account_history(b) -> DataFrame:
    """Daily usage and contract starts of every account, one row per event."""
    used = b.usage_rollup.where(F.col("account_id").isNotNull()).select(
        "account_id",
        F.lit("usage").alias("event"),
        F.lit(None).cast("string").alias("contract_id"),
        F.col("usage_date").alias("from_date"),
        F.col("usage_date").alias("to_date"),
        F.col("credits_consumed").cast("decimal(28,2)").alias("value"),
    )
    signed = b.stg_contracts.select(
        "account_id",
        F.lit("contract").alias("event"),
        "contract_id",
        F.col("start_date").alias("from_date"),
        F.col("end_date").alias("to_date"),
        F.col("annual_commit_dollars").cast("decimal(28,2)").alias("value"),
    )
    return used.unionByName(signed)


def both_days(b, keys: list[str]) -> DataFrame:
    """Sums per key on the as-of date and on the earlier date, as columns of one row."""
    now = F.col("as_of_date") == F.lit(b.p.as_of)
    carr = F.col("carr").cast(CARR_SUM)
    return b.movement_metric.groupBy(*keys).agg(
        F.sum(F.when(now, carr)).alias("carr"),
        F.sum(F.when(~now, carr)).alias("prev_carr"),
    )


def rep_movement(b) -> DataFrame:
    """Per rep: rank by carr on both days (1 = highest; ties share the better rank), movement and change."""
    p = b.p
    reps = O.settled(both_days(b, ["rep_id"]))
    ranks = lambda c: O.ranked_values(reps, [], c, descending=True)
    now = ranks("carr").select("carr", "rank", F.col("avg_rank"))
    before = ranks("prev_carr").select(
        "prev_carr", F.col("rank").alias("prev_rank"), F.col("avg_rank").alias("prev_avg_rank")
    )
    out = salted_join(reps, now, ["carr"], ["rep_id"], p.skew_salts)
    return salted_join(out, before, ["prev_carr"], ["rep_id"], p.skew_salts)


def rep_rank_delta(b) -> DataFrame:
    return rep_movement(b).select(
        "rep_id",
        "rank",
        "prev_rank",
        (F.col("prev_rank") - F.col("rank")).alias("rank_gain"),
        "carr",
        "prev_carr",
        (money("carr") - money("prev_carr")).alias("delta_carr"),
    )


def quarters(b) -> DataFrame:
    return month(b).where(F.col("month_end").isin(b.p.quarter_ends)).withColumnRenamed("month_end", "quarter_end")


def rep_growth_qoq(b) -> DataFrame:
    """The five reps whose carr grew most between the last two quarter-ends."""
    prev, last = b.p.quarter_ends[-2:]
    on = lambda d: F.sum(F.when(F.col("quarter_end") == F.lit(d), F.col("carr").cast(CARR_SUM)))
    reps = quarters(b).groupBy("rep_id").agg(on(last).alias("carr"), on(prev).alias("prev_carr"))
    grown = reps.where("carr IS NOT NULL AND prev_carr IS NOT NULL")
    growth = (F.col("carr") - F.col("prev_carr")).alias("growth_dollars")
    pct = F.when(F.col("prev_carr") > 0, (money("carr") - money("prev_carr")) / money("prev_carr")).alias("growth_pct")
    return grown.select("rep_id", "carr", "prev_carr", growth, pct).orderBy(*desc("growth_dollars"), "rep_id").limit(5)


def segment_4q(b) -> DataFrame:
    return (
        quarters(b)
        .groupBy("segment", "quarter_end")
        .agg(*sums())
        .select("segment", "quarter_end", "carr", "committed_arr", weighted_hs())
    )


def dropped_15pct(b) -> DataFrame:
    """Accounts whose carr fell by more than 15% between the last two month-ends."""
    prev, last = b.p.month_ends[-2:]
    on = lambda d: F.max(F.when(F.col("as_of_date") == F.lit(d), F.col("carr")))
    pair = b.month_end_metric.groupBy("rep_id", "account_id").agg(on(last).alias("carr"), on(prev).alias("prev_carr"))
    change = (F.col("carr") - F.col("prev_carr")) / F.col("prev_carr")
    return pair.where("prev_carr > 0").withColumn("change_pct", change).where("change_pct < -0.15")


def entered_shelfware_30d(b) -> DataFrame:
    """Accounts at risk on the as-of date that were not at risk (or not active) on the earlier date."""
    now = F.col("as_of_date") == F.lit(b.p.as_of)
    pair = b.movement_metric.groupBy("account_id").agg(
        F.max(F.when(now, F.col("band"))).alias("band"),
        F.max(F.when(~now, F.col("band"))).alias("prev_band"),
        F.max(F.when(now, F.col("committed_arr"))).alias("committed_arr"),
    )
    return pair.where((F.col("band") == AT_RISK) & ~F.col("prev_band").eqNullSafe(F.lit(AT_RISK)))


def cfo_variance(b) -> DataFrame:
    """Total carr against a forecast per month-end, within 5%.

    The forecast table is an input; without one, each month is forecast by the total of the month before.
    """
    total = month(b).groupBy("month_end").agg(carr_sum().alias("carr")).withColumn("carr", money("carr"))
    forecast = b.sources.get("forecast")
    if forecast is None:
        naive = total.withColumn("forecast_dollars", F.lag("carr").over(W.orderBy("month_end")))
    else:
        naive = total.join(forecast, "month_end", "left").withColumn("forecast_dollars", money("forecast_dollars"))
    ratio = (F.col("carr") - F.col("forecast_dollars")) / F.col("forecast_dollars")
    return (
        naive.where("forecast_dollars > 0")
        .withColumn("variance_ratio", ratio)
        .withColumn("within", F.abs("variance_ratio") <= 0.05)
    )


