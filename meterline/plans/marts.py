"""Mart queries and dashboard tables of the current snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.edges import carr_sum
from ..operators import ordered as O
from ..operators.usage import BAD_ACCOUNT, OUT_OF_WINDOW
from .models import n_band, one_row, sums, weighted_hs

AT_RISK = "at_risk_shelfware"


def desc(*names: str) -> list[Column]:
    return [F.col(n).desc_nulls_last() for n in names]


def money(name: str) -> Column:
    return F.col(name).cast("double")


# ---- canned queries ----


def q_total(b) -> DataFrame:
    return b.mart_carr_current.agg(
        carr_sum().alias("total_carr"), F.sum("committed_arr").alias("total_committed_arr")
    )


def _split(b, by: str) -> DataFrame:
    return b.mart_carr_current.groupBy(by).agg(
        carr_sum().alias("carr"), F.sum("committed_arr").alias("committed_arr"), F.count("*").alias("n_accounts")
    )


def q_by_region(b) -> DataFrame:
    return _split(b, "region").orderBy(*desc("carr"), "region")


def q_by_segment(b) -> DataFrame:
    return _split(b, "segment")


REP_CARD = ["rep_id", "rep_name", "region", "segment", "carr", "weighted_healthscore"]


def q_top_reps(b) -> DataFrame:
    return b.mart_carr_by_rep.select(*REP_CARD).orderBy(*desc("carr"), "rep_id").limit(5)


def q_bottom_reps(b) -> DataFrame:
    reps = b.mart_carr_by_rep.where("carr > 0").select(*REP_CARD, "n_at_risk")
    return reps.orderBy("weighted_healthscore", "rep_id").limit(5)


def _in_band(b, name: str, *extra: str) -> DataFrame:
    cols = ["account_id", "committed_arr", "carr", "healthscore", *extra]
    return b.mart_carr_current.where(F.col("band") == name).select(*cols)


def q_shelfware(b) -> DataFrame:
    return _in_band(b, AT_RISK, "utilization_u").orderBy(*desc("committed_arr"), "account_id").limit(20)


def q_spike_drop(b) -> DataFrame:
    return _in_band(b, "spike_drop", "m1_share").orderBy(*desc("committed_arr"), "account_id")


def q_expansion(b) -> DataFrame:
    return _in_band(b, "expansion", "n_active_contracts", "utilization_u").orderBy(*desc("carr"), "account_id")


def q_new_logo(b) -> DataFrame:
    cols = ["account_id", "segment", "committed_arr", "carr", "contract_age_days", "healthscore", "band"]
    young = b.mart_carr_current.where("contract_age_days <= 60").select(*cols)
    return young.orderBy("contract_age_days", "account_id")


def orphan_by_class(b) -> DataFrame:
    return b.usage_daily.groupBy("usage_class").agg(
        F.sum("n_logs").alias("n_logs"), F.sum("credits_consumed").alias("total_credits")
    )


def q_dq_status(b) -> DataFrame:
    return b.mart_dq_summary


# ---- executive ----


def exec_headline(b) -> DataFrame:
    delta = money("total_carr") - money("total_committed_arr")
    return b.mart_dq_summary.select(
        "total_committed_arr",
        "total_carr",
        "weighted_healthscore",
        F.when(F.col("total_committed_arr") > 0, delta / money("total_committed_arr")).alias("delta_pct"),
        F.col("n_accounts_in_metric").alias("n_accounts"),
    )


def band_distribution(b) -> DataFrame:
    """One row per band; the share windows run over those five rows."""
    bands = b.mart_carr_current.groupBy("band").agg(*sums())
    whole = W.partitionBy()
    shares = {"pct_accounts": "n_accounts", "pct_committed": "committed_arr", "pct_carr": "carr"}
    return bands.select(
        "band",
        S.band_display(F.col("band")).alias("band_label"),
        "n_accounts",
        "committed_arr",
        "carr",
        *[(money(c) / F.sum(c).over(whole).cast("double")).alias(n) for n, c in shares.items()],
    ).orderBy(*desc("carr"), "band")


def edge_case_counts(b) -> DataFrame:
    """Five rows: label counts, accounts with two or more active contracts, orphan logs by class."""
    labels = b.rule_archetype.agg(
        F.count("*").alias("n_labels"), *[F.count_if(F.col("archetype") == a).alias(a)
                                          for a in ("spike_drop", "shelfware", "overage")]
    )
    active = b.int_account_active_contracts.agg(F.count_if(F.col("n_active_contracts") >= 2).alias("expansion"))
    n_logs = lambda c: F.sum(F.when(F.col("usage_class") == c, F.col("n_logs")).otherwise(0))
    logs = b.usage_daily.agg(n_logs(BAD_ACCOUNT).alias("bad_account"), n_logs(OUT_OF_WINDOW).alias("out_of_window"))
    row = one_row([labels, active, logs])
    pct = lambda c: F.when(F.col("n_labels") > 0, F.col(c) / F.col("n_labels"))
    none = F.lit(None).cast("double")
    line = lambda name, n, share: F.struct(F.lit(name).alias("anomaly"), n.alias("n"), share.alias("pct"))
    lines = F.array(
        line("spike_drop", F.col("spike_drop"), pct("spike_drop")),
        line("shelfware", F.col("shelfware"), pct("shelfware")),
        line("overage", F.col("overage"), pct("overage")),
        line("expansion", F.col("expansion"), pct("expansion")),
        line("orphan_bad_account", F.col("bad_account"), none),
        line("orphan_out_of_window", F.col("out_of_window"), none),
        line("orphan_total", F.col("bad_account") + F.col("out_of_window"), none),
    )
    return row.select(F.inline(lines))


def carr_rollup(b) -> DataFrame:
    """Region x segment, region and grand totals in one pass."""
    return (
        b.mart_carr_current.rollup("region", "segment")
        .agg(F.grouping_id().alias("grouping_level"), *sums())
        .select("region", "segment", "grouping_level", "n_accounts", "committed_arr", "carr", weighted_hs())
    )


def hs_hist_segment(b) -> DataFrame:
    p = b.p
    bin_ = S.histogram_bin(F.col("healthscore"), F.lit(p.hs_floor), F.lit(p.hs_cap), 20)
    return b.mart_carr_current.groupBy("segment", bin_.alias("bin")).agg(F.count("*").alias("n_accounts"))


def card_counts(b) -> DataFrame:
    p = b.p
    return b.mart_carr_current.join(b.expanded_flag, "account_id", "left").agg(
        F.count_if(F.col("healthscore") < p.band_at_risk_max).alias("n_at_risk"),
        F.count_if(F.col("healthscore") >= p.card_overage_min).alias("n_overage"),
        F.count_if(F.coalesce(F.col("expanded"), F.lit(False))).alias("n_expanded"),
    )


def risk_bubbles(b) -> DataFrame:
    """Top five rep x region pairs by committed revenue at risk, and by committed revenue expanding."""
    sized = b.mart_carr_current.where(F.col("band").isin(AT_RISK, "expansion")).groupBy("band", "rep_id", "region").agg(
        F.sum("committed_arr").alias("committed_arr"), F.count("*").alias("n_accounts")
    )
    top = lambda n: (
        sized.where(F.col("band") == n).orderBy(*desc("committed_arr"), "rep_id", "region").limit(5)
    )
    return top(AT_RISK).unionByName(top("expansion"))


def region_table(b) -> DataFrame:
    return (
        b.mart_carr_current.groupBy("region")
        .agg(*sums(), n_band(AT_RISK).alias("n_at_risk"), F.countDistinct("rep_id").alias("n_reps"))
        .select("region", "carr", "committed_arr", weighted_hs(), "n_at_risk", "n_reps")
    )


def share_shelfware(b) -> DataFrame:
    at_risk = F.sum(F.when(F.col("band") == AT_RISK, F.col("carr").cast("decimal(28,6)")).otherwise(0))
    row = b.mart_carr_current.agg(at_risk.alias("at_risk_carr"), carr_sum().alias("total_carr"))
    return row.withColumn(
        "share_at_risk", F.when(F.col("total_carr") > 0, money("at_risk_carr") / money("total_carr"))
    )


# ---- reps ----


def rep_leaderboard(b, segments: list[str] | None = None, regions: list[str] | None = None) -> DataFrame:
    """Reps of the chosen segments and regions (all by default), best first."""
    reps = b.mart_carr_by_rep
    if segments is not None:
        reps = reps.where(F.col("segment").isin(segments))
    if regions is not None:
        reps = reps.where(F.col("region").isin(regions))
    return reps.orderBy(*desc("carr"), "rep_id")


def rep_leaderboard_headline(b, segments: list[str] | None = None, regions: list[str] | None = None) -> DataFrame:
    return rep_leaderboard(b, segments, regions).agg(
        F.count("*").alias("n_reps"),
        F.sum("carr").alias("carr"),
        (F.max("weighted_healthscore") - F.min("weighted_healthscore")).alias("hs_spread"),
    )


def hs_histogram_rep(b) -> DataFrame:
    p = b.p
    reps = b.mart_carr_by_rep.where(F.col("weighted_healthscore").isNotNull())
    bin_ = S.histogram_bin(F.col("weighted_healthscore"), F.lit(p.hs_floor), F.lit(p.hs_cap), 20)
    return reps.groupBy("segment", bin_.alias("bin")).agg(F.count("*").alias("n_reps"))


def filter_values(b) -> DataFrame:
    """Distinct filter choices of the rep view."""
    pick = lambda c: (
        b.mart_carr_by_rep.where(F.col(c).isNotNull()).select(F.lit(c).alias("filter"), F.col(c).alias("choice"))
    )
    return pick("segment").unionByName(pick("region")).distinct().orderBy("filter", "choice")


def rep_top20_accounts(b) -> DataFrame:
    """Spark limits each task to 20 rows per rep before the shuffle, so a rep with very many accounts stays small."""
    best = W.partitionBy("rep_id").orderBy(*desc("carr"), "account_id")
    ranked = b.mart_carr_current.select("rep_id", "account_id", "carr", F.row_number().over(best).alias("position"))
    return ranked.where("position <= 20")


def rep_band_mix(b) -> DataFrame:
    mix = b.mart_carr_current.groupBy("rep_id", "band").agg(F.sum("committed_arr").alias("committed_arr"))
    whole = F.sum("committed_arr").over(W.partitionBy("rep_id"))
    return mix.withColumn("share_of_arr", money("committed_arr") / whole.cast("double"))


# ---- comp impact ----


def _flow(df: DataFrame, p) -> DataFrame:
    delta = money("carr") - money("committed_arr")
    return df.withColumn("delta", delta).withColumn("comp_delta", F.lit(p.commission_rate) * delta)


def comp_headline(b) -> DataFrame:
    total = b.mart_carr_current.agg(F.sum("committed_arr").alias("committed_arr"), carr_sum().alias("carr"))
    return _flow(total, b.p).withColumn(
        "delta_pct", F.when(F.col("committed_arr") > 0, F.col("delta") / money("committed_arr"))
    )


def comp_by_band(b) -> DataFrame:
    return _flow(b.mart_carr_current.groupBy("band").agg(*sums()), b.p).orderBy("delta", "band")


def rep_flow(b) -> DataFrame:
    flow = _flow(b.mart_carr_current.groupBy("rep_id").agg(*sums()), b.p)
    return flow.withColumn("delta_pct", F.when(F.col("committed_arr") > 0, F.col("delta") / money("committed_arr")))


def comp_by_rep(b) -> DataFrame:
    names = b.stg_sales_reps
    return rep_flow(b).join(names, "rep_id", "left").orderBy("delta", "rep_id")


def comp_rep_counts(b) -> DataFrame:
    return rep_flow(b).agg(
        F.count_if(F.col("delta") < 0).alias("n_cut"),
        F.count_if(F.abs("delta_pct") <= 0.05).alias("n_flat"),
        F.count_if(F.col("delta") > 0).alias("n_lift"),
    )


def comp_rep_band(b) -> DataFrame:
    return _flow(b.mart_carr_current.groupBy("rep_id", "band").agg(*sums()), b.p)


def comp_account_concentration(b) -> DataFrame:
    """Reps for whom one account makes up more than 30% of the rep's delta."""
    exact = (F.col("carr").cast("decimal(28,6)") - F.col("committed_arr")).cast("decimal(28,6)")
    per_rep = (
        b.mart_carr_current.withColumn("_d", exact)
        .groupBy("rep_id")
        .agg(F.max(F.abs("_d")).alias("top_delta"), F.sum("_d").alias("rep_delta"))
    )
    share = F.when(F.col("rep_delta") != 0, money("top_delta") / F.abs(money("rep_delta")))
    return per_rep.withColumn("top_share", share).where("top_share > 0.30")


def comp_histogram(b) -> DataFrame:
    """Per-rep comp delta in 30 equal bins between its extremes, which come from one aggregated row."""
    flow = rep_flow(b).select("comp_delta")
    ends = flow.agg(F.min("comp_delta").alias("low"), F.max("comp_delta").alias("high"))
    low, high = ends.select("low").scalar(), ends.select("high").scalar()
    bins = flow.withColumn("low", low).withColumn("high", high)
    bin_ = S.histogram_bin(F.col("comp_delta"), F.col("low"), F.col("high"), 30)
    return bins.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n_reps"))


def pay_blend(b) -> DataFrame:
    """Shadow pay per weight: the change of pay against committed revenue, median and 95th percentile over reps."""
    change = F.abs(money("carr") - money("committed_arr")) / money("committed_arr")
    reps = b.mart_carr_by_rep.where("committed_arr > 0").select(
        F.explode(F.array(F.lit(0.30), F.lit(0.70))).alias("weight"), change.alias("_c")
    )
    blended = reps.withColumn("change", F.col("weight") * F.col("_c"))
    q = O.percentiles(blended, ["weight"], "change", {"median_change": 0.5, "p95_change": 0.95})
    return q.select(
        "weight",
        "median_change",
        "p95_change",
        ((F.col("median_change") < 0.08) & (F.col("p95_change") < 0.25)).alias("passed"),
    )


# ---- accounts ----


def account_drill(b) -> DataFrame:
    """The decomposition row of every account, largest first."""
    cols = ["account_id", "segment", "contract_age_days", "n_active_contracts", "utilization_u", "m1_share",
            "base_score", "modifier", "healthscore", "committed_arr", "carr", "band"]
    return b.mart_carr_current.select(*cols).orderBy(*desc("committed_arr"), "account_id")


def at_risk_list(b) -> DataFrame:
    p = b.p
    renewal = b.stg_contracts.where("is_active_as_of").groupBy("account_id").agg(F.min("end_date").alias("_end"))
    risk = b.mart_carr_current.where(F.col("healthscore") < p.band_at_risk_max)
    names = b.sources["accounts"].select("account_id", "company_name")
    return (
        risk.join(renewal, "account_id")
        .join(names, "account_id")
        .select(
            "account_id",
            "company_name",
            "rep_id",
            "committed_arr",
            "carr",
            "healthscore",
            "band",
            F.datediff("_end", F.lit(p.as_of)).alias("days_to_renewal"),
            (money("committed_arr") * (1 - F.col("healthscore"))).alias("dollars_at_risk"),
        )
        .orderBy(*desc("dollars_at_risk"), "account_id")
    )


def narrative(b) -> DataFrame:
    return b.mart_carr_current.select("account_id", S.narrative(b.p).alias("narrative"))


def dq_panel_bands(b) -> DataFrame:
    counts = {"at_risk_shelfware": "n_shelfware", **{x: f"n_{x}" for x in S.BANDS[1:]}}
    lines = F.array(
        *[F.struct(F.lit(name).alias("band"), F.col(col).alias("n_accounts")) for name, col in counts.items()]
    )
    return b.mart_dq_summary.select(F.inline(lines)).select(
        "band", S.band_display(F.col("band")).alias("band_label"), "n_accounts"
    )
