"""All queries by key. Each takes a Book and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .functions.edges import publish
from .params import Params
from .plans import catalog, evals, governance, history, marts, models, quality, roundtrips, spec_evals, trends, variants
from .plans.book import Book
from .sources.fixture import load

Plan = Callable[[Book], DataFrame]


def _named(module, names: str) -> dict[str, Plan]:
    return {n: getattr(module, n) for n in names.split()}


PLANS: dict[str, Plan] = {
    **{t: (lambda b, t=t: getattr(b, t)) for t in models.TABLES},
    **_named(
        marts,
        """q_total q_by_region q_by_segment q_top_reps q_bottom_reps q_shelfware q_spike_drop q_expansion q_new_logo
        q_dq_status orphan_by_class exec_headline band_distribution edge_case_counts carr_rollup hs_hist_segment
        card_counts risk_bubbles region_table share_shelfware rep_leaderboard rep_leaderboard_headline
        hs_histogram_rep filter_values rep_top20_accounts rep_band_mix comp_headline comp_by_band comp_by_rep
        comp_rep_counts comp_rep_band comp_account_concentration comp_histogram pay_blend account_drill at_risk_list
        narrative dq_panel_bands""",
    ),
    "q_orphans": marts.orphan_by_class,
    **_named(
        trends,
        """trend_12m trend_band_mix mom_delta rep_trend_12m rep_at_risk_accounts account_history rep_rank_delta
        rep_growth_qoq segment_4q dropped_15pct entered_shelfware_30d cfo_variance""",
    ),
    **_named(
        variants,
        """rule_archetype archetype_counts join_semi_range_usage_contract split_clean_orphan spec_included_90d
        spec_m1_share overlap_365d spec_healthscore score_base score_modifier contract_day primary_contract_day
        account_day overlap_pairs overlap_non_expansion renewal_pattern overage_month_audit orphans_daily
        usage_reconcile join_anti_account_rep join_anti_contract_account join_anti_usage_account data_invariants""",
    ),
    "carr_account_day": history.carr_account_day_published,
    **_named(history, "carr_account_month_end carr_rep_month_end"),
    **_named(quality, "dq_assertions dq_gate"),
    **_named(
        catalog,
        """dq_schema_columns dq_schema_not_null dq_enum dq_pk dq_ref dq_biz dq_rate dq_volume_drift dq_metric
        dq_metric_offenders dq_orphan_ab dq_checksum dq_recon dq_fresh dq_catalog""",
    ),
    **_named(evals, "eval_results eval_tier_summary"),
    "eval_report_delta": evals.eval_report_delta_run,
    **_named(
        spec_evals,
        """hs_dist_archetype eval_bottom_decile eval_top_quartile eval_false_positive eval_auc_pr eval_r2
        eval_topk_overlap eval_rank_spearman eval_rank_movement eval_param_grid eval_top1_share eval_monotone
        eval_worked_examples eval_determinism eval_freeze""",
    ),
    **_named(
        governance,
        "rls_account_view rls_manager_closure pii_mask retention_usage obs_row_counts obs_freshness",
    ),
    **_named(
        roundtrips,
        """src_csv_roundtrip src_parquet_roundtrip src_labels src_incremental_merge export_csv freeze_write
        restatement_diff restatement_by_rep retention_expire eval_report_delta_stored freeze_digest_check""",
    ),
}


@lru_cache(maxsize=8)
def _book(app_id: str, spark: SparkSession, folder: str, params: Params | None) -> Book:
    return Book(load(spark, folder), params)


def book(spark: SparkSession, folder: str, params: Params | None = None) -> Book:
    """The lazily built plans over one folder; shared by all queries of a session. Holds plans, never data."""
    return _book(spark.sparkContext.applicationId, spark, folder, params)


def run(key: str, spark: SparkSession, folder: str, params: Params | None = None) -> DataFrame:
    """One query over the given tables in ``folder``, with its published column types."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if key in STREAMS:
        return publish(STREAMS[key](spark, folder))
    return publish(PLANS[key](book(spark, folder, params)))


STREAMS = {"stream_daily_rollup": roundtrips.stream_daily_rollup, "stream_daily_incremental": roundtrips.stream_daily_incremental}
KEYS = [*PLANS, *STREAMS]
