"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the local master.
``snapshot_build`` writes all tables of a snapshot; the ``stored_*`` entries then read the written marts, as a
dashboard does. All other entries run from the given tables. Every result is consumed in full.
"""

from __future__ import annotations

import json
import os
import sys
import time

from meterline import registry
from meterline.plans import marts, models, trends
from meterline.plans.book import Book
from meterline.plans.build import write_all, write_history
from meterline.session import build_session, scratch_path
from meterline.sources.fixture import load

DIRECT = """int_orphan_usage mart_carr_current mart_carr_by_rep mart_carr_by_region mart_dq_summary spec_healthscore
    split_clean_orphan usage_reconcile primary_contract_day account_day renewal_pattern overage_month_audit
    carr_account_month_end carr_account_day trend_12m rep_rank_delta dq_assertions dq_catalog dq_checksum dq_volume_drift
    eval_results eval_auc_pr eval_rank_spearman eval_param_grid stream_daily_rollup export_csv restatement_diff
    src_incremental_merge""".split()

STORED = {
    "q_total": marts.q_total,
    "q_by_region": marts.q_by_region,
    "q_top_reps": marts.q_top_reps,
    "q_shelfware": marts.q_shelfware,
    "band_distribution": marts.band_distribution,
    "rep_leaderboard": marts.rep_leaderboard,
    "comp_by_rep": marts.comp_by_rep,
    "account_drill": marts.account_drill,
    "rep_at_risk_accounts": trends.rep_at_risk_accounts,
    "trend_12m": trends.trend_12m,
    "rep_rank_delta": trends.rep_rank_delta,
}


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", cpus, "bench")
    consume(registry.run("q_total", spark, folder))  # starts the executors and warms code generation
    took: dict[str, float] = {}

    def timed(name: str, run) -> None:
        t0 = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - t0, 3)
        print(name, took[name], file=sys.stderr, flush=True)

    for key in DIRECT:
        timed(key, lambda key=key: consume(registry.run(key, spark, folder)))
    out = scratch_path(spark, "bench")
    sources = load(spark, folder)
    timed("snapshot_build", lambda: write_all(spark, sources, out))
    stored = Book.stored(spark, sources, out)
    timed("snapshot_history", lambda: write_history(stored, out))
    for key, plan in STORED.items():
        timed(f"stored_{key}", lambda plan=plan: consume(plan(stored)))
    assert len(models.TABLES) == 13
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
