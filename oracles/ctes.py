"""Shared WITH-clauses. ``build`` prepends the ones a final SELECT needs, in dependency order."""

from __future__ import annotations

import re

T = "DATE '1999-06-30'"
MONTH_ENDS = (
    "1998-07-31 1998-08-31 1998-09-30 1998-10-31 1998-11-30 1998-12-31 "
    "1999-01-31 1999-02-28 1999-03-31 1999-04-30 1999-05-31 1999-06-30"
).split()


def m(expr: str, alias: str | None = None) -> str:
    """Money: DOUBLE at 4 places."""
    return f"ROUND(CAST({expr} AS DOUBLE), 4) AS {alias or expr}"


def r(expr: str, alias: str | None = None) -> str:
    """Ratio: DOUBLE at 6 places."""
    return f"ROUND(CAST({expr} AS DOUBLE), 6) AS {alias or expr}"


def n(expr: str, alias: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {alias or expr}"


def band(hs: str, m1: str, age: str, k: str, u: str) -> str:
    return f"""CASE WHEN {hs} <= 0.55::DOUBLE THEN 'at_risk_shelfware'
        WHEN {m1} >= 0.70::DOUBLE AND {age} >= 90 THEN 'spike_drop'
        WHEN {k} >= 2 AND {u} > 1.0::DOUBLE THEN 'expansion'
        WHEN {u} > 1.10::DOUBLE THEN 'overage' ELSE 'healthy' END"""


def base(u: str, floor: str = "0.40::DOUBLE") -> str:
    return f"""CASE WHEN {u} IS NULL THEN 1.0::DOUBLE
        WHEN {u} < 0.30::DOUBLE THEN {floor}
        WHEN {u} < 0.70::DOUBLE
          THEN {floor} + ({u} - 0.30::DOUBLE) * (1.0::DOUBLE - {floor}) / (0.70::DOUBLE - 0.30::DOUBLE)
        WHEN {u} <= 1.10::DOUBLE THEN 1.0::DOUBLE
        ELSE 1.0::DOUBLE + LEAST({u} - 1.10::DOUBLE, 0.20::DOUBLE) END"""


MODIFIER = """CASE WHEN m1_share >= 0.70::DOUBLE AND contract_age_days >= 90 THEN 0.50::DOUBLE
        WHEN n_active_contracts >= 2 AND utilization_u > 1.0::DOUBLE THEN 1.10::DOUBLE ELSE 1.0::DOUBLE END"""

CTES: dict[str, str] = {
    # ---- mapped sources ----
    "sales_reps": """
      SELECT 'R' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS rep_id, s_name AS name, r_name AS region,
             CASE WHEN s_suppkey % 20 < 9 THEN 'Enterprise' ELSE 'Mid-Market' END AS segment
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "accounts": """
      SELECT 'ACC' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS account_id, c_name AS company_name,
             c_mktsegment AS industry,
             'R' || lpad(CAST(c_custkey % (SELECT COUNT(*) FROM supplier) AS VARCHAR), 6, '0') AS rep_id
      FROM customer""",
    "contracts": """
      SELECT 'CT' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS contract_id,
             'ACC' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS account_id,
             CAST(o_orderdate AS DATE) AS start_date,
             CAST(o_orderdate AS DATE) + CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1080 WHEN '2-HIGH' THEN 720
                                              ELSE 360 END AS INTEGER) AS end_date,
             CAST(o_totalprice AS DECIMAL(18,2)) AS annual_commit_dollars,
             CAST(FLOOR(o_totalprice / 20) AS BIGINT) AS included_monthly_compute_credits
      FROM orders""",
    "daily_usage_logs": """
      SELECT concat_ws('-', 'UL', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS log_id,
             CASE WHEN l_orderkey % 499 = 0 THEN NULL
                  WHEN o_custkey % 10 = 0 THEN 'ACC9' || lpad(CAST(o_custkey AS VARCHAR), 7, '0')
                  ELSE 'ACC' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') END AS account_id,
             CAST(l_shipdate AS DATE) AS date,
             CAST(l_extendedprice AS DECIMAL(18,2)) AS compute_credits_consumed
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    # ---- staging ----
    "stg_sales_reps": "SELECT rep_id, name AS rep_name, region, segment FROM sales_reps",
    "stg_accounts": """
      SELECT a.account_id, a.company_name, a.industry, a.rep_id, s.region, s.segment
      FROM accounts a LEFT JOIN sales_reps s ON a.rep_id = s.rep_id""",
    "stg_contracts": f"""
      SELECT contract_id, account_id, start_date, end_date, annual_commit_dollars,
             included_monthly_compute_credits AS included_monthly_credits,
             start_date <= {T} AND {T} <= end_date AS is_active_as_of,
             date_diff('day', start_date, {T}) AS contract_age_days
      FROM contracts""",
    "stg_daily_usage_logs": """
      SELECT log_id, account_id, date AS usage_date, compute_credits_consumed AS credits_consumed
      FROM daily_usage_logs""",
    # ---- intermediate ----
    "contract_span": """
      SELECT account_id, MIN(start_date) AS earliest, MAX(end_date) AS latest FROM stg_contracts GROUP BY account_id""",
    "int_orphan_usage": """
      SELECT u.log_id, u.account_id, u.usage_date, u.credits_consumed,
             CASE WHEN a.account_id IS NULL THEN 'orphan_bad_account'
                  WHEN s.earliest IS NULL OR u.usage_date < s.earliest OR u.usage_date > s.latest
                    THEN 'orphan_out_of_window'
                  ELSE 'valid' END AS usage_class
      FROM stg_daily_usage_logs u LEFT JOIN accounts a ON u.account_id = a.account_id
      LEFT JOIN contract_span s ON u.account_id = s.account_id""",
    "valid_usage": "SELECT * FROM int_orphan_usage WHERE usage_class = 'valid'",
    "int_account_active_contracts": f"""
      SELECT account_id, COUNT(*) AS n_active_contracts, SUM(annual_commit_dollars) AS active_committed_arr,
             SUM(included_monthly_credits) AS included_monthly_credits, MIN(start_date) AS oldest_active_start,
             date_diff('day', MIN(start_date), {T}) AS contract_age_days
      FROM stg_contracts WHERE is_active_as_of GROUP BY account_id""",
    # ---- the metric on a set of days, by brute force: days x contracts, days x usage ----
    "days_t": "SELECT CAST(unnest([" + ", ".join(f"'{d}'" for d in [*MONTH_ENDS, "1999-06-29"]) + "]) AS DATE) AS t",
    "active_on": """
      SELECT t, account_id, COUNT(*) AS n_active_contracts, SUM(annual_commit_dollars) AS committed_arr,
             SUM(included_monthly_credits) AS included, MIN(start_date) AS oldest_active_start
      FROM days_t JOIN stg_contracts ON start_date <= t AND t <= end_date GROUP BY t, account_id""",
    "usage_on": """
      SELECT t, account_id, SUM(credits_consumed) AS credits_90d,
             SUM(CASE WHEN usage_date <= t - 60 THEN credits_consumed ELSE 0 END) AS credits_month_1
      FROM days_t JOIN valid_usage ON usage_date > t - 90 AND usage_date <= t GROUP BY t, account_id""",
    "ratios_on": """
      SELECT a.t, a.account_id, n_active_contracts, committed_arr, included, oldest_active_start,
             date_diff('day', oldest_active_start, a.t) AS contract_age_days,
             COALESCE(credits_90d, 0) AS credits_90d, COALESCE(credits_month_1, 0) AS credits_month_1,
             CASE WHEN included <> 0
                  THEN CAST(COALESCE(credits_90d, 0) AS DOUBLE) / CAST(included * 3 AS DOUBLE) END AS utilization_u,
             CASE WHEN COALESCE(credits_90d, 0) <> 0
                  THEN CAST(credits_month_1 AS DOUBLE) / CAST(credits_90d AS DOUBLE) END AS m1_share
      FROM active_on a LEFT JOIN usage_on u ON a.t = u.t AND a.account_id = u.account_id""",
    "scores_on": f"""
      SELECT *, GREATEST(0.40::DOUBLE, LEAST(1.30::DOUBLE, base_score * modifier)) AS healthscore
      FROM (SELECT *, {base("utilization_u")} AS base_score, {MODIFIER} AS modifier FROM ratios_on)""",
    "metric_on": f"""
      SELECT s.t, s.account_id, company_name, rep_id, region, segment, industry, n_active_contracts, committed_arr,
             credits_90d, utilization_u, m1_share, base_score, modifier, healthscore,
             CAST(committed_arr AS DOUBLE) * healthscore AS carr, contract_age_days, oldest_active_start,
             {band("healthscore", "m1_share", "contract_age_days", "n_active_contracts", "utilization_u")} AS band
      FROM scores_on s JOIN stg_accounts a ON s.account_id = a.account_id""",
    # ---- the snapshot ----
    "rolled": f"SELECT * FROM ratios_on WHERE t = {T}",
    "scores": f"SELECT * FROM scores_on WHERE t = {T}",
    "cur": f"SELECT * FROM metric_on WHERE t = {T}",
    "by_rep": """
      SELECT rep_id, rep_name, region, segment, COALESCE(k, 0) AS n_accounts, arr AS committed_arr, c AS carr,
             CASE WHEN arr > 0 THEN CAST(c AS DOUBLE) / CAST(arr AS DOUBLE) END AS weighted_healthscore,
             COALESCE(risk, 0) AS n_at_risk, COALESCE(spike, 0) AS n_spike_drop, COALESCE(expanding, 0) AS n_expansion,
             COALESCE(over, 0) AS n_overage
      FROM stg_sales_reps NATURAL LEFT JOIN (
        SELECT rep_id, COUNT(*) AS k, SUM(committed_arr) AS arr, SUM(CAST(carr AS DECIMAL(28,6))) AS c,
               COUNT(*) FILTER (WHERE band = 'at_risk_shelfware') AS risk,
               COUNT(*) FILTER (WHERE band = 'spike_drop') AS spike,
               COUNT(*) FILTER (WHERE band = 'expansion') AS expanding,
               COUNT(*) FILTER (WHERE band = 'overage') AS over
        FROM cur GROUP BY rep_id)""",
    "by_region": """
      SELECT region, segment, COUNT(*) AS n_accounts, SUM(committed_arr) AS committed_arr,
             SUM(CAST(carr AS DECIMAL(28,6))) AS carr, COUNT(*) FILTER (WHERE band = 'at_risk_shelfware') AS n_at_risk
      FROM cur GROUP BY region, segment""",
    "months": "SELECT * FROM metric_on WHERE t IN (" + ", ".join(f"DATE '{d}'" for d in MONTH_ENDS) + ")",
    "rep_flow": """
      SELECT rep_id, COUNT(*) AS n_accounts, SUM(committed_arr) AS committed_arr,
             SUM(CAST(carr AS DECIMAL(28,6))) AS carr,
             CAST(SUM(CAST(carr AS DECIMAL(28,6))) AS DOUBLE) - CAST(SUM(committed_arr) AS DOUBLE) AS delta
      FROM cur GROUP BY rep_id""",
    # ---- labels ----
    "rule_labels": f"""
      SELECT a.account_id,
             CASE WHEN NOT EXISTS (SELECT 1 FROM daily_usage_logs u WHERE u.account_id = a.account_id) THEN 'shelfware'
                  WHEN q.m1_share >= 0.70::DOUBLE AND q.contract_age_days >= 90 THEN 'spike_drop'
                  WHEN q.included > 0 AND q.credits_90d >= q.included * 3 * 1.20 THEN 'overage'
                  ELSE 'normal' END AS archetype
      FROM accounts a LEFT JOIN rolled q ON a.account_id = q.account_id""",
    "labelled": """
      SELECT c.*, COALESCE(l.archetype, 'normal') AS archetype
      FROM cur c LEFT JOIN rule_labels l ON c.account_id = l.account_id""",
    # ---- usage inside a contract ----
    "clean_usage": """
      SELECT u.* FROM stg_daily_usage_logs u JOIN accounts a ON u.account_id = a.account_id
      WHERE EXISTS (SELECT 1 FROM contracts c WHERE c.account_id = u.account_id
                    AND u.usage_date BETWEEN c.start_date AND c.end_date)""",
    # ---- day calendars ----
    "window_days": "SELECT CAST(unnest(generate_series(DATE '1999-04-02', DATE '1999-06-30', INTERVAL 1 DAY)) AS DATE) AS day",
    "contract_days": """
      SELECT contract_id, account_id, day, annual_commit_dollars, included_monthly_credits
      FROM stg_contracts JOIN window_days ON day BETWEEN start_date AND end_date""",
    "observed": f"SELECT MIN(usage_date) AS lo, MAX(usage_date) AS hi FROM stg_daily_usage_logs WHERE usage_date <= {T}",
    "observed_days": "SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM observed",
    "contract_observed_days": """
      SELECT contract_id, account_id, day, annual_commit_dollars, included_monthly_credits
      FROM stg_contracts JOIN observed_days ON day BETWEEN start_date AND end_date""",
    "pairs": """
      SELECT account_id, contract_id, start_date, end_date, included_monthly_credits AS included,
             LAG(contract_id) OVER w AS prev_id, LAG(start_date) OVER w AS prev_start, LAG(end_date) OVER w AS prev_end,
             LAG(included_monthly_credits) OVER w AS prev_included,
             LAG(included_monthly_credits, 2) OVER w AS before_included
      FROM stg_contracts WINDOW w AS (PARTITION BY account_id ORDER BY start_date, contract_id)""",
    "year_days": "SELECT CAST(unnest(generate_series(DATE '1998-07-01', DATE '1999-06-30', INTERVAL 1 DAY)) AS DATE) AS day",
    "concurrency": """
      SELECT account_id, MAX(k) AS max_active
      FROM (SELECT account_id, day, COUNT(*) AS k FROM stg_contracts
            JOIN year_days ON day BETWEEN start_date AND end_date GROUP BY account_id, day)
      GROUP BY account_id""",
    "expanded": "SELECT account_id FROM concurrency WHERE max_active >= 2",
    "included_90d": """
      SELECT account_id, CAST(SUM(included_monthly_credits) AS DOUBLE) / 30.0::DOUBLE AS included_90d
      FROM contract_days GROUP BY account_id""",
    "oldest": f"""
      SELECT account_id, start_date, contract_id FROM stg_contracts WHERE is_active_as_of
      QUALIFY ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY start_date, contract_id) = 1""",
    "spec_m1": f"""
      SELECT o.account_id, o.contract_id, COALESCE(SUM(credits_consumed), 0) AS credits_90d,
             COALESCE(SUM(CASE WHEN usage_date BETWEEN o.start_date AND o.start_date + 29 THEN credits_consumed
                          ELSE 0 END), 0) AS credits_month_1
      FROM oldest o LEFT JOIN clean_usage u
        ON o.account_id = u.account_id AND u.usage_date > {T} - 90 AND u.usage_date <= {T}
      GROUP BY o.account_id, o.contract_id""",
    # ---- two days ----
    "rep_two_days": f"""
      SELECT rep_id, SUM(CASE WHEN t = {T} THEN CAST(carr AS DECIMAL(28,6)) END) AS carr,
             SUM(CASE WHEN t = {T} - 30 THEN CAST(carr AS DECIMAL(28,6)) END) AS prev_carr
      FROM metric_on WHERE t IN ({T}, {T} - 30) GROUP BY rep_id""",
    "rep_two_ranks": """
      SELECT rep_id, carr, prev_carr, RANK() OVER (ORDER BY carr DESC) AS rank,
             RANK() OVER (ORDER BY prev_carr DESC) AS prev_rank,
             RANK() OVER (ORDER BY carr DESC) + (COUNT(*) OVER (PARTITION BY carr) - 1) / 2.0 AS avg_rank,
             RANK() OVER (ORDER BY prev_carr DESC) + (COUNT(*) OVER (PARTITION BY prev_carr) - 1) / 2.0 AS prev_avg_rank
      FROM rep_two_days WHERE carr IS NOT NULL AND prev_carr IS NOT NULL""",
    "scorers": """
      SELECT CASE WHEN archetype IN ('shelfware', 'spike_drop') THEN 1 ELSE 0 END AS at_risk, s.scorer,
             CASE s.scorer WHEN 'committed_arr' THEN CAST(committed_arr AS DECIMAL(28,6))
                           WHEN 'consumption' THEN CAST(credits_90d AS DECIMAL(28,6))
                           ELSE CAST(carr AS DECIMAL(28,6)) END AS score
      FROM labelled, (VALUES ('committed_arr'), ('consumption'), ('carr')) s(scorer)""",
    # ---- grid ----
    "grid": f"""
      SELECT rep_id, f.hs_floor, c.hs_cap,
             SUM(CAST(CAST(committed_arr AS DOUBLE) * GREATEST(f.hs_floor, LEAST(c.hs_cap,
                 ({base("utilization_u", "f.hs_floor")}) * modifier)) AS DECIMAL(28,6))) AS carr
      FROM cur, (SELECT unnest([0.30::DOUBLE, 0.40::DOUBLE, 0.50::DOUBLE]) AS hs_floor) f,
           (SELECT unnest([1.20::DOUBLE, 1.30::DOUBLE, 1.40::DOUBLE]) AS hs_cap) c
      GROUP BY rep_id, f.hs_floor, c.hs_cap""",
    "grid_ranks": """
      SELECT *, RANK() OVER (PARTITION BY hs_floor, hs_cap ORDER BY carr DESC)
                + (COUNT(*) OVER (PARTITION BY hs_floor, hs_cap, carr) - 1) / 2.0 AS avg_rank FROM grid""",
    # ---- assertions ----
    "violations": """
      SELECT 'A01' AS assertion_id, (SELECT COUNT(*) FROM stg_sales_reps) - (SELECT COUNT(*) FROM (SELECT rep_id FROM stg_sales_reps WHERE rep_id IS NOT NULL GROUP BY rep_id)) AS v
      UNION ALL SELECT 'A02', (SELECT COUNT(*) FROM stg_accounts) - (SELECT COUNT(*) FROM (SELECT account_id FROM stg_accounts WHERE account_id IS NOT NULL GROUP BY account_id))
      UNION ALL SELECT 'A03', (SELECT COUNT(*) FROM stg_contracts) - (SELECT COUNT(*) FROM (SELECT contract_id FROM stg_contracts WHERE contract_id IS NOT NULL GROUP BY contract_id))
      UNION ALL SELECT 'A04', (SELECT COUNT(*) FROM stg_daily_usage_logs) - (SELECT COUNT(*) FROM (SELECT log_id FROM stg_daily_usage_logs WHERE log_id IS NOT NULL GROUP BY log_id))
      UNION ALL SELECT 'A05', COUNT(*) FROM stg_accounts WHERE rep_id NOT IN (SELECT rep_id FROM stg_sales_reps)
      UNION ALL SELECT 'A06', COUNT(*) FROM stg_contracts WHERE account_id NOT IN (SELECT account_id FROM accounts)
      UNION ALL SELECT 'A07', COUNT(*) FROM stg_contracts WHERE annual_commit_dollars < 0
      UNION ALL SELECT 'A08', COUNT(*) FROM stg_contracts WHERE included_monthly_credits < 0
      UNION ALL SELECT 'A09', COUNT(*) FROM stg_contracts WHERE end_date < start_date
      UNION ALL SELECT 'A10', COUNT(*) FROM stg_daily_usage_logs WHERE credits_consumed < 0
      UNION ALL SELECT 'A11', COUNT(*) FROM scores WHERE healthscore < 0.40::DOUBLE OR healthscore > 1.30::DOUBLE + 1e-9
      UNION ALL SELECT 'A12', COUNT(*) FROM cur WHERE ABS(carr - CAST(committed_arr AS DOUBLE) * healthscore) > 1e-6
      UNION ALL SELECT 'A13', CASE WHEN COUNT(*) > 0 AND AVG(CASE WHEN usage_class <> 'valid' THEN 1.0 ELSE 0.0 END) > 0.05
                              THEN 1 ELSE 0 END FROM int_orphan_usage
      UNION ALL SELECT 'A14', CASE WHEN (SELECT COUNT(*) FROM accounts) = 0 THEN 1
                              WHEN (SELECT COUNT(*) FROM int_account_active_contracts) * 1.0
                                   / (SELECT COUNT(*) FROM accounts) < 0.50 THEN 1 ELSE 0 END
      UNION ALL SELECT 'A15', CASE WHEN COUNT(*) = 0 THEN 1
                              WHEN AVG(CASE WHEN band = 'at_risk_shelfware' THEN 1.0 ELSE 0.0 END)
                                   NOT BETWEEN 0.05 AND 0.25 THEN 1 ELSE 0 END FROM cur
      UNION ALL SELECT 'A16', CASE WHEN CAST(MAX(carr) AS DOUBLE) / NULLIF(CAST(SUM(carr) AS DOUBLE), 0) > 0.30
                              THEN 1 ELSE 0 END FROM by_rep""",
}

_WORD = re.compile(r"[a-z_0-9]+")


def build(final: str, **override: str) -> str:
    """WITH-clause of everything ``final`` needs, then ``final``."""
    ctes = {**CTES, **override}
    ordered: list[str] = []

    def need(sql: str, seen: tuple[str, ...]) -> None:
        for word in _WORD.findall(sql):
            if word in ctes and word not in ordered and word not in seen:
                need(ctes[word], (*seen, word))
                ordered.append(word)

    need(final, ())
    if not ordered:
        return final
    return "WITH " + ",\n".join(f"{name} AS ({ctes[name].strip()})" for name in ordered) + "\n" + final
