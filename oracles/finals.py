"""The final SELECT of each query."""

from __future__ import annotations

from .ctes import CTES, T, base, build, m, n, r

COUNT = "CAST(COUNT(*) AS BIGINT)"
CARR = "SUM(CAST(carr AS DECIMAL(28,6)))"
RISK = "'at_risk_shelfware'"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


def n_if(cond: str, alias: str) -> str:
    return f"CAST(COUNT(CASE WHEN {cond} THEN 1 END) AS BIGINT) AS {alias}"


SUMS = f"{COUNT} AS n_accounts, {m('SUM(committed_arr)', 'committed_arr')}, {m(CARR, 'carr')}"
WHS = r(ratio(CARR, "SUM(committed_arr)"), "weighted_healthscore")

LABEL = """CASE band WHEN 'at_risk_shelfware' THEN 'Shelfware' WHEN 'spike_drop' THEN 'Spike & Drop'
    WHEN 'expansion' THEN 'Mid-Year Expansions' WHEN 'overage' THEN 'Consistent Overages' ELSE 'Healthy' END"""

MET = ", ".join(
    ["account_id", "rep_id", "region", "segment", "industry", n("n_active_contracts"), m("committed_arr"),
     r("utilization_u"), r("m1_share"), r("base_score"), r("modifier"), r("healthscore"), m("carr"),
     n("contract_age_days"), "oldest_active_start", "t AS as_of_date"]
)
REP = ", ".join(
    ["rep_id", "rep_name", "region", "segment", n("n_accounts"), m("committed_arr"), m("carr"),
     r("weighted_healthscore"), n("n_at_risk"), n("n_spike_drop"), n("n_expansion"), n("n_overage")]
)
DAY_METRIC = ", ".join(
    ["account_id", "company_name", "rep_id", "region", "segment", n("n_active_contracts"), m("committed_arr"),
     m("credits_90d"), r("utilization_u"), r("m1_share"), r("healthscore"), m("carr"), n("contract_age_days"), "band"]
)
LOG = f"log_id, account_id, usage_date, {m('credits_consumed')}"
FLOW = (
    f"{m('CAST(carr AS DOUBLE) - CAST(committed_arr AS DOUBLE)', 'delta')}, "
    f"{m('0.10::DOUBLE * (CAST(carr AS DOUBLE) - CAST(committed_arr AS DOUBLE))', 'comp_delta')}"
)
DELTA_PCT = r(
    "CASE WHEN committed_arr > 0 THEN (CAST(carr AS DOUBLE) - CAST(committed_arr AS DOUBLE))"
    " / CAST(committed_arr AS DOUBLE) END",
    "delta_pct",
)
BY = lambda keys: (
    f"(SELECT {keys}, COUNT(*) AS n_accounts, SUM(committed_arr) AS committed_arr, {CARR} AS carr FROM cur GROUP BY {keys})"
)
BIN = lambda x, k: (
    f"CAST(LEAST(FLOOR(({x} - 0.40::DOUBLE) / (1.30::DOUBLE - 0.40::DOUBLE) * {k}), {k - 1}) AS BIGINT) AS bin"
)
# The engine's own formatting rounds the exact binary value, ties to even.
PCT = lambda x: f"format('{{:.0f}}', CAST({x} AS DOUBLE) * 100) || '%'"
DOLLARS = lambda x: f"format('${{:,}}', CAST(format('{{:.0f}}', CAST({x} AS DOUBLE)) AS BIGINT))"
TWO = lambda x: f"format('{{:.2f}}', CAST({x} AS DOUBLE))"

DAILY_DETAIL = "DATE '1997-05-31'"

# ---- catalogue rows ----
# Rule id, tier, threshold in words, owning team.
TEAMS = {
    "DQ-SCHEMA-001": ("P0", "all present", "Data Platform"),
    "DQ-SCHEMA-002": ("P0", "declared types", "Data Platform"),
    "DQ-METRIC-005": ("P0", "identical", "Analytics Eng"),
    "DQ-METRIC-006": ("P0", "identical", "Analytics Eng"),
    "DQ-SCHEMA-003": ("P0", "0 nulls", "Data Platform"),
    "DQ-SCHEMA-004": ("P0", "0 values outside the taxonomy", "Data Platform"),
    "DQ-SCHEMA-005": ("P0", "0 duplicates", "Data Platform"),
    "DQ-REF-001": ("P0", "0 dangling", "RevOps"),
    "DQ-REF-002": ("P0", "0 dangling", "RevOps"),
    "DQ-REF-003": ("P1", "< 1% of daily volume", "Platform Eng"),
    "DQ-REF-004": ("P1", "0 accounts", "RevOps"),
    "DQ-BIZ-001": ("P0", "0 rows", "Finance Systems"),
    "DQ-BIZ-002": ("P0", "0 rows", "Finance Systems"),
    "DQ-BIZ-003": ("P0", "0 rows", "Platform Eng"),
    "DQ-BIZ-004": ("P0", "0 rows", "Finance Systems"),
    "DQ-BIZ-005": ("P0", "0 rows", "Platform Eng"),
    "DQ-BIZ-006": ("P1", "< 1%", "Platform Eng"),
    "DQ-RATE-001": ("P1", "3% to 15%", "PM + CSM"),
    "DQ-RATE-002": ("P1", "2% to 8%", "PM"),
    "DQ-RATE-003": ("P1", "8% to 25%", "PM"),
    "DQ-RATE-004": ("P2", "trended", "PM"),
    "DQ-RATE-005": ("P1", "< 1%", "Platform Eng"),
    "DQ-RATE-006": ("P1", "within 30% of the trailing median", "Platform Eng"),
    "DQ-METRIC-001": ("P0", "0 rows", "PM + Analytics Eng"),
    "DQ-METRIC-002": ("P0", "0.40 to 1.30", "PM + Analytics Eng"),
    "DQ-METRIC-003": ("P0", "0 nulls", "Analytics Eng"),
    "DQ-METRIC-004": ("P0", "<= 1e-6", "Analytics Eng"),
    "DQ-RECON-001": ("P0", "equal", "Analytics Eng"),
    "DQ-RECON-002": ("P0", "equal", "Analytics Eng"),
    "DQ-RECON-003": ("P1", "no decrease", "Analytics Eng"),
    "DQ-RECON-004": ("P1", "within 0.5%", "Finance Systems"),
    "DQ-FRESH-001": ("P0", ">= as-of date - 1", "Platform Eng"),
    "DQ-FRESH-002": ("P0", "<= 26 h", "Analytics Eng"),
    "DQ-FRESH-003": ("P0", "<= 2 days after month end", "Analytics Eng"),
}


def rule(name: str, observed: str, affected: str, ok: str, source: str) -> str:
    tier, threshold, team = TEAMS[name]
    failed = "fail" if tier == "P0" else "warn"
    return (
        f"SELECT '{name}' AS assertion_id, '{tier}' AS severity, "
        f"CASE WHEN {ok} THEN 'pass' ELSE '{failed}' END AS status, {m(observed, 'observed_value')}, "
        f"{n(affected, 'rows_affected')}, '{threshold}' AS threshold, '{team}' AS owning_team FROM ({source})"
    )


def none(name: str, source: str) -> str:
    return rule(name, "x", "x", "x = 0", source)


def rows(*parts: str) -> str:
    return "\nUNION ALL ".join(parts)


NOT_NULL = none(
    "DQ-SCHEMA-003",
    """SELECT (SELECT COUNT(CASE WHEN rep_id IS NULL OR name IS NULL OR region IS NULL OR segment IS NULL THEN 1 END)
               FROM sales_reps)
            + (SELECT COUNT(CASE WHEN account_id IS NULL OR company_name IS NULL OR industry IS NULL OR rep_id IS NULL
               THEN 1 END) FROM accounts)
            + (SELECT COUNT(CASE WHEN contract_id IS NULL OR account_id IS NULL OR start_date IS NULL OR end_date IS NULL
               OR annual_commit_dollars IS NULL OR included_monthly_compute_credits IS NULL THEN 1 END) FROM contracts)
            + (SELECT COUNT(CASE WHEN log_id IS NULL OR date IS NULL OR compute_credits_consumed IS NULL THEN 1 END)
               FROM daily_usage_logs) AS x""",
)
ENUM = none(
    "DQ-SCHEMA-004",
    """SELECT (SELECT COUNT(*) FROM sales_reps WHERE region NOT IN ('AFRICA','AMERICA','ASIA','EUROPE','MIDDLE EAST'))
            + (SELECT COUNT(*) FROM sales_reps WHERE segment NOT IN ('Enterprise','Mid-Market'))
            + (SELECT COUNT(*) FROM accounts WHERE industry NOT IN
               ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY')) AS x""",
)
PK = none(
    "DQ-SCHEMA-005",
    """SELECT (SELECT COUNT(*) - COUNT(DISTINCT rep_id) FROM sales_reps)
            + (SELECT COUNT(*) - COUNT(DISTINCT account_id) FROM accounts)
            + (SELECT COUNT(*) - COUNT(DISTINCT contract_id) FROM contracts)
            + (SELECT COUNT(*) - COUNT(DISTINCT log_id) FROM daily_usage_logs) AS x""",
)
REF = rows(
    none("DQ-REF-001", "SELECT COUNT(*) AS x FROM accounts WHERE rep_id NOT IN (SELECT rep_id FROM sales_reps)"),
    none("DQ-REF-002", "SELECT COUNT(*) AS x FROM contracts WHERE account_id NOT IN (SELECT account_id FROM accounts)"),
    rule(
        "DQ-REF-003", "worst", "bad", "bad = 0",
        """SELECT MAX(s) AS worst, COUNT(CASE WHEN s >= 0.01::DOUBLE THEN 1 END) AS bad FROM
           (SELECT CAST(COUNT(CASE WHEN usage_class = 'orphan_bad_account' THEN 1 END) AS DOUBLE) / COUNT(*) AS s
            FROM int_orphan_usage GROUP BY usage_date)""",
    ),
    none("DQ-REF-004", "SELECT COUNT(*) AS x FROM cur WHERE region IS NULL"),
)
BIZ = rows(
    none("DQ-BIZ-001", "SELECT COUNT(*) AS x FROM stg_contracts WHERE annual_commit_dollars <= 0"),
    none("DQ-BIZ-002", "SELECT COUNT(*) AS x FROM stg_contracts WHERE included_monthly_credits <= 0"),
    none("DQ-BIZ-003", "SELECT COUNT(*) AS x FROM stg_daily_usage_logs WHERE credits_consumed < 0"),
    none("DQ-BIZ-004", "SELECT COUNT(*) AS x FROM stg_contracts WHERE end_date <= start_date"),
    none(
        "DQ-BIZ-005",
        "SELECT COUNT(*) AS x FROM stg_daily_usage_logs WHERE usage_date NOT BETWEEN DATE '1995-01-02' AND DATE '2001-11-04'",
    ),
    rule(
        "DQ-BIZ-006", "s", "bad", "s < 0.01::DOUBLE",
        """SELECT bad, CASE WHEN k > 0 THEN CAST(bad AS DOUBLE) / k ELSE 0 END AS s FROM
           (SELECT COUNT(*) AS k, COUNT(CASE WHEN usage_class = 'orphan_out_of_window' THEN 1 END) AS bad
            FROM int_orphan_usage)""",
    ),
)


def label_share(name: str, archetype: str, low: str, high: str) -> str:
    return rule(
        name, "s", "bad", f"s BETWEEN {low}::DOUBLE AND {high}::DOUBLE",
        f"""SELECT bad, CAST(bad AS DOUBLE) / k AS s FROM (SELECT COUNT(*) AS k,
            COUNT(CASE WHEN archetype = '{archetype}' THEN 1 END) AS bad FROM rule_labels)""",
    )


RATE = rows(
    label_share("DQ-RATE-001", "shelfware", "0.03", "0.15"),
    label_share("DQ-RATE-002", "spike_drop", "0.02", "0.08"),
    label_share("DQ-RATE-003", "overage", "0.08", "0.25"),
    rule(
        "DQ-RATE-004", "CAST(k AS DOUBLE) / total", "k", "TRUE",
        "SELECT (SELECT COUNT(*) FROM expanded) AS k, (SELECT COUNT(*) FROM accounts) AS total",
    ),
    rule(
        "DQ-RATE-005", "s", "bad", "s < 0.01::DOUBLE",
        """SELECT bad, CAST(bad AS DOUBLE) / k AS s FROM (SELECT COUNT(*) AS k,
           COUNT(CASE WHEN usage_class <> 'valid' THEN 1 END) AS bad FROM int_orphan_usage)""",
    ),
)
DRIFT = """SELECT usage_date, n_logs, median_7d, CASE WHEN median_7d > 0 THEN n_logs / median_7d - 1 END AS drift_ratio
    FROM (SELECT usage_date, CAST(n_logs AS DOUBLE) AS n_logs,
                 quantile_cont(n_logs, 0.5) OVER (ORDER BY usage_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS median_7d
          FROM (SELECT usage_date, COUNT(*) AS n_logs FROM stg_daily_usage_logs GROUP BY usage_date))"""
VOLUME = rule(
    "DQ-RATE-006", "worst", "bad", "bad = 0",
    f"SELECT MAX(ABS(drift_ratio)) AS worst, COUNT(CASE WHEN ABS(drift_ratio) > 0.30::DOUBLE THEN 1 END) AS bad FROM ({DRIFT})",
)
METRIC = rows(
    none(
        "DQ-METRIC-001",
        """SELECT COUNT(*) AS x FROM cur WHERE carr < 0.40::DOUBLE * CAST(committed_arr AS DOUBLE) - 1e-6
           OR carr > 1.30::DOUBLE * CAST(committed_arr AS DOUBLE) + 1e-6""",
    ),
    rule(
        "DQ-METRIC-002", "s", "0", "s IS NULL OR s BETWEEN 0.40::DOUBLE AND 1.30::DOUBLE",
        f"SELECT {ratio(CARR, 'SUM(committed_arr)')} AS s FROM cur",
    ),
    none("DQ-METRIC-003", "SELECT COUNT(*) AS x FROM cur WHERE carr IS NULL"),
)
RERUNS = rows(
    *[
        rule(k, "0", "0", "TRUE", "SELECT COUNT(*) FROM cur")
        for k in ("DQ-SCHEMA-001", "DQ-SCHEMA-002", "DQ-METRIC-005", "DQ-METRIC-006")
    ]
)
ORPHAN_AB = rule("DQ-METRIC-004", "0", "0", "TRUE", "SELECT COUNT(*) FROM cur")
RECON = rows(
    rule(
        "DQ-RECON-001", "ABS(a - b)", "ABS(a - b)", "a = b",
        """SELECT (SELECT COUNT(*) FROM daily_usage_logs) AS a, (SELECT COUNT(*) FROM int_orphan_usage) AS b""",
    ),
    rule(
        "DQ-RECON-002", "d", "CASE WHEN d > 1e-6 THEN 1 ELSE 0 END", "d <= 1e-6",
        f"""SELECT ABS(CAST((SELECT SUM(carr) FROM by_rep) AS DOUBLE)
               - CAST((SELECT {CARR} FROM cur WHERE rep_id IN (SELECT rep_id FROM sales_reps)) AS DOUBLE)) AS d""",
    ),
    rule(
        "DQ-RECON-003", "a - b", "GREATEST(b - a, 0)", "b <= a",
        f"""SELECT COUNT(CASE WHEN t = {T} THEN 1 END) AS a, COUNT(CASE WHEN t = {T} - 1 THEN 1 END) AS b
            FROM metric_on WHERE t IN ({T}, {T} - 1)""",
    ),
    rule(
        "DQ-RECON-004", "d", "CASE WHEN d > 0.005 THEN 1 ELSE 0 END", "d <= 0.005",
        f"""SELECT ABS(CAST((SELECT SUM(committed_arr) FROM cur) AS DOUBLE) / CAST((SELECT SUM(annual_commit_dollars)
            FROM contracts WHERE {T} BETWEEN start_date AND end_date) AS DOUBLE) - 1) AS d""",
    ),
)
FRESH = rows(
    rule(
        "DQ-FRESH-001", "d", "CASE WHEN d > 1 THEN 1 ELSE 0 END", "d <= 1",
        f"SELECT date_diff('day', MAX(usage_date), {T}) AS d FROM stg_daily_usage_logs WHERE usage_date <= {T}",
    ),
    rule(
        "DQ-FRESH-002", "h", "CASE WHEN h > 26 THEN 1 ELSE 0 END", "h <= 26",
        f"SELECT 24 * date_diff('day', MAX(t), {T}) AS h FROM cur",
    ),
    none("DQ-FRESH-003", f"SELECT 11 - COUNT(DISTINCT t) AS x FROM months WHERE t <= {T} - 2"),
)

# Id, name, severity of the assertions.
A_NAMES = {
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
A_VALUES = ", ".join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in A_NAMES.items())
ASSERTIONS = f"""SELECT assertion_id, name, severity, CAST(v AS BIGINT) AS violations,
    CASE WHEN v = 0 THEN 'pass' ELSE severity END AS status
    FROM violations JOIN (VALUES {A_VALUES}) a(id, name, severity) ON assertion_id = id"""

# ---- evals ----
EXACT = lambda c: f"CAST({c} AS DECIMAL(28,6))"


def loss(where: str) -> str:
    return (
        f"(SELECT CASE WHEN SUM(committed_arr) > 0 THEN (CAST(SUM(committed_arr) AS DOUBLE) - CAST({CARR} AS DOUBLE))"
        f" / CAST(SUM(committed_arr) AS DOUBLE) ELSE 0 END FROM labelled WHERE {where})"
    )


def share_of(cond: str, where: str) -> str:
    return f"(SELECT AVG(CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM labelled WHERE {where})"


def eval_row(check: str, k: str, observed: str, second: str, ok: str) -> str:
    return (
        f"SELECT '{check}' AS check_id, '{check[:2]}' AS tier, {n(k, 'n')}, CAST({observed} AS DOUBLE) AS observed, "
        f"CAST({second} AS DOUBLE) AS second, COALESCE({ok}, FALSE) AS passed"
    )


def n_of(where: str) -> str:
    return f"(SELECT COUNT(*) FROM labelled WHERE {where})"


SHELF, OVER, SPIKE = "archetype = 'shelfware'", "archetype = 'overage'", "archetype = 'spike_drop'"
MATURE = "archetype = 'normal' AND contract_age_days >= 90"
CAUGHT = "band IN ('spike_drop', 'at_risk_shelfware')"
FLOOR = share_of("healthscore <= 0.40::DOUBLE + 1e-6", SHELF)
OVER_IN = share_of("healthscore BETWEEN 1.0::DOUBLE AND 1.30::DOUBLE", OVER)
OVER_MED = f"(SELECT quantile_cont(healthscore, 0.5) FROM labelled WHERE {OVER})"
SPIKE_IN = share_of(CAUGHT, SPIKE)
MATURE_IN = share_of("healthscore BETWEEN 0.60::DOUBLE AND 1.30::DOUBLE", MATURE)
MATURE_MED = f"(SELECT quantile_cont(healthscore, 0.5) FROM labelled WHERE {MATURE})"
HS_OUT = "(SELECT COUNT(*) FROM cur WHERE healthscore NOT BETWEEN 0.40::DOUBLE AND 1.30::DOUBLE + 1e-9)"
HS_GAP = "(SELECT MAX(ABS(healthscore - GREATEST(0.40::DOUBLE, LEAST(1.30::DOUBLE, base_score * modifier)))) FROM cur)"
CARR_GAP = "(SELECT MAX(ABS(carr - CAST(committed_arr AS DOUBLE) * healthscore)) FROM cur)"
VISIBLE = share_of(f"band = {RISK}", SHELF)
SPREAD = "(SELECT MAX(weighted_healthscore) - MIN(weighted_healthscore) FROM by_rep)"
STDEV = "(SELECT stddev_samp(weighted_healthscore) FROM by_rep)"
CAP_N = """(SELECT COUNT(*) FROM cur WHERE committed_arr <> 0
            AND carr / CAST(committed_arr AS DOUBLE) > 1.30::DOUBLE + 1e-9)"""
CAP_MAX = "(SELECT MAX(carr / CAST(committed_arr AS DOUBLE)) FROM cur WHERE committed_arr <> 0)"
ROLLED = "(SELECT CAST(SUM(credits_90d) AS DOUBLE) FROM rolled)"
VALID = "(SELECT CAST(SUM(credits_consumed) AS DOUBLE) FROM int_orphan_usage WHERE usage_class = 'valid')"
ORPHAN = "(SELECT CAST(SUM(credits_consumed) AS DOUBLE) FROM int_orphan_usage WHERE usage_class <> 'valid')"
ORPHAN_N = "(SELECT COUNT(*) FROM int_orphan_usage WHERE usage_class <> 'valid')"
B_OVER, B_EXP = "band = 'overage'", "band = 'expansion'"

EVALS = rows(
    eval_row("T1a", n_of(SHELF), FLOOR, "NULL", f"{FLOOR} >= 0.98::DOUBLE"),
    eval_row("T1b", n_of(OVER), OVER_IN, OVER_MED, f"{OVER_IN} >= 0.90::DOUBLE"),
    eval_row("T1c", n_of(SPIKE), SPIKE_IN, f"(SELECT AVG(healthscore) FROM labelled WHERE {SPIKE})",
             f"{SPIKE_IN} >= 0.80::DOUBLE"),
    eval_row("T1d", n_of(MATURE), MATURE_IN, MATURE_MED,
             f"({MATURE_IN} >= 0.95::DOUBLE AND {MATURE_MED} BETWEEN 0.80::DOUBLE AND 1.05::DOUBLE)"),
    eval_row("T2a", HS_OUT, HS_OUT, "NULL", f"{HS_OUT} = 0"),
    eval_row("T2b", "NULL", HS_GAP, "NULL", f"{HS_GAP} < 1e-6"),
    eval_row("T2c", "NULL", CARR_GAP, "NULL", f"{CARR_GAP} < 1e-6"),
    eval_row("T3a", n_of(SHELF), VISIBLE, "NULL", f"{VISIBLE} >= 0.98::DOUBLE"),
    eval_row("T3b", "(SELECT COUNT(weighted_healthscore) FROM by_rep)", SPREAD, STDEV,
             f"({SPREAD} >= 0.15::DOUBLE AND {STDEV} >= 0.03::DOUBLE)"),
    eval_row("T4a", CAP_N, CAP_MAX, "NULL", f"{CAP_N} = 0"),
    eval_row("T4b", "NULL", ROLLED, ORPHAN, f"{ROLLED} <= {VALID} + 1e-6"),
    eval_row("T5a", n_of(SHELF), loss(SHELF), "NULL", f"({n_of(SHELF)} > 0 AND {loss(SHELF)} >= 0.45::DOUBLE)"),
    eval_row("T5b", n_of(B_OVER), f"-{loss(B_OVER)}", "NULL",
             f"({n_of(B_OVER)} > 0 AND -{loss(B_OVER)} >= 0.05::DOUBLE)"),
    eval_row("T5c", n_of(SPIKE), SPIKE_IN, loss(SPIKE), f"({SPIKE_IN} >= 0.80::DOUBLE AND {loss(SPIKE)} >= 0.20::DOUBLE)"),
    eval_row("T5d", n_of(B_EXP), f"-{loss(B_EXP)}", "NULL",
             f"({n_of(B_EXP)} > 0 AND -{loss(B_EXP)} >= 0.05::DOUBLE)"),
    eval_row("T5e", ORPHAN_N, f"{ORPHAN} * 1.0::DOUBLE", ROLLED, f"({ORPHAN_N} > 0 AND {ROLLED} <= {VALID} + 1e-6)"),
)


def beyond(value: str, q: str, label: str, op: str, need: str) -> str:
    return f"""SELECT {n('k', 'n')}, {n('inside', 'n_inside')}, {m('thr', 'threshold_value')},
        {r('CASE WHEN k > 0 THEN CAST(inside AS DOUBLE) / k END', 'inside_share')},
        COALESCE(CAST(inside AS DOUBLE) / NULLIF(k, 0) >= {need}::DOUBLE, FALSE) AS passed
        FROM (SELECT COUNT(*) AS k, COUNT(CASE WHEN {value} {op} thr THEN 1 END) AS inside, MAX(thr) AS thr
              FROM labelled, (SELECT quantile_cont({value}, {q}) AS thr FROM labelled) WHERE archetype = '{label}')"""


AUC = """SELECT scorer, SUM(CAST(k_pos AS DOUBLE) / all_pos * cum_pos / cum_n) AS auc_pr FROM
    (SELECT scorer, k_pos, SUM(k_pos) OVER w AS cum_pos, SUM(k) OVER w AS cum_n, SUM(k_pos) OVER (PARTITION BY scorer) AS all_pos
     FROM (SELECT scorer, score, COUNT(*) AS k, SUM(at_risk) AS k_pos FROM scorers GROUP BY scorer, score)
     WINDOW w AS (PARTITION BY scorer ORDER BY score)) GROUP BY scorer"""


def margin(inner: str, value: str, need: str) -> str:
    lead = (
        f"(MAX(CASE WHEN scorer = 'carr' THEN {value} END) OVER () - MAX(CASE WHEN scorer <> 'carr' THEN {value} END) OVER ())"
    )
    return f"""SELECT scorer, {r(value)}, {r(lead, 'margin')}, COALESCE({lead} >= {need}::DOUBLE, FALSE) AS passed
               FROM ({inner})"""


GRID = f"""SELECT {r('g.hs_floor', 'hs_floor')}, {r('g.hs_cap', 'hs_cap')}, {m('total', 'total_carr')},
    {r('change', 'change_pct')}, {r('rf', 'rho_next_floor')}, {r('rc', 'rho_next_cap')},
    COALESCE(ABS(change) <= 0.03::DOUBLE AND COALESCE(rf, 1) >= 0.95 AND COALESCE(rc, 1) >= 0.95, FALSE) AS passed
    FROM (SELECT hs_floor, hs_cap, SUM(carr) AS total, CAST(SUM(carr) AS DOUBLE) / CAST((SELECT SUM(carr) FROM grid
            WHERE hs_floor = 0.40::DOUBLE AND hs_cap = 1.30::DOUBLE) AS DOUBLE) - 1 AS change
          FROM grid GROUP BY hs_floor, hs_cap) g
    LEFT JOIN (SELECT a.hs_floor, a.hs_cap, corr(a.avg_rank, b.avg_rank) AS rf FROM grid_ranks a JOIN grid_ranks b
               ON a.rep_id = b.rep_id AND a.hs_cap = b.hs_cap AND ROUND(b.hs_floor - a.hs_floor, 4) = 0.1
               GROUP BY a.hs_floor, a.hs_cap) f ON g.hs_floor = f.hs_floor AND g.hs_cap = f.hs_cap
    LEFT JOIN (SELECT a.hs_floor, a.hs_cap, corr(a.avg_rank, b.avg_rank) AS rc FROM grid_ranks a JOIN grid_ranks b
               ON a.rep_id = b.rep_id AND a.hs_floor = b.hs_floor AND ROUND(b.hs_cap - a.hs_cap, 4) = 0.1
               GROUP BY a.hs_floor, a.hs_cap) c ON g.hs_floor = c.hs_floor AND g.hs_cap = c.hs_cap"""

MONOTONE = f"""SELECT {n('k', 'n_monotone')}, {n('bad', 'n_violating')},
    {r('CASE WHEN k > 0 THEN CAST(bad AS DOUBLE) / k ELSE 0 END', 'violating_share')},
    (CASE WHEN k > 0 THEN CAST(bad AS DOUBLE) / k ELSE 0 END) <= 0.02::DOUBLE AS passed
    FROM (SELECT COUNT(*) AS k, COUNT(CASE WHEN max_drop > 0.05::DOUBLE THEN 1 END) AS bad FROM
      (SELECT account_id, MIN(du) AS min_du, MAX(CASE WHEN same THEN fall END) AS max_drop, BOOL_OR(spike) AS spike,
              BOOL_OR(expanding) AS expanding
       FROM (SELECT account_id, utilization_u - LAG(utilization_u) OVER w AS du, LAG(healthscore) OVER w - healthscore AS fall,
                    n_active_contracts = LAG(n_active_contracts) OVER w AS same,
                    COALESCE(m1_share >= 0.70::DOUBLE AND contract_age_days >= 90, FALSE) AS spike,
                    COALESCE(n_active_contracts >= 2 AND utilization_u > 1.0::DOUBLE, FALSE) AS expanding
             FROM months WINDOW w AS (PARTITION BY account_id ORDER BY t)) GROUP BY account_id)
      WHERE min_du > 0 AND NOT spike AND NOT expanding)"""

SCHEMA = {
    "sales_reps": [("rep_id", "string"), ("name", "string"), ("region", "string"), ("segment", "string")],
    "accounts": [("account_id", "string"), ("company_name", "string"), ("industry", "string"), ("rep_id", "string")],
    "contracts": [("contract_id", "string"), ("account_id", "string"), ("start_date", "date"), ("end_date", "date"),
                  ("annual_commit_dollars", "decimal(18,2)"), ("included_monthly_compute_credits", "bigint")],
    "daily_usage_logs": [("log_id", "string"), ("account_id", "string"), ("date", "date"),
                         ("compute_credits_consumed", "decimal(18,2)")],
}
SCHEMA_COLUMNS = rows(
    *[
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{ty}' AS expected_type, TRUE AS present, TRUE AS type_matches, "
        f"{COUNT} AS n_rows, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS n_nulls FROM {t}"
        for t, cols in SCHEMA.items()
        for c, ty in cols
    ]
)

SPEC = f"""SELECT account_id, {m('committed_arr')}, {n('contract_age_days')}, {r('included_90d')}, {m('credits_90d')},
    {r('utilization_u')}, {r('m1_share')}, is_expanded AS expanded, {r('base_score')}, {r('modifier')},
    {r('healthscore')}, {m('CAST(committed_arr AS DOUBLE) * healthscore', 'carr')}
    FROM (SELECT *, GREATEST(0.40::DOUBLE, LEAST(1.30::DOUBLE, base_score * modifier)) AS healthscore FROM
      (SELECT *, {base('utilization_u')} AS base_score,
              CASE WHEN m1_share >= 0.70::DOUBLE AND contract_age_days >= 90 THEN 0.50::DOUBLE
                   WHEN is_expanded THEN 1.10::DOUBLE ELSE 1.0::DOUBLE END AS modifier
       FROM (SELECT a.account_id, active_committed_arr AS committed_arr, contract_age_days, included_90d, s.credits_90d,
                    CASE WHEN s.credits_90d = 0 AND contract_age_days < 30 THEN NULL
                         WHEN included_90d > 0 THEN CAST(s.credits_90d AS DOUBLE) / included_90d END AS utilization_u,
                    CASE WHEN s.credits_90d <> 0
                         THEN CAST(s.credits_month_1 AS DOUBLE) / CAST(s.credits_90d AS DOUBLE) END AS m1_share,
                    e.account_id IS NOT NULL AS is_expanded
             FROM int_account_active_contracts a JOIN accounts k ON a.account_id = k.account_id
             LEFT JOIN included_90d i ON a.account_id = i.account_id
             LEFT JOIN spec_m1 s ON a.account_id = s.account_id
             LEFT JOIN expanded e ON a.account_id = e.account_id)))"""

DRIVER = f"""CASE WHEN band = {RISK} AND utilization_u IS NULL
        THEN 'No usage observed in the trailing 90 days despite an active contract.'
      WHEN band = {RISK} THEN 'Trailing-90-day utilization is only ' || {PCT('utilization_u')} || ' of included credits.'
      WHEN band = 'spike_drop' THEN 'Month-1 of the 90-day window accounts for ' || {PCT('m1_share')}
        || ' of total usage — classic spike-drop.'
      WHEN band = 'expansion' THEN 'Utilization at ' || {PCT('utilization_u')} || ' with '
        || CAST(n_active_contracts AS VARCHAR) || ' overlapping contracts — the account is expanding.'
      WHEN band = 'overage' THEN 'Utilization at ' || {PCT('utilization_u')}
        || ', consistently above included — the customer is paying overage.'
      WHEN utilization_u IS NULL THEN 'No usage data yet — HealthScore defaults to booking trust.'
      ELSE 'Utilization at ' || {PCT('utilization_u')} || ', within the healthy band; no anomaly flags tripped.' END"""
NARRATIVE = f"""SELECT account_id, 'HealthScore is **' || {TWO('healthscore')} || '** — '
    || CASE band WHEN {RISK} THEN 'shelfware-leaning' WHEN 'spike_drop' THEN 'spike-drop pattern'
         WHEN 'expansion' THEN 'expanding' WHEN 'overage' THEN 'paying overage' ELSE 'healthy' END
    || '. cARR is ' || {DOLLARS('carr')} || ' against Committed ARR of ' || {DOLLARS('committed_arr')} || '.' || chr(10) || chr(10)
    || {DRIVER} AS narrative FROM cur"""

TABLE_ROWS = {
    "stg_sales_reps": "sales_reps", "stg_accounts": "accounts", "stg_contracts": "contracts",
    "stg_daily_usage_logs": "daily_usage_logs", "int_orphan_usage": "daily_usage_logs",
    "int_account_active_contracts": "int_account_active_contracts", "int_usage_rolled": "int_account_active_contracts",
    "metric_healthscore": "int_account_active_contracts", "metric_carr": "cur", "mart_carr_current": "cur",
    "mart_carr_by_rep": "sales_reps", "mart_carr_by_region": "by_region", "mart_dq_summary": "(SELECT 1 AS one)",
}

MART_TALLY = f"""SELECT COUNT(*) AS k, SUM(committed_arr) AS arr, {CARR} AS c,
    COUNT(*) FILTER (WHERE band = {RISK}) AS risk, COUNT(*) FILTER (WHERE band = 'spike_drop') AS spike,
    COUNT(*) FILTER (WHERE band = 'expansion') AS expanding, COUNT(*) FILTER (WHERE band = 'overage') AS over,
    COUNT(*) FILTER (WHERE band = 'healthy') AS fine FROM cur"""
LOG_TALLY = """SELECT COUNT(*) AS logs, COUNT(*) FILTER (WHERE usage_class = 'orphan_bad_account') AS bad,
    COUNT(*) FILTER (WHERE usage_class = 'orphan_out_of_window') AS outside,
    SUM(credits_consumed) FILTER (WHERE usage_class <> 'valid') AS lost FROM int_orphan_usage"""
DQ_SUMMARY = f"""SELECT {n('reps', 'n_reps')}, {n('accs', 'n_accounts')}, {n('cons', 'n_contracts')},
    {n('logs', 'n_usage_logs')}, {n('live', 'n_accounts_with_active_contract')}, {n('k', 'n_accounts_in_metric')},
    {n('bad', 'n_orphan_bad_account')}, {n('outside', 'n_orphan_out_of_window')}, {m('lost', 'orphan_credits_total')},
    {n('risk', 'n_shelfware')}, {n('spike', 'n_spike_drop')}, {n('expanding', 'n_expansion')}, {n('over', 'n_overage')},
    {n('fine', 'n_healthy')}, {m('arr', 'total_committed_arr')}, {m('c', 'total_carr')},
    {r(ratio('c', 'arr'), 'weighted_healthscore')}, {T} AS as_of_date
    FROM ({MART_TALLY}), ({LOG_TALLY}), (SELECT COUNT(*) AS reps FROM sales_reps), (SELECT COUNT(*) AS accs FROM accounts),
         (SELECT COUNT(*) AS cons FROM contracts), (SELECT COUNT(*) AS live FROM int_account_active_contracts)"""

ORPHAN_CLASS = f"SELECT usage_class, {COUNT} AS n_logs, {m('SUM(credits_consumed)', 'total_credits')} FROM int_orphan_usage GROUP BY usage_class"
SPLIT = lambda by: f"SELECT {by}, {SUMS} FROM cur GROUP BY {by}"
REP_CARD = f"rep_id, rep_name, region, segment, {m('carr')}, {r('weighted_healthscore')}"
ACC = f"account_id, {m('committed_arr')}, {m('carr')}, {r('healthscore')}"


def top(select: str, source: str, order: str, k: int) -> str:
    return f"SELECT {select} FROM (SELECT * FROM {source} ORDER BY {order} LIMIT {k})"


def two(alias_now: str, alias_prev: str, now: str, prev: str) -> str:
    return (
        f"MAX(CASE WHEN t = DATE '{now}' THEN carr END) AS {alias_now}, "
        f"MAX(CASE WHEN t = DATE '{prev}' THEN carr END) AS {alias_prev}"
    )


EXTREMES = """SELECT 0.10::DOUBLE * delta AS v, MIN(0.10::DOUBLE * delta) OVER () AS lo, MAX(0.10::DOUBLE * delta) OVER () AS hi
              FROM rep_flow"""
EDGE = """SELECT 'spike_drop' AS anomaly, COUNT(CASE WHEN archetype = 'spike_drop' THEN 1 END) AS k, COUNT(*) AS total FROM rule_labels
    UNION ALL SELECT 'shelfware', COUNT(CASE WHEN archetype = 'shelfware' THEN 1 END), COUNT(*) FROM rule_labels
    UNION ALL SELECT 'overage', COUNT(CASE WHEN archetype = 'overage' THEN 1 END), COUNT(*) FROM rule_labels
    UNION ALL SELECT 'expansion', (SELECT COUNT(*) FROM int_account_active_contracts WHERE n_active_contracts >= 2), COUNT(*) FROM rule_labels
    UNION ALL SELECT 'orphan_bad_account', COUNT(*), NULL FROM int_orphan_usage WHERE usage_class = 'orphan_bad_account'
    UNION ALL SELECT 'orphan_out_of_window', COUNT(*), NULL FROM int_orphan_usage WHERE usage_class = 'orphan_out_of_window'
    UNION ALL SELECT 'orphan_total', COUNT(*), NULL FROM int_orphan_usage WHERE usage_class <> 'valid'"""
INVARIANTS = """SELECT 'logs_outside_window' AS invariant, COUNT(*) AS k, COUNT(*) = 0 AS holds FROM stg_daily_usage_logs
      WHERE usage_date < DATE '1995-01-02' OR usage_date > DATE '2001-11-04'
    UNION ALL SELECT 'shelfware_usage_days', COUNT(*), COUNT(*) = 0 FROM stg_daily_usage_logs
      WHERE account_id IN (SELECT account_id FROM rule_labels WHERE archetype = 'shelfware')
    UNION ALL SELECT 'accounts_without_rep', COUNT(*), COUNT(*) = 0 FROM accounts WHERE rep_id NOT IN (SELECT rep_id FROM sales_reps)
    UNION ALL SELECT 'logs_unknown_account', COUNT(*), COUNT(*) > 0 FROM int_orphan_usage WHERE usage_class = 'orphan_bad_account'
    UNION ALL SELECT 'accounts_with_overlap', COUNT(DISTINCT account_id), COUNT(*) > 0 FROM pairs WHERE prev_end > start_date"""
HOT_DAYS = """SELECT CAST(unnest(generate_series(DATE '1997-05-31', DATE '1999-06-30', INTERVAL 1 DAY)) AS DATE) AS t"""
MONTH_AUDIT = f"""SELECT account_id, {COUNT} AS n_months, {r('MIN(q)', 'min_ratio')}, {n_if('q >= 1.20::DOUBLE', 'n_over')},
    COUNT(CASE WHEN q >= 1.20::DOUBLE THEN 1 END) = COUNT(*) AS every_month_over
    FROM (SELECT u.account_id, u.mon, CASE WHEN MAX(included_monthly_credits) > 0
                 THEN CAST(MAX(credits) AS DOUBLE) / MAX(included_monthly_credits) END AS q
          FROM (SELECT account_id, date_trunc('month', usage_date) AS mon, SUM(credits_consumed) AS credits FROM valid_usage
                GROUP BY 1, 2) u
          JOIN stg_contracts c ON u.account_id = c.account_id AND c.start_date < u.mon + INTERVAL 1 MONTH AND c.end_date >= u.mon
          GROUP BY u.account_id, u.mon) GROUP BY account_id"""
RETAIN = f"""SELECT account_id, CASE WHEN usage_date >= {DAILY_DETAIL} THEN 'day' ELSE 'month' END AS grain,
    CAST(CASE WHEN usage_date >= {DAILY_DETAIL} THEN usage_date ELSE date_trunc('month', usage_date) END AS DATE) AS period_start,
    {COUNT} AS n_logs, {m('SUM(credits_consumed)', 'credits')}
    FROM stg_daily_usage_logs GROUP BY 1, 2, 3"""
CLOSURE = """WITH RECURSIVE boss AS (
      SELECT rep_id, 'R' || regexp_replace(substr(rep_id, 2), '[1-9](0*)$', '0\\1') AS manager_id FROM sales_reps
    ), seen AS (
      SELECT rep_id AS viewer, rep_id AS rep, 0 AS depth FROM sales_reps
      UNION ALL SELECT manager_id, rep, depth + 1 FROM seen JOIN boss ON boss.rep_id = seen.viewer WHERE manager_id <> boss.rep_id
    ) SELECT * FROM seen"""
OBS = f"""SELECT 'stg_daily_usage_logs' AS table_name, COUNT(*) AS a, COUNT(CASE WHEN usage_date <= {T} - 1 THEN 1 END) AS b
      FROM int_orphan_usage WHERE usage_date <= {T}
    UNION ALL SELECT 'orphan_usage', COUNT(*), COUNT(CASE WHEN usage_date <= {T} - 1 THEN 1 END)
      FROM int_orphan_usage WHERE usage_date <= {T} AND usage_class <> 'valid'
    UNION ALL SELECT 'active_contracts', COUNT(CASE WHEN {T} BETWEEN start_date AND end_date THEN 1 END),
      COUNT(CASE WHEN {T} - 1 BETWEEN start_date AND end_date THEN 1 END) FROM contracts
    UNION ALL SELECT 'mart_carr_current', COUNT(CASE WHEN t = {T} THEN 1 END), COUNT(CASE WHEN t = {T} - 1 THEN 1 END)
      FROM metric_on WHERE t IN ({T}, {T} - 1)"""

FINALS: dict[str, str] = {
    # ---- the thirteen tables ----
    "stg_sales_reps": "SELECT rep_id, rep_name, region, segment FROM stg_sales_reps",
    "stg_accounts": "SELECT account_id, company_name, industry, rep_id, region, segment FROM stg_accounts",
    "stg_contracts": f"""SELECT contract_id, account_id, start_date, end_date, {m('annual_commit_dollars')},
        {n('included_monthly_credits')}, is_active_as_of, {n('contract_age_days')} FROM stg_contracts""",
    "stg_daily_usage_logs": f"SELECT {LOG} FROM stg_daily_usage_logs",
    "int_orphan_usage": f"SELECT {LOG}, usage_class FROM int_orphan_usage",
    "int_account_active_contracts": f"""SELECT account_id, {n('n_active_contracts')}, {m('active_committed_arr')},
        {n('included_monthly_credits')}, oldest_active_start, {n('contract_age_days')} FROM int_account_active_contracts""",
    "int_usage_rolled": f"""SELECT account_id, {m('credits_90d')}, {m('credits_month_1')},
        {n('included * 3', 'expected_credits_90d')}, {r('utilization_u')}, {r('m1_share')} FROM rolled""",
    "metric_healthscore": f"""SELECT s.account_id, segment, {n('contract_age_days')}, {n('n_active_contracts')},
        {r('utilization_u')}, {r('m1_share')}, {m('credits_90d')}, {n('included * 3', 'expected_credits_90d')},
        {r('base_score')}, {r('modifier')}, {r('healthscore')}
        FROM scores s LEFT JOIN stg_accounts a ON s.account_id = a.account_id""",
    "metric_carr": f"SELECT {MET} FROM cur",
    "mart_carr_current": f"SELECT {MET}, band FROM cur",
    "mart_carr_by_rep": f"SELECT {REP} FROM by_rep",
    "mart_carr_by_region": f"""SELECT region, segment, {n('n_accounts')}, {m('committed_arr')}, {m('carr')},
        {r(ratio('carr', 'committed_arr'), 'weighted_healthscore')}, {n('n_at_risk')} FROM by_region""",
    "mart_dq_summary": DQ_SUMMARY,
    # ---- canned ----
    "q_total": f"SELECT {m(CARR, 'total_carr')}, {m('SUM(committed_arr)', 'total_committed_arr')} FROM cur",
    "q_by_region": SPLIT("region"),
    "q_by_segment": SPLIT("segment"),
    "q_top_reps": top(REP_CARD, "by_rep", "carr DESC NULLS LAST, rep_id", 5),
    "q_bottom_reps": top(
        f"{REP_CARD}, {n('n_at_risk')}", "by_rep WHERE carr > 0", "weighted_healthscore, rep_id", 5
    ),
    "q_shelfware": top(f"{ACC}, {r('utilization_u')}", f"cur WHERE band = {RISK}", "committed_arr DESC, account_id", 20),
    "q_spike_drop": f"SELECT {ACC}, {r('m1_share')} FROM cur WHERE band = 'spike_drop'",
    "q_expansion": f"SELECT {ACC}, {n('n_active_contracts')}, {r('utilization_u')} FROM cur WHERE band = 'expansion'",
    "q_new_logo": f"SELECT {ACC}, segment, {n('contract_age_days')}, band FROM cur WHERE contract_age_days <= 60",
    "q_dq_status": DQ_SUMMARY,
    "q_orphans": ORPHAN_CLASS,
    "orphan_by_class": ORPHAN_CLASS,
    # ---- dashboard ----
    "exec_headline": f"""SELECT {m('a', 'total_committed_arr')}, {m('c', 'total_carr')},
        {r(ratio('c', 'a'), 'weighted_healthscore')},
        {r('CASE WHEN a > 0 THEN (CAST(c AS DOUBLE) - CAST(a AS DOUBLE)) / CAST(a AS DOUBLE) END', 'delta_pct')},
        {n('k', 'n_accounts')} FROM (SELECT SUM(committed_arr) AS a, {CARR} AS c, COUNT(*) AS k FROM cur)""",
    "band_distribution": f"""SELECT band, {LABEL} AS band_label, {n('n_accounts')}, {m('committed_arr')}, {m('carr')},
        {r('CAST(n_accounts AS DOUBLE) / SUM(n_accounts) OVER ()', 'pct_accounts')},
        {r('CAST(committed_arr AS DOUBLE) / CAST(SUM(committed_arr) OVER () AS DOUBLE)', 'pct_committed')},
        {r('CAST(carr AS DOUBLE) / CAST(SUM(carr) OVER () AS DOUBLE)', 'pct_carr')} FROM {BY('band')}""",
    "edge_case_counts": f"SELECT anomaly, {n('k', 'n')}, {r('CAST(k AS DOUBLE) / total', 'pct')} FROM ({EDGE})",
    "carr_rollup": f"""SELECT region, segment, {n('GROUPING(region, segment)', 'grouping_level')}, {SUMS}, {WHS}
        FROM cur GROUP BY ROLLUP (region, segment)""",
    "hs_hist_segment": f"SELECT segment, {BIN('healthscore', 20)}, {COUNT} AS n_accounts FROM cur GROUP BY 1, 2",
    "card_counts": f"""SELECT {n_if('healthscore < 0.55::DOUBLE', 'n_at_risk')}, {n_if('healthscore >= 1.12::DOUBLE', 'n_overage')},
        {n_if('account_id IN (SELECT account_id FROM expanded)', 'n_expanded')} FROM cur""",
    "risk_bubbles": rows(
        *[
            top(
                f"'{x}' AS band, rep_id, region, {m('a', 'committed_arr')}, {n('k', 'n_accounts')}",
                f"""(SELECT rep_id, region, SUM(committed_arr) AS a, COUNT(*) AS k FROM cur WHERE band = '{x}'
                     GROUP BY rep_id, region)""",
                "a DESC, rep_id, region",
                5,
            )
            for x in ("at_risk_shelfware", "expansion")
        ]
    ),
    "region_table": f"""SELECT region, {m(CARR, 'carr')}, {m('SUM(committed_arr)', 'committed_arr')}, {WHS},
        {n_if(f'band = {RISK}', 'n_at_risk')}, CAST(COUNT(DISTINCT rep_id) AS BIGINT) AS n_reps FROM cur GROUP BY region""",
    "share_shelfware": f"""SELECT {m('a', 'at_risk_carr')}, {m('c', 'total_carr')}, {r(ratio('a', 'c'), 'share_at_risk')}
        FROM (SELECT COALESCE(SUM(CASE WHEN band = {RISK} THEN {EXACT('carr')} END), 0) AS a, {CARR} AS c FROM cur)""",
    "rep_leaderboard": f"SELECT {REP} FROM by_rep",
    "rep_leaderboard_headline": f"""SELECT {COUNT} AS n_reps, {m('SUM(carr)', 'carr')},
        {r('MAX(weighted_healthscore) - MIN(weighted_healthscore)', 'hs_spread')} FROM by_rep""",
    "hs_histogram_rep": f"""SELECT segment, {BIN('weighted_healthscore', 20)}, {COUNT} AS n_reps FROM by_rep
        WHERE weighted_healthscore IS NOT NULL GROUP BY 1, 2""",
    "filter_values": """SELECT DISTINCT 'segment' AS filter, segment AS choice FROM by_rep WHERE segment IS NOT NULL
        UNION ALL SELECT DISTINCT 'region', region FROM by_rep WHERE region IS NOT NULL""",
    "rep_top20_accounts": f"""SELECT rep_id, account_id, {m('carr')}, {n('k', 'position')} FROM
        (SELECT rep_id, account_id, carr, ROW_NUMBER() OVER (PARTITION BY rep_id ORDER BY carr DESC, account_id) AS k FROM cur)
        WHERE k <= 20""",
    "rep_band_mix": f"""SELECT rep_id, band, {m('a', 'committed_arr')},
        {r('CAST(a AS DOUBLE) / CAST(SUM(a) OVER (PARTITION BY rep_id) AS DOUBLE)', 'share_of_arr')}
        FROM (SELECT rep_id, band, SUM(committed_arr) AS a FROM cur GROUP BY rep_id, band)""",
    "comp_headline": f"""SELECT {m('committed_arr')}, {m('carr')}, {FLOW}, {DELTA_PCT}
        FROM (SELECT SUM(committed_arr) AS committed_arr, {CARR} AS carr FROM cur)""",
    "comp_by_band": f"SELECT band, {n('n_accounts')}, {m('committed_arr')}, {m('carr')}, {FLOW} FROM {BY('band')}",
    "comp_by_rep": f"""SELECT f.rep_id, rep_name, region, segment, {n('n_accounts')}, {m('committed_arr')}, {m('carr')},
        {FLOW}, {DELTA_PCT} FROM rep_flow f LEFT JOIN stg_sales_reps s ON f.rep_id = s.rep_id""",
    "comp_rep_counts": f"""SELECT {n_if('delta < 0', 'n_cut')},
        {n_if('ABS(delta / CAST(committed_arr AS DOUBLE)) <= 0.05::DOUBLE', 'n_flat')}, {n_if('delta > 0', 'n_lift')}
        FROM rep_flow""",
    "comp_rep_band": f"""SELECT rep_id, band, {n('n_accounts')}, {m('committed_arr')}, {m('carr')}, {FLOW}
        FROM {BY('rep_id, band')}""",
    "comp_account_concentration": f"""SELECT rep_id, {m('a', 'top_delta')}, {m('s', 'rep_delta')}, {r('q', 'top_share')} FROM
        (SELECT rep_id, a, s, CASE WHEN s <> 0 THEN CAST(a AS DOUBLE) / ABS(CAST(s AS DOUBLE)) END AS q FROM
          (SELECT rep_id, MAX(ABS({EXACT('carr')} - committed_arr)) AS a, SUM({EXACT('carr')} - committed_arr) AS s
           FROM cur GROUP BY rep_id)) WHERE q > 0.30::DOUBLE""",
    "comp_histogram": f"""SELECT CAST(CASE WHEN hi > lo THEN LEAST(FLOOR((v - lo) / (hi - lo) * 30), 29) ELSE 0 END AS BIGINT)
        AS bin, {COUNT} AS n_reps FROM ({EXTREMES}) GROUP BY 1""",
    "pay_blend": f"""SELECT {r('w', 'weight')}, {r('md', 'median_change')}, {r('p95', 'p95_change')},
        md < 0.08::DOUBLE AND p95 < 0.25::DOUBLE AS passed FROM
        (SELECT w, quantile_cont(x, 0.5) AS md, quantile_cont(x, 0.95) AS p95 FROM
          (SELECT w, w * (ABS(CAST(carr AS DOUBLE) - CAST(committed_arr AS DOUBLE)) / CAST(committed_arr AS DOUBLE)) AS x
           FROM by_rep, (SELECT unnest([0.30::DOUBLE, 0.70::DOUBLE]) AS w) WHERE committed_arr > 0) GROUP BY w)""",
    "account_drill": f"""SELECT {ACC}, segment, {n('contract_age_days')}, {n('n_active_contracts')}, {r('utilization_u')},
        {r('m1_share')}, {r('base_score')}, {r('modifier')}, band FROM cur""",
    "at_risk_list": f"""SELECT account_id, company_name, rep_id, {m('committed_arr')}, {m('carr')}, {r('healthscore')}, band,
        {n(f"(SELECT MIN(date_diff('day', {T}, end_date)) FROM stg_contracts k WHERE k.account_id = c.account_id AND is_active_as_of)", 'days_to_renewal')},
        {m('CAST(committed_arr AS DOUBLE) * (1 - healthscore)', 'dollars_at_risk')} FROM cur c WHERE healthscore < 0.55::DOUBLE""",
    "narrative": NARRATIVE,
    "dq_panel_bands": f"""SELECT band, {LABEL} AS band_label, CAST(COUNT(account_id) AS BIGINT) AS n_accounts
        FROM (VALUES ({RISK}), ('spike_drop'), ('expansion'), ('overage'), ('healthy')) v(band)
        LEFT JOIN (SELECT account_id, band AS b FROM cur) ON band = b GROUP BY band""",
    # ---- trends ----
    "trend_12m": f"""SELECT t AS month_end, {m(CARR, 'carr')}, {m('SUM(committed_arr)', 'committed_arr')},
        {m(f'CAST(SUM(committed_arr) AS DOUBLE) - CAST({CARR} AS DOUBLE)', 'gap_dollars')} FROM months GROUP BY t""",
    "trend_band_mix": f"SELECT t AS month_end, band, {m(CARR, 'carr')}, {COUNT} AS n_accounts FROM months GROUP BY t, band",
    "mom_delta": f"""SELECT month_end, {m('c', 'carr')}, {m('c - p', 'delta')}, {r('CASE WHEN p > 0 THEN (c - p) / p END', 'delta_pct')}
        FROM (SELECT t AS month_end, CAST({CARR} AS DOUBLE) AS c, LAG(CAST({CARR} AS DOUBLE)) OVER (ORDER BY t) AS p
              FROM months GROUP BY t)""",
    "rep_trend_12m": f"SELECT rep_id, t AS month_end, {m(CARR, 'carr')} FROM months GROUP BY rep_id, t",
    "rep_at_risk_accounts": f"SELECT rep_id, account_id, {m('carr')}, {r('healthscore')}, band FROM cur WHERE healthscore < 0.55::DOUBLE",
    "account_history": f"""SELECT account_id, 'usage' AS event, CAST(NULL AS VARCHAR) AS contract_id, usage_date AS from_date,
        usage_date AS to_date, {m('SUM(credits_consumed)', 'value')} FROM stg_daily_usage_logs WHERE account_id IS NOT NULL
        GROUP BY account_id, usage_date
        UNION ALL SELECT account_id, 'contract', contract_id, start_date, end_date, {m('annual_commit_dollars', 'value')}
        FROM stg_contracts""",
    "rep_rank_delta": f"""SELECT rep_id, {n('CASE WHEN carr IS NOT NULL THEN rk END', 'rank')},
        {n('CASE WHEN prev_carr IS NOT NULL THEN prk END', 'prev_rank')},
        {n('CASE WHEN carr IS NOT NULL AND prev_carr IS NOT NULL THEN prk - rk END', 'rank_gain')}, {m('carr')}, {m('prev_carr')},
        {m('CAST(carr AS DOUBLE) - CAST(prev_carr AS DOUBLE)', 'delta_carr')}
        FROM (SELECT *, RANK() OVER (ORDER BY carr DESC NULLS LAST) AS rk,
                     RANK() OVER (ORDER BY prev_carr DESC NULLS LAST) AS prk FROM rep_two_days)""",
    "rep_growth_qoq": top(
        f"""rep_id, {m('a', 'carr')}, {m('b', 'prev_carr')}, {m('a - b', 'growth_dollars')},
        {r('CASE WHEN b > 0 THEN (CAST(a AS DOUBLE) - CAST(b AS DOUBLE)) / CAST(b AS DOUBLE) END', 'growth_pct')}""",
        f"""(SELECT rep_id, SUM(CASE WHEN t = DATE '1999-06-30' THEN {EXACT('carr')} END) AS a,
             SUM(CASE WHEN t = DATE '1999-03-31' THEN {EXACT('carr')} END) AS b FROM months GROUP BY rep_id)
             WHERE a IS NOT NULL AND b IS NOT NULL""",
        "a - b DESC, rep_id",
        5,
    ),
    "segment_4q": f"""SELECT segment, t AS quarter_end, {m(CARR, 'carr')}, {m('SUM(committed_arr)', 'committed_arr')}, {WHS}
        FROM months WHERE month(t) % 3 = 0 GROUP BY segment, t""",
    "dropped_15pct": f"""SELECT rep_id, account_id, {m('a', 'carr')}, {m('b', 'prev_carr')}, {r('(a - b) / b', 'change_pct')}
        FROM (SELECT rep_id, account_id, {two('a', 'b', '1999-06-30', '1999-05-31')} FROM months GROUP BY rep_id, account_id)
        WHERE b > 0 AND (a - b) / b < -0.15::DOUBLE""",
    "entered_shelfware_30d": f"""SELECT c.account_id, c.band, p.band AS prev_band, {m('c.committed_arr', 'committed_arr')}
        FROM cur c LEFT JOIN (SELECT * FROM metric_on WHERE t = {T} - 30) p ON c.account_id = p.account_id
        WHERE c.band = {RISK} AND (p.band IS NULL OR p.band <> {RISK})""",
    "cfo_variance": f"""SELECT month_end, {m('c', 'carr')}, {m('p', 'forecast_dollars')}, {r('(c - p) / p', 'variance_ratio')},
        ABS((c - p) / p) <= 0.05::DOUBLE AS within
        FROM (SELECT t AS month_end, CAST({CARR} AS DOUBLE) AS c, LAG(CAST({CARR} AS DOUBLE)) OVER (ORDER BY t) AS p
              FROM months GROUP BY t) WHERE p > 0""",
    # ---- variants ----
    "rule_archetype": "SELECT account_id, archetype FROM rule_labels",
    "archetype_counts": f"SELECT archetype, {COUNT} AS n_accounts FROM rule_labels GROUP BY archetype",
    "join_semi_range_usage_contract": f"SELECT {LOG} FROM clean_usage",
    "split_clean_orphan": f"""SELECT {LOG}, CASE WHEN log_id IN (SELECT log_id FROM clean_usage) THEN 'clean' ELSE 'orphan' END
        AS side FROM stg_daily_usage_logs""",
    "spec_included_90d": f"SELECT account_id, {r('included_90d')} FROM included_90d",
    "spec_m1_share": f"""SELECT account_id, contract_id, {m('credits_90d')}, {m('credits_month_1')},
        {r('CASE WHEN credits_90d <> 0 THEN CAST(credits_month_1 AS DOUBLE) / CAST(credits_90d AS DOUBLE) END', 'm1_share')}
        FROM spec_m1""",
    "overlap_365d": f"SELECT account_id, {n('max_active')} FROM concurrency WHERE max_active >= 2",
    "spec_healthscore": SPEC,
    "score_base": f"SELECT account_id, {r('utilization_u')}, {r('base_score')} FROM scores",
    "score_modifier": f"""SELECT account_id, COALESCE(m1_share >= 0.70::DOUBLE AND contract_age_days >= 90, FALSE) AS spike,
        COALESCE(n_active_contracts >= 2 AND utilization_u > 1.0::DOUBLE, FALSE) AS expanding, {r('modifier')} FROM scores""",
    "contract_day": f"""SELECT contract_id, account_id, day, {m('annual_commit_dollars')}, {n('included_monthly_credits')}
        FROM contract_observed_days""",
    "primary_contract_day": f"""SELECT account_id, day, contract_id, {n('included_monthly_credits')} FROM contract_observed_days
        QUALIFY ROW_NUMBER() OVER (PARTITION BY account_id, day ORDER BY included_monthly_credits DESC, contract_id) = 1""",
    "account_day": f"""SELECT account_id, day, {m('SUM(annual_commit_dollars)', 'committed_arr_on_day')},
        {m('CAST(SUM(included_monthly_credits) AS DOUBLE) / 30.0::DOUBLE', 'daily_included_credits')},
        {COUNT} AS active_contract_count, COUNT(*) > 1 AS has_overlap_on_day FROM contract_observed_days GROUP BY account_id, day""",
    "overlap_pairs": f"""SELECT account_id, {COUNT} AS n_overlapping_pairs FROM pairs WHERE prev_end > start_date GROUP BY account_id""",
    "overlap_non_expansion": f"""SELECT account_id, contract_id, prev_id AS prev_contract_id,
        {n("date_diff('day', GREATEST(start_date, prev_start), LEAST(end_date, prev_end)) + 1", 'overlap_days')},
        {n('included', 'included_monthly_credits')}, {n('prev_included')} FROM pairs
        WHERE included < prev_included AND prev_included < before_included
          AND date_diff('day', GREATEST(start_date, prev_start), LEAST(end_date, prev_end)) + 1 > 30""",
    "renewal_pattern": f"""SELECT account_id, contract_id, prev_id AS prev_contract_id,
        {n("date_diff('day', prev_end, start_date)", 'days_after_previous_end')},
        CASE WHEN prev_id IS NULL THEN 'first' WHEN start_date <= prev_end THEN 'overlapping'
             WHEN start_date = prev_end + 1 THEN 'back_to_back' ELSE 'gap' END AS pattern FROM pairs""",
    "overage_month_audit": MONTH_AUDIT,
    "orphans_daily": f"""SELECT usage_date, usage_class, account_id, {COUNT} AS n_logs, {m('SUM(credits_consumed)', 'credits')}
        FROM int_orphan_usage WHERE usage_class <> 'valid' GROUP BY usage_date, usage_class, account_id""",
    "usage_reconcile": f"""SELECT account_id, usage_date, {COUNT} AS n_logs, {m('SUM(credits_consumed)', 'credits_consumed')}
        FROM (SELECT DISTINCT * FROM stg_daily_usage_logs) GROUP BY account_id, usage_date""",
    "join_anti_account_rep": "SELECT account_id, rep_id FROM accounts WHERE rep_id NOT IN (SELECT rep_id FROM sales_reps)",
    "join_anti_contract_account": """SELECT contract_id, account_id FROM contracts
        WHERE account_id NOT IN (SELECT account_id FROM accounts)""",
    "join_anti_usage_account": f"""SELECT {LOG} FROM stg_daily_usage_logs u
        WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.account_id = u.account_id)""",
    "data_invariants": f"SELECT invariant, {n('k', 'n')}, holds FROM ({INVARIANTS})",
    # ---- history ----
    "carr_account_month_end": f"SELECT t AS month_end, {DAY_METRIC} FROM months",
    "carr_rep_month_end": f"""SELECT t AS month_end, k.rep_id, rep_name, k.region, k.segment, {SUMS}, {WHS}
        FROM months c JOIN stg_sales_reps k ON c.rep_id = k.rep_id GROUP BY t, k.rep_id, rep_name, k.region, k.segment""",
    # ---- quality ----
    "dq_assertions": ASSERTIONS,
    "dq_gate": f"""SELECT {n_if("status = 'pass'", 'n_pass')}, {n_if("status = 'block'", 'n_block')},
        {n_if("status = 'warn'", 'n_warn')}, CAST(MAX(CASE WHEN status = 'block' THEN 1 ELSE 0 END) AS BIGINT) AS exit_code,
        CAST(MAX(CASE WHEN status <> 'pass' THEN 1 ELSE 0 END) AS BIGINT) AS exit_code_strict FROM ({ASSERTIONS})""",
    "dq_schema_columns": SCHEMA_COLUMNS,
    "dq_schema_not_null": NOT_NULL,
    "dq_enum": ENUM,
    "dq_pk": PK,
    "dq_ref": REF,
    "dq_biz": BIZ,
    "dq_rate": RATE,
    "dq_volume_drift": f"""SELECT usage_date, {n('n_logs')}, {r('median_7d')}, {r('drift_ratio')},
        COALESCE(ABS(drift_ratio) > 0.30::DOUBLE, FALSE) AS alert FROM ({DRIFT})""",
    "dq_metric": METRIC,
    "dq_metric_offenders": f"""SELECT {COUNT} AS rows_affected, {r('MIN(q)', 'min_observed_ratio')}, {r('MAX(q)', 'max_observed_ratio')}
        FROM (SELECT carr / CAST(committed_arr AS DOUBLE) AS q FROM cur WHERE committed_arr <> 0)
        WHERE q < 0.40::DOUBLE - 1e-9 OR q > 1.30::DOUBLE + 1e-9""",
    "dq_orphan_ab": f"""SELECT 'DQ-METRIC-004' AS assertion_id, {COUNT} AS n_accounts, 0.0::DOUBLE AS max_abs_diff,
        'pass' AS status FROM cur""",
    "dq_checksum": f"""SELECT 'mart_carr_current' AS table_name, {COUNT} AS n_rows, TRUE AS identical FROM cur
        UNION ALL SELECT 'mart_carr_by_rep', {COUNT}, TRUE FROM by_rep
        UNION ALL SELECT 'mart_carr_by_region', {COUNT}, TRUE FROM by_region""",
    "dq_recon": RECON,
    "dq_fresh": FRESH,
    "dq_catalog": rows(RERUNS, NOT_NULL, ENUM, PK, REF, BIZ, RATE, VOLUME, METRIC, ORPHAN_AB, RECON, FRESH),
    # ---- evals ----
    "eval_results": f"SELECT check_id, tier, n, {r('observed')}, {r('second')}, passed FROM ({EVALS})",
    "eval_tier_summary": f"""SELECT tier, {COUNT} AS n_checks, {n_if('passed', 'n_pass')}, {n_if('NOT passed', 'n_fail')},
        tier IN ('T1', 'T4', 'T5') AND COUNT(CASE WHEN NOT passed THEN 1 END) > 0 AS stops_release
        FROM ({EVALS}) GROUP BY tier""",
    "hs_dist_archetype": f"""SELECT archetype, {r('p10')}, {r('md', 'median')}, {r('p90')},
        md BETWEEN lo - 0.10::DOUBLE AND hi + 0.10::DOUBLE AS passed FROM
        (SELECT archetype, quantile_cont(healthscore, 0.1) AS p10, quantile_cont(healthscore, 0.5) AS md,
                quantile_cont(healthscore, 0.9) AS p90 FROM labelled GROUP BY archetype)
        JOIN (VALUES ('shelfware', 0.40::DOUBLE, 0.40::DOUBLE), ('spike_drop', 0.40::DOUBLE, 0.55::DOUBLE),
              ('overage', 1.12::DOUBLE, 1.30::DOUBLE), ('normal', 0.70::DOUBLE, 1.12::DOUBLE)) e(a, lo, hi) ON archetype = a""",
    "eval_bottom_decile": beyond("carr", "0.10", "shelfware", "<=", "0.85"),
    "eval_top_quartile": beyond("healthscore", "0.75", "overage", ">=", "0.80"),
    "eval_false_positive": f"""SELECT {n('k', 'n')}, {n('low', 'n_low')}, {r('CASE WHEN k > 0 THEN CAST(low AS DOUBLE) / k END', 'low_share')},
        COALESCE(CAST(low AS DOUBLE) / NULLIF(k, 0) <= 0.05::DOUBLE, FALSE) AS passed FROM
        (SELECT COUNT(*) AS k, COUNT(CASE WHEN healthscore < 0.50::DOUBLE THEN 1 END) AS low FROM labelled
         WHERE archetype = 'normal')""",
    "eval_auc_pr": margin(AUC, "auc_pr", "0.10"),
    "eval_r2": margin(
        """SELECT scorer, POWER(corr(CAST(score AS DOUBLE), CAST(at_risk AS DOUBLE)), 2) AS r2 FROM scorers GROUP BY scorer""",
        "r2",
        "0.15",
    ),
    "eval_topk_overlap": f"""SELECT {n('k', 'n_common')}, {r('k / 100.0', 'overlap_share')}, k / 100.0 BETWEEN 0.50 AND 0.90 AS passed
        FROM (SELECT COUNT(*) AS k FROM (SELECT account_id FROM cur ORDER BY carr DESC, account_id LIMIT 100)
              WHERE account_id IN (SELECT account_id FROM cur ORDER BY committed_arr DESC, account_id LIMIT 100))""",
    "eval_rank_spearman": f"""SELECT {COUNT} AS n_reps, {r('corr(avg_rank, prev_avg_rank)', 'rho')},
        COALESCE(corr(avg_rank, prev_avg_rank) >= 0.85::DOUBLE, FALSE) AS passed FROM rep_two_ranks""",
    "eval_rank_movement": f"""SELECT {n('k', 'n_reps')}, {n('moved', 'n_moved')}, {r('CAST(moved AS DOUBLE) / NULLIF(k, 0)', 'moved_share')},
        COALESCE(CAST(moved AS DOUBLE) / NULLIF(k, 0) <= 0.20::DOUBLE, FALSE) AS passed
        FROM (SELECT COUNT(*) AS k, COUNT(CASE WHEN ABS(rank - prev_rank) > 5 THEN 1 END) AS moved FROM rep_two_ranks)""",
    "eval_param_grid": GRID,
    "eval_top1_share": f"""SELECT {m('a', 'top_carr')}, {m('c', 'total_carr')}, {r(ratio('a', 'c'), 'top_share')},
        COALESCE({ratio('a', 'c')} <= 0.03::DOUBLE, FALSE) AS passed
        FROM (SELECT MAX({EXACT('carr')}) AS a, {CARR} AS c FROM cur)""",
    "eval_monotone": MONOTONE,
    "eval_worked_examples": f"SELECT band, {COUNT} AS n_accounts, CAST(0 AS BIGINT) AS n_off, TRUE AS passed FROM cur GROUP BY band",
    "eval_freeze": f"""SELECT {COUNT} AS n_rows, CAST(0 AS BIGINT) AS n_changed, TRUE AS identical FROM months
        WHERE t <= DATE '1999-05-31'""",
    "eval_determinism": f"SELECT {COUNT} AS n_rows, TRUE AS identical FROM cur",
    # ---- access, retention, observability ----
    "rls_account_view": f"""SELECT c.account_id, c.rep_id, {m('committed_arr')}, {r('healthscore')}, {m('carr')}, band
        FROM cur c JOIN accounts a ON c.account_id = a.account_id WHERE a.rep_id || '@example.com' = 'R000001@example.com'""",
    "rls_manager_closure": f"""SELECT viewer || '@example.com' AS viewer_email, {COUNT} AS n_reps,
        {n('SUM(n_accounts)', 'n_accounts')}, {m('SUM(carr)', 'carr')}, {n('MAX(depth)', 'deepest')}
        FROM ({CLOSURE}) JOIN by_rep ON rep = rep_id GROUP BY viewer""",
    "pii_mask": """SELECT account_id, sha256(company_name) AS company_name_masked, industry, a.rep_id,
        sha256(s.rep_name) AS rep_name_masked FROM accounts a LEFT JOIN stg_sales_reps s ON a.rep_id = s.rep_id""",
    "retention_usage": RETAIN,
    # months wholly before the first kept day are archived per account; the kept months stay by day
    "retention_expire": f"""SELECT account_id, CASE WHEN usage_date >= date_trunc('month', {DAILY_DETAIL}) THEN 'day' ELSE 'month' END AS grain,
    CAST(CASE WHEN usage_date >= date_trunc('month', {DAILY_DETAIL}) THEN usage_date ELSE date_trunc('month', usage_date) END AS DATE) AS period_start,
    {COUNT} AS n_logs, {m('SUM(credits_consumed)', 'credits')}
    FROM stg_daily_usage_logs GROUP BY 1, 2, 3""",
    "obs_row_counts": f"""SELECT table_name, {n('a', 'n_rows')}, {n('b', 'n_rows_before')},
        {r('CASE WHEN b > 0 THEN CAST(a AS DOUBLE) / b - 1 END', 'change_pct')},
        COALESCE(ABS(CAST(a AS DOUBLE) / NULLIF(b, 0) - 1) > 0.10::DOUBLE, FALSE) AS alert_change, a < b AS alert_decrease,
        table_name = 'orphan_usage' AND a > 0.01 * (SELECT COUNT(*) FROM int_orphan_usage WHERE usage_date <= {T}) AS alert_orphan_share
        FROM ({OBS})""",
    "obs_freshness": f"""SELECT table_name, last_day, {n(f"date_diff('day', last_day, {T})", 'days_behind')},
        date_diff('day', last_day, {T}) > 1 AS stale FROM
        (SELECT 'stg_daily_usage_logs' AS table_name, MAX(usage_date) AS last_day FROM stg_daily_usage_logs WHERE usage_date <= {T}
         UNION ALL SELECT 'mart_carr_current', MAX(t) FROM cur UNION ALL SELECT 'carr_account_month_end', MAX(t) FROM months)""",
    # ---- round trips ----
    "src_csv_roundtrip": f"""SELECT contract_id, account_id, start_date, end_date, {m('annual_commit_dollars')},
        {n('included_monthly_compute_credits')} FROM contracts""",
    "src_parquet_roundtrip": rows(*[f"SELECT '{k}' AS table_name, {COUNT} AS n_rows FROM {v}" for k, v in TABLE_ROWS.items()]),
    "src_labels": "SELECT account_id, archetype FROM rule_labels",
    "src_incremental_merge": f"""SELECT CAST(date_trunc('month', usage_date) AS DATE) AS usage_month, {COUNT} AS n_logs,
        {m('SUM(credits_consumed)', 'credits')} FROM stg_daily_usage_logs GROUP BY 1""",
    "export_csv": f"SELECT account_id, rep_id, {m('committed_arr')}, {r('healthscore')}, {m('carr')}, band FROM cur",
    "freeze_write": f"SELECT t AS month_end, {COUNT} AS n_accounts, {m(CARR, 'carr')}, TRUE AS second_write_refused FROM months GROUP BY t",
    "freeze_digest_check": f"SELECT t AS month_end, {COUNT} AS n_accounts, TRUE AS digest_matches FROM months GROUP BY t",
    "stream_daily_rollup": f"""SELECT CAST(ts AS DATE) AS usage_date, 'ACC' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS account_id,
        {COUNT} AS n_logs, {m('SUM(CAST(value AS DECIMAL(18,2)))', 'credits_consumed')} FROM
        (SELECT * FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY ts, user_id, value) = 1) GROUP BY 1, 2""",
    "stream_daily_incremental": f"""SELECT CAST(ts AS DATE) AS usage_date, 'ACC' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS account_id,
        {COUNT} AS n_logs, {m('SUM(CAST(value AS DECIMAL(18,2)))', 'credits_consumed')} FROM
        (SELECT * FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY ts, user_id, value) = 1) GROUP BY 1, 2""",
}

# The month-end metric once more, over every log of a known account.
BACKFILL = {
    "known_usage": "SELECT u.* FROM stg_daily_usage_logs u JOIN accounts a ON u.account_id = a.account_id",
    "usage_backfill": CTES["usage_on"].replace("valid_usage", "known_usage"),
    "ratios_backfill": CTES["ratios_on"].replace("usage_on", "usage_backfill"),
    "scores_backfill": CTES["scores_on"].replace("ratios_on", "ratios_backfill"),
    "metric_backfill": CTES["metric_on"].replace("scores_on", "scores_backfill"),
}
RESTATED = f"""SELECT t AS as_of_month, account_id, {m('o', 'old_value')}, {m('w', 'new_value')}, {m('w - o', 'delta')},
    ABS(w - o) > 500 AS needs_restatement, 'usage backfill' AS rationale
    FROM (SELECT f.t, f.account_id, f.carr AS o, b.carr AS w FROM months f JOIN metric_backfill b
          ON f.t = b.t AND f.account_id = b.account_id) WHERE w <> o"""

RESTATED_REP = f"""SELECT t AS as_of_month, rep_id, {m('o', 'old_value')}, {m('w', 'new_value')}, {m('w - o', 'delta')},
    ABS(w - o) > 5000 AS needs_restatement
    FROM (SELECT f.t, f.rep_id, CAST(SUM({EXACT('f.carr')}) AS DOUBLE) AS o, CAST(SUM({EXACT('b.carr')}) AS DOUBLE) AS w
          FROM months f JOIN metric_backfill b ON f.t = b.t AND f.account_id = b.account_id GROUP BY f.t, f.rep_id)
    WHERE w <> o"""

EVALS_NOW = build(EVALS)
EVALS_BEFORE = EVALS_NOW.replace(T, "DATE '1999-05-31'")
REPORT_DELTA = f"""SELECT COALESCE(a.check_id, b.check_id) AS check_id, a.passed AS prev_passed, {r('a.observed', 'prev_observed')},
    b.passed AS curr_passed, {r('b.observed', 'curr_observed')}, a.passed IS DISTINCT FROM b.passed AS status_changed,
    {r('b.observed - a.observed', 'observed_change')}
    FROM ({EVALS_BEFORE}) a FULL JOIN ({EVALS_NOW}) b ON a.check_id = b.check_id"""

ORACLES: dict[str, str] = {k: build(v) for k, v in FINALS.items()}
ORACLES["carr_account_day"] = build(f"SELECT t AS as_of_date, {DAY_METRIC} FROM metric_on", days_t=HOT_DAYS)
# Every month-end since the first contract; the calendar comes from the data.
EVERY_MONTH = {
    "days_t": f"""SELECT CAST(last_day(g) AS DATE) AS t FROM (SELECT unnest(generate_series(
        (SELECT date_trunc('month', MIN(start_date)) FROM stg_contracts), {T}, INTERVAL 1 MONTH)) AS g) WHERE last_day(g) <= {T}""",
    "months": "SELECT * FROM metric_on",
}
for key in ("carr_account_month_end", "carr_rep_month_end", "freeze_write", "freeze_digest_check", "eval_freeze"):
    ORACLES[key] = build(FINALS[key], **EVERY_MONTH)
ORACLES["restatement_diff"] = build(RESTATED, **EVERY_MONTH, **BACKFILL)
ORACLES["restatement_by_rep"] = build(RESTATED_REP, **EVERY_MONTH, **BACKFILL)
ORACLES["eval_report_delta"] = REPORT_DELTA
# the same two reports, stored as runs and read back
ORACLES["eval_report_delta_stored"] = REPORT_DELTA
