"""The wider catalogue of data-quality rules as result rows.

Row shape: assertion_id, severity (P0/P1/P2), status, observed_value, rows_affected, threshold, owning_team.
``observed_value`` is numeric here; ``sinks.append_results`` turns it into text for the result table.
"""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.edges import CARR_SUM
from ..operators.usage import BAD_ACCOUNT, OUT_OF_WINDOW, VALID
from ..sources import schemas
from . import models
from .history import listed, metric_on

# Rule id, tier, threshold in words, owning team.
RULES = {
    "DQ-SCHEMA-001": ("P0", "all present", "Data Platform"),
    "DQ-SCHEMA-002": ("P0", "declared types", "Data Platform"),
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
    "DQ-METRIC-005": ("P0", "identical", "Analytics Eng"),
    "DQ-METRIC-006": ("P0", "identical", "Analytics Eng"),
    "DQ-RECON-001": ("P0", "equal", "Analytics Eng"),
    "DQ-RECON-002": ("P0", "equal", "Analytics Eng"),
    "DQ-RECON-003": ("P1", "no decrease", "Analytics Eng"),
    "DQ-RECON-004": ("P1", "within 0.5%", "Finance Systems"),
    "DQ-FRESH-001": ("P0", ">= as-of date - 1", "Platform Eng"),
    "DQ-FRESH-002": ("P0", "<= 26 h", "Analytics Eng"),
    "DQ-FRESH-003": ("P0", "<= 2 days after month end", "Analytics Eng"),
}


def rule(name: str, observed: Column, affected: Column, ok: Column | None) -> Column:
    """One result line; ``ok`` None means the rule only reports."""
    tier, threshold, team = RULES[name]
    failed = "fail" if tier == "P0" else "warn"
    status = F.lit("pass") if ok is None else F.when(ok, "pass").otherwise(failed)
    return F.struct(
        F.lit(name).alias("assertion_id"),
        F.lit(tier).alias("severity"),
        status.alias("status"),
        observed.cast("double").alias("observed_value"),
        affected.cast("bigint").alias("rows_affected"),
        F.lit(threshold).alias("threshold"),
        F.lit(team).alias("owning_team"),
    )


def lines(frame: DataFrame, *rules: Column) -> DataFrame:
    return frame.select(F.inline(F.array(*rules)))


def stack(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def none_of(name: str, col: str) -> Column:
    return rule(name, F.col(col), F.col(col), F.col(col) == 0)


def total(frame: DataFrame, **cells: Column) -> DataFrame:
    return frame.agg(*[F.coalesce(c, F.lit(0)).alias(n) for n, c in cells.items()])


# ---- schema ----


def dq_schema_columns(b) -> DataFrame:
    """Each declared column of each source: its type against the declaration, with row and NULL counts."""
    out = []
    for table, want in schemas.SOURCES.items():
        df = b.sources[table]
        have = {f.name: f.dataType for f in df.schema.fields}
        nulls = [F.count_if(F.col(f.name).isNull()).alias(f.name) for f in want.fields if f.name in have]
        if table == "daily_usage_logs":
            counted = b.log_facts.select(F.col("n").alias("_n"), *[F.col(f"null_{c}").alias(c) for c in have])
        else:
            counted = df.agg(F.count("*").alias("_n"), *nulls)
        cells = [
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("expected_type"),
                F.lit(f.name in have).alias("present"),
                F.lit(have.get(f.name) == f.dataType).alias("type_matches"),
                F.col("_n").alias("n_rows"),
                (F.col(f.name) if f.name in have else F.lit(None)).cast("bigint").alias("n_nulls"),
            )
            for f in want.fields
        ]
        out.append(counted.select(F.inline(F.array(*cells))))
    return stack(*out)


def dq_schema_not_null(b) -> DataFrame:
    """NULLs in required columns, one scan per table."""
    out = []
    for table, want in schemas.SOURCES.items():
        required = [f.name for f in want.fields if not f.nullable]
        if table == "daily_usage_logs":
            out.append(b.log_facts.select(sum((F.col(f"null_{c}") for c in required), F.lit(0)).alias("n")))
            continue
        nulls = reduce(lambda x, y: x + y, [F.col(c).isNull().cast("bigint") for c in required])
        out.append(b.sources[table].agg(F.coalesce(F.sum(nulls), F.lit(0)).alias("n")))
    return lines(stack(*out).agg(F.sum("n").alias("n")), none_of("DQ-SCHEMA-003", "n"))


def dq_enum(b) -> DataFrame:
    bad = lambda c, known: F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(known))
    reps = b.sources["sales_reps"].agg(
        (bad("region", schemas.REGIONS) + bad("segment", schemas.SEGMENTS)).alias("n")
    )
    accounts = b.sources["accounts"].agg(bad("industry", schemas.INDUSTRIES).alias("n"))
    return lines(reps.unionByName(accounts).agg(F.sum("n").alias("n")), none_of("DQ-SCHEMA-004", "n"))


def dq_pk(b) -> DataFrame:
    keys = {"sales_reps": "rep_id", "accounts": "account_id", "contracts": "contract_id", "daily_usage_logs": "log_id"}
    dup = [b.sources[t].agg((F.count("*") - F.countDistinct(k)).alias("n")) for t, k in keys.items() if t != "daily_usage_logs"]
    dup.append(models.one_row([b.log_facts.select("n"), b.log_ids]).select((F.col("n") - F.col("n_ids")).alias("n")))
    return lines(stack(*dup).agg(F.sum("n").alias("n")), none_of("DQ-SCHEMA-005", "n"))


# ---- references ----


def orphan_share_by_day(b) -> DataFrame:
    return b.usage_daily.groupBy("usage_date").agg(
        F.sum("n_logs").alias("n_logs"),
        F.sum(F.when(F.col("usage_class") == BAD_ACCOUNT, F.col("n_logs")).otherwise(0)).alias("n_unknown"),
    )


def dq_ref(b) -> DataFrame:
    count = lambda df: df.agg(F.count("*").alias("n"))
    share = F.col("n_unknown") / F.col("n_logs")
    days = orphan_share_by_day(b).agg(F.max(share).alias("worst"), F.count_if(share >= 0.01).alias("n"))
    unowned = b.metric_carr.where(F.col("region").isNull())
    return stack(
        lines(count(b.orphan_accounts), none_of("DQ-REF-001", "n")),
        lines(count(b.orphan_contracts), none_of("DQ-REF-002", "n")),
        lines(days, rule("DQ-REF-003", F.col("worst"), F.col("n"), F.col("n") == 0)),
        lines(count(unowned), none_of("DQ-REF-004", "n")),
    )


# ---- business rules ----


def dq_biz(b) -> DataFrame:
    contracts = b.stg_contracts.agg(
        F.count_if(F.col("annual_commit_dollars") <= 0).alias("b1"),
        F.count_if(F.col("included_monthly_credits") <= 0).alias("b2"),
        F.count_if(F.col("end_date") <= F.col("start_date")).alias("b4"),
    )
    logs = b.log_facts.select(F.col("n_negative").alias("b3"), F.col("n_outside").alias("b5"))
    share = total(
        b.usage_daily,
        n=F.sum("n_logs"),
        out=F.sum(F.when(F.col("usage_class") == OUT_OF_WINDOW, F.col("n_logs"))),
    )
    ratio = F.when(F.col("n") > 0, F.col("out") / F.col("n")).otherwise(0.0)
    return stack(
        lines(
            contracts, none_of("DQ-BIZ-001", "b1"), none_of("DQ-BIZ-002", "b2"), none_of("DQ-BIZ-004", "b4")
        ),
        lines(logs, none_of("DQ-BIZ-003", "b3"), none_of("DQ-BIZ-005", "b5")),
        lines(share, rule("DQ-BIZ-006", ratio, F.col("out"), ratio < 0.01)),
    )


# ---- rates ----


def dq_rate(b) -> DataFrame:
    n_label = lambda a: F.count_if(F.col("archetype") == a)
    labels = b.rule_archetype.agg(
        F.count("*").alias("n_labels"), *[n_label(a).alias(a) for a in ("shelfware", "spike_drop", "overage")]
    )
    overlap = b.expanded_flag.agg(F.count("*").alias("expanded"))
    logs = total(
        b.usage_daily, n_logs=F.sum("n_logs"), orphans=F.sum(F.when(F.col("usage_class") != VALID, F.col("n_logs")))
    )
    row = models.one_row([labels, overlap, logs])

    def banded(name: str, col: str, low: float, high: float) -> Column:
        share = F.when(F.col("n_labels") > 0, F.col(col) / F.col("n_labels")).otherwise(0.0)
        return rule(name, share, F.col(col), share.between(low, high))

    expanded = F.when(F.col("n_labels") > 0, F.col("expanded") / F.col("n_labels"))
    orphan = F.when(F.col("n_logs") > 0, F.col("orphans") / F.col("n_logs")).otherwise(0.0)
    return lines(
        row,
        banded("DQ-RATE-001", "shelfware", 0.03, 0.15),
        banded("DQ-RATE-002", "spike_drop", 0.02, 0.08),
        banded("DQ-RATE-003", "overage", 0.08, 0.25),
        rule("DQ-RATE-004", expanded, F.col("expanded"), None),
        rule("DQ-RATE-005", orphan, F.col("orphans"), orphan < 0.01),
    )


def dq_volume_drift(b) -> DataFrame:
    """Logs per day against the median of the seven days before; the window runs over one row per calendar day."""
    days = b.usage_rollup.groupBy("usage_date").agg(F.sum("n_logs").alias("n_logs"))
    before = W.orderBy("usage_date").rowsBetween(-7, -1)
    med = F.expr("percentile(n_logs, 0.5)").over(before)
    return (
        days.withColumn("median_7d", med)
        .withColumn("drift_ratio", F.when(F.col("median_7d") > 0, F.col("n_logs") / F.col("median_7d") - 1))
        .withColumn("alert", F.coalesce(F.abs("drift_ratio") > 0.30, F.lit(False)))
    )


def volume_rule(b) -> DataFrame:
    drift = dq_volume_drift(b).agg(F.max(F.abs("drift_ratio")).alias("worst"), F.count_if("alert").alias("n"))
    return lines(drift, rule("DQ-RATE-006", F.col("worst"), F.col("n"), F.col("n") == 0))


# ---- metric ----


def dq_metric(b) -> DataFrame:
    p = b.p
    arr, carr = F.col("committed_arr").cast("double"), F.col("carr")
    outside = (carr < p.hs_floor * arr - 1e-6) | (carr > p.hs_cap * arr + 1e-6)
    row = b.mart_carr_current.agg(
        F.count_if(outside).alias("n_outside"),
        F.count_if(carr.isNull()).alias("n_null"),
        F.sum("committed_arr").alias("arr"),
        F.sum(carr.cast(CARR_SUM)).alias("carr"),
    )
    ratio = F.when(F.col("arr") > 0, F.col("carr").cast("double") / F.col("arr").cast("double"))
    return lines(
        row,
        none_of("DQ-METRIC-001", "n_outside"),
        rule("DQ-METRIC-002", ratio, F.lit(0), F.coalesce(ratio.between(p.hs_floor, p.hs_cap), F.lit(True))),
        none_of("DQ-METRIC-003", "n_null"),
    )


def dq_metric_offenders(b) -> DataFrame:
    """Accounts outside the bounds with the smallest and largest ratio seen."""
    p = b.p
    ratio = F.when(F.col("committed_arr") != 0, F.col("carr") / F.col("committed_arr").cast("double"))
    bad = b.mart_carr_current.withColumn("ratio", ratio).where(
        (F.col("ratio") < p.hs_floor - 1e-9) | (F.col("ratio") > p.hs_cap + 1e-9)
    )
    return bad.agg(
        F.count("*").alias("rows_affected"),
        F.min("ratio").alias("min_observed_ratio"),
        F.max("ratio").alias("max_observed_ratio"),
    )


def dq_orphan_ab(b) -> DataFrame:
    """The metric from all usage against the metric from usage without orphans, each classified on its own."""
    from .book import Book

    other = Book(b.sources, b.p)
    other.usage_rollup = b.usage_daily.where(F.col("usage_class") == VALID).drop("usage_class")
    left = b.metric_carr.select("account_id", F.col("carr").alias("with_orphans"))
    right = other.metric_carr.select("account_id", F.col("carr").alias("without"))
    gap = F.abs(F.coalesce("with_orphans", F.lit(0.0)) - F.coalesce("without", F.lit(0.0)))
    both = left.join(right, "account_id", "full_outer").agg(
        F.count("*").alias("n"), F.max(gap).alias("worst"), F.count_if(gap > 1e-6).alias("bad")
    )
    return both.select(
        F.lit("DQ-METRIC-004").alias("assertion_id"),
        F.col("n").alias("n_accounts"),
        F.col("worst").alias("max_abs_diff"),
        F.when(F.col("bad") == 0, "pass").otherwise("fail").alias("status"),
    )


def orphan_ab_rule(b) -> DataFrame:
    worst = F.coalesce("max_abs_diff", F.lit(0.0))
    return lines(dq_orphan_ab(b), rule("DQ-METRIC-004", worst, F.when(worst > 1e-6, 1).otherwise(0), worst <= 1e-6))


def checksum(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: row count and two folds of the row hashes."""
    h = F.xxhash64(*df.columns)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.bit_xor(h).alias("xor_hash"),
        F.sum(h.cast("decimal(38,0)")).alias("sum_hash"),
    )


def dq_checksum(b) -> DataFrame:
    """Fingerprints of the marts from two runs, the second over rows in another physical order.

    The marts take the logs without their ids, so the logs are dealt out anew by the other columns and no id travels.
    """
    from .book import Book

    orders = {n: df.columns for n, df in b.sources.items()} | {"daily_usage_logs": ["account_id", "date", "compute_credits_consumed"]}
    again = Book({n: df.repartition(F.xxhash64(*orders[n])) for n, df in b.sources.items()}, b.p).settled
    b = b.settled
    out = []
    for name in ("mart_carr_current", "mart_carr_by_rep", "mart_carr_by_region"):
        runs = stack(checksum(getattr(b, name)), checksum(getattr(again, name)))
        same = (
            (F.min("n_rows") == F.max("n_rows"))
            & F.min("xor_hash").eqNullSafe(F.max("xor_hash"))
            & F.min("sum_hash").eqNullSafe(F.max("sum_hash"))
        )
        out.append(runs.agg(F.lit(name).alias("table_name"), F.max("n_rows").alias("n_rows"), same.alias("identical")))
    return stack(*out)


# ---- reconciliation and freshness ----


def dq_recon(b) -> DataFrame:
    """Clean + orphan = raw; rep sums = account sums; mart rows do not fall day on day; total against a report.

    The external total is an input (``crm_total``); without one the raw contracts stand in for it.
    """
    b = b.settled
    p = b.p
    split = models.one_row(
        [
            total(b.usage_daily, classed=F.sum("n_logs")),
            b.log_facts.select(F.col("n").alias("raw")),
        ]
    )
    exact = lambda: F.sum(F.col("carr").cast(CARR_SUM))
    sums = models.one_row(
        [b.mart_carr_by_rep.agg(exact().alias("by_rep")), b.mart_carr_current.agg(exact().alias("by_account"))]
    )
    yesterday = p.as_of - timedelta(days=1)
    on = lambda d: F.count_if(F.col("as_of_date") == F.lit(d))
    rows = metric_on(b, listed([yesterday, p.as_of])).agg(on(p.as_of).alias("now"), on(yesterday).alias("before"))
    active = (F.col("start_date") <= F.lit(p.as_of)) & (F.col("end_date") >= F.lit(p.as_of))
    crm = b.sources.get("crm_total")
    report = (
        crm.agg(F.sum("dollars").alias("report"))
        if crm is not None
        else b.sources["contracts"].where(active).agg(F.sum("annual_commit_dollars").alias("report"))
    )
    commit = models.one_row([b.mart_carr_current.agg(F.sum("committed_arr").alias("ours")), report])
    gap = F.abs(F.col("raw") - F.col("classed"))
    diff = F.abs(F.col("by_rep").cast("double") - F.col("by_account").cast("double"))
    fall = F.greatest(F.col("before") - F.col("now"), F.lit(0))
    off = F.abs(F.col("ours").cast("double") / F.col("report").cast("double") - 1)
    return stack(
        lines(split, rule("DQ-RECON-001", gap, gap, gap == 0)),
        lines(sums, rule("DQ-RECON-002", diff, F.when(diff > 1e-6, 1).otherwise(0), diff <= 1e-6)),
        lines(rows, rule("DQ-RECON-003", F.col("now") - F.col("before"), fall, fall == 0)),
        lines(commit, rule("DQ-RECON-004", off, F.when(off > 0.005, 1).otherwise(0), off <= 0.005)),
    )


def dq_fresh(b) -> DataFrame:
    """Age of the logs, of the marts and of the month-end snapshots on the as-of date; nothing here reads a clock.

    With a ``run_log(table_name, written_at)`` among the sources the age of the oldest table counts at the end of the as-of date,
    else the day that the mart is stamped with. A month-end is due two days after it; due months that the
    month-end mart lacks are counted.
    """
    p = b.p
    behind = F.datediff(F.lit(p.as_of), F.col("last_day"))
    run_log = b.sources.get("run_log")
    if run_log is not None:
        last = run_log.groupBy("table_name").agg(F.max("written_at").alias("at")).agg(F.min("at").alias("at"))
        end = F.date_add(F.lit(p.as_of), 1).cast("timestamp")
        marts = last.select(((F.unix_timestamp(end) - F.unix_timestamp("at")) / 3600.0).alias("age"))
    else:
        stamped = b.mart_carr_current.agg(F.max("as_of_date").alias("last_day"))
        marts = stamped.select((F.datediff(F.lit(p.as_of), "last_day") * 24.0).alias("age"))
    due = [d for d in p.month_ends if d <= p.as_of - timedelta(days=2)]
    months = b.month_end_metric.where(F.col("as_of_date").isin(due)).agg(
        (F.lit(len(due)) - F.countDistinct("as_of_date")).alias("missing")
    )
    old = F.coalesce(F.col("age") > 26, F.lit(True))
    return stack(
        lines(b.log_facts, rule("DQ-FRESH-001", behind, F.when(behind > 1, 1).otherwise(0), behind <= 1)),
        lines(marts, rule("DQ-FRESH-002", F.col("age"), old.cast("int"), ~old)),
        lines(months, none_of("DQ-FRESH-003", "missing")),
    )


def schema_rules(b) -> DataFrame:
    """Missing columns and columns of another type, from one pass per source."""
    return lines(
        dq_schema_columns(b).agg(
            F.count_if(~F.col("present")).alias("missing"), F.count_if(~F.col("type_matches")).alias("mistyped")
        ),
        none_of("DQ-SCHEMA-001", "missing"),
        none_of("DQ-SCHEMA-002", "mistyped"),
    )


def rerun_rules(b) -> DataFrame:
    """The metric and the closed month-ends once more, from rows in another physical order and on the as-of date."""
    from .book import Book
    from .spec_evals import eval_freeze

    again = Book({n: df.repartition(F.xxhash64(*df.columns)) for n, df in b.sources.items() if n != "daily_usage_logs"}
                 | {"daily_usage_logs": b.sources["daily_usage_logs"]}, b.p)
    again.usage_rollup = b.usage_rollup.repartition(F.xxhash64("account_id", "usage_date"))
    runs = stack(checksum(b.mart_carr_current), checksum(again.mart_carr_current))
    off = (~F.min("sum_hash").eqNullSafe(F.max("sum_hash")) | (F.min("n_rows") != F.max("n_rows"))).cast("int")
    return stack(
        lines(runs.agg(off.alias("off")), none_of("DQ-METRIC-005", "off")),
        lines(eval_freeze(b), none_of("DQ-METRIC-006", "n_changed")),
    )


def dq_catalog(b) -> DataFrame:
    """Every rule of the catalogue, 34 in all, one row each."""
    b = b.settled
    parts = (schema_rules, rerun_rules, dq_schema_not_null, dq_enum, dq_pk, dq_ref, dq_biz, dq_rate, volume_rule, dq_metric, orphan_ab_rule,
             dq_recon, dq_fresh)
    return stack(*[f(b) for f in parts])
