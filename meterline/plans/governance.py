"""Row-level access, masking, retention and observability as table operations."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.edges import CARR_SUM
from ..operators.skew import salted_join
from ..operators.usage import VALID
from ..session import ready_for_checkpoint
from .history import listed, metric_on


def email(rep: str = "rep_id"):
    return F.concat(F.col(rep), F.lit("@example.com"))


# ---- access ----


def rep_book_visibility(b) -> DataFrame:
    """(viewer_email, account_id): a rep sees the accounts they own."""
    given = b.sources.get("rep_book_visibility")
    return given if given is not None else b.sources["accounts"].select(email().alias("viewer_email"), "account_id")


def rls_account_view(b) -> DataFrame:
    """The rows of the current mart that one viewer may see."""
    mine = rep_book_visibility(b).where(F.col("viewer_email") == b.p.viewer_email).select("account_id").distinct()
    return b.mart_carr_current.join(mine, "account_id", "left_semi").select(
        "account_id", "rep_id", "committed_arr", "healthscore", "carr", "band"
    )


def rep_manager(b) -> DataFrame:
    """(rep_id, manager_id); without a given table, a rep reports to the number with its last non-zero digit cleared."""
    given = b.sources.get("rep_manager")
    if given is not None:
        return given
    number = F.regexp_extract("rep_id", r"(\d+)$", 1)
    boss = F.concat(F.lit("R"), F.regexp_replace(number, "[1-9](0*)$", "0$1"))
    return b.sources["sales_reps"].select("rep_id", boss.alias("manager_id")).where("rep_id <> manager_id")


def manager_closure(b) -> DataFrame:
    """(viewer_id, rep_id, depth): each rep, and every rep below them, however deep.

    A level is one join of the reps reached so far with the reporting lines; levels are added until one is empty. Each
    rep has one manager, so no pair is reached twice; lines that close a circle raise ``ValueError``.
    """
    ready_for_checkpoint(b.spark)
    lines = rep_manager(b).select("rep_id", "manager_id")
    own = b.sources["sales_reps"].select(F.col("rep_id").alias("viewer_id"), "rep_id", F.lit(0).alias("depth"))
    up = lines.select(F.col("rep_id").alias("viewer_id"), "manager_id")
    out, level, depth = own, lines.select(F.col("manager_id").alias("viewer_id"), "rep_id").checkpoint(), 1
    while not level.isEmpty():
        if not level.where("viewer_id = rep_id").isEmpty():
            raise ValueError("the reporting lines have a circle")
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
        # Climb from the viewer to the viewer's own manager: unique on the reporting side.
        level = salted_join(level, up, ["viewer_id"], ["rep_id"], b.p.skew_salts, "inner").select(
            F.col("manager_id").alias("viewer_id"), "rep_id"
        ).checkpoint()
        depth += 1
    return out


def rls_manager_closure(b) -> DataFrame:
    """What each viewer sees in total, including the books of everyone below them."""
    book = b.mart_carr_by_rep.select("rep_id", "n_accounts", "committed_arr", "carr")
    seen = salted_join(manager_closure(b), book, ["rep_id"], ["viewer_id"], b.p.skew_salts, "inner")
    return seen.groupBy(email("viewer_id").alias("viewer_email")).agg(
        F.count("*").alias("n_reps"),
        F.sum("n_accounts").alias("n_accounts"),
        F.sum(F.col("carr").cast(CARR_SUM)).alias("carr"),
        F.max("depth").alias("deepest"),
    )


def pii_mask(b) -> DataFrame:
    """Accounts with their rep, names replaced by a digest."""
    digest = lambda c: F.sha2(F.col(c), 256)
    reps = b.stg_sales_reps.select("rep_id", digest("rep_name").alias("rep_name_masked"))
    return salted_join(b.sources["accounts"], reps, ["rep_id"], ["account_id"], b.p.skew_salts).select(
        "account_id", digest("company_name").alias("company_name_masked"), "industry", "rep_id", "rep_name_masked"
    )


# ---- retention ----


def retention_usage(b) -> DataFrame:
    """Daily detail inside the retention period, one row per account and month before it; logs without account too."""
    kept = F.col("usage_date") >= F.lit(b.p.retention_from)
    start = F.when(kept, F.col("usage_date")).otherwise(F.trunc("usage_date", "month"))
    return (
        b.usage_rollup.groupBy("account_id", F.when(kept, "day").otherwise("month").alias("grain"), start.alias("period_start"))
        .agg(F.sum("n_logs").alias("n_logs"), F.sum("credits_consumed").alias("credits"))
    )


# ---- observability ----


def obs_row_counts(b) -> DataFrame:
    """Rows of the day-stamped layers on the as-of date and the day before, with alerts."""
    p = b.p
    yesterday = p.as_of - timedelta(days=1)
    usage = b.usage_daily.where(F.col("usage_date") <= F.lit(p.as_of))
    n_logs = lambda extra: F.coalesce(F.sum(F.when(extra, F.col("n_logs"))), F.lit(0))
    old = F.col("usage_date") <= F.lit(yesterday)
    bad = F.col("usage_class") != VALID
    logs = usage.agg(
        n_logs(F.lit(True)).alias("now"), n_logs(old).alias("before"), n_logs(bad).alias("bad_now"),
        n_logs(bad & old).alias("bad_before"),
    )
    on = lambda d: F.count_if(F.col("as_of_date") == F.lit(d))
    mart = metric_on(b, listed([yesterday, p.as_of])).agg(on(p.as_of).alias("now"), on(yesterday).alias("before"))
    runs = lambda d: F.count_if((F.col("start_date") <= F.lit(d)) & (F.col("end_date") >= F.lit(d)))
    contracts = b.stg_contracts.agg(runs(p.as_of).alias("now"), runs(yesterday).alias("before"))

    def line(name: str, now: str, before: str):
        base = F.col("now").alias("n_base")  # the rows that a share is taken of
        return F.struct(
            F.lit(name).alias("table_name"), F.col(now).alias("n_rows"), F.col(before).alias("n_rows_before"), base
        )

    counts = (
        logs.select(
            F.inline(F.array(line("stg_daily_usage_logs", "now", "before"), line("orphan_usage", "bad_now", "bad_before")))
        )
        .unionByName(contracts.select(F.inline(F.array(line("active_contracts", "now", "before")))))
        .unionByName(mart.select(F.inline(F.array(line("mart_carr_current", "now", "before")))))
    )
    change = F.when(F.col("n_rows_before") > 0, F.col("n_rows") / F.col("n_rows_before") - 1)
    orphans = F.col("table_name") == "orphan_usage"
    share = F.when(orphans & (F.col("n_base") > 0), F.col("n_rows") / F.col("n_base"))
    return (
        counts.withColumn("change_pct", change)
        .withColumn("alert_orphan_share", F.coalesce(share > 0.01, F.lit(False)))
        .drop("n_base")
        .withColumn("alert_change", F.coalesce(F.abs("change_pct") > 0.10, F.lit(False)))
        .withColumn("alert_decrease", F.col("n_rows") < F.col("n_rows_before"))
    )


def stored_row_counts(spark, folder: str) -> DataFrame:
    """Alerts of the latest stored run against the run before it, from ``row_counts`` as builds store them (counted while
    writing). Per table of the latest run: n_rows, n_rows_before (null for a table new in the run), change_pct,
    alert_change (more than 10 % either way), alert_decrease. Runs are ordered by run time, then id; only the two chosen
    run folders are compared.
    """
    from ..sources import schemas
    from ..sources.sinks import read_runs

    counts = read_runs(spark, f"{folder}/row_counts", schemas.ROW_COUNTS)
    runs = counts.groupBy("run_id").agg(F.max("run_ts").alias("t"))
    picked = [r.run_id for r in runs.orderBy(F.desc_nulls_last("t"), F.desc("run_id")).limit(2).collect()]
    if not picked:
        raise ValueError(f"no stored row counts under {folder}")
    of = lambda run_id, name: counts.where(F.col("run_id") == F.lit(run_id)).select("table_name", F.col("n_rows").alias(name))
    now = of(picked[0], "n_rows").withColumn("run_id", F.lit(picked[0]))
    before = of(picked[1], "n_rows_before") if len(picked) > 1 else of(picked[0], "n_rows_before").where("false")
    change = F.when(F.col("n_rows_before") > 0, F.col("n_rows") / F.col("n_rows_before") - 1)
    return (
        now.join(before, "table_name", "left")
        .select("run_id", "table_name", "n_rows", "n_rows_before", change.alias("change_pct"))
        .withColumn("alert_change", F.coalesce(F.abs("change_pct") > 0.10, F.lit(False)))
        .withColumn("alert_decrease", F.coalesce(F.col("n_rows") < F.col("n_rows_before"), F.lit(False)))
    )


def obs_freshness(b) -> DataFrame:
    """Latest day of each day-stamped table against the as-of date."""
    p = b.p
    last = lambda df, c, name: df.agg(F.max(c).alias("last_day")).select(F.lit(name).alias("table_name"), "last_day")
    usage = b.usage_rollup.where(F.col("usage_date") <= F.lit(p.as_of))
    tables = (
        last(usage, "usage_date", "stg_daily_usage_logs")
        .unionByName(last(b.mart_carr_current, "as_of_date", "mart_carr_current"))
        .unionByName(last(b.month_end_metric, "as_of_date", "carr_account_month_end"))
    )
    behind = F.datediff(F.lit(p.as_of), F.col("last_day")).cast("bigint")
    return tables.withColumn("days_behind", behind).withColumn("stale", F.col("days_behind") > 1)
