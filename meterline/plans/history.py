"""The metric on many days at once, month-end snapshots, and corrections to closed months.

Every input of the score is a sum that changes only on known days: a contract counts from its start to the day
after its end, a day's usage enters the window on its day and leaves it ``window_days`` later. These changes
form one stream per account, running sums over it give the state from each change to the next, and only then are
the requested days unfolded from the stretches between changes. That is one shuffle and one sort of the
changes by account: no join of days with contracts or usage, no sliding frame, no loop over days. An account
has at most a few changes per calendar day, because contracts and usage are summed per (account, day) before.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.edges import carr_sum, publish_early
from ..operators import intervals as I
from ..sources import sinks
from . import models

Days = Callable[[Column, Column], Column]
Bound = Column | date


def listed(days: list[date]) -> tuple[Days, date, date]:
    """A short list of days."""
    asked = F.array(*[F.lit(d) for d in sorted(set(days))])
    return (lambda lo, hi: F.filter(asked, lambda d: d.between(lo, hi))), min(days), max(days)


def every_day(low: Bound, high: Bound) -> tuple[Days, Bound, Bound]:
    def days(lo: Column, hi: Column) -> Column:
        first, last = F.greatest(lo, I.as_day(low)), F.least(hi, I.as_day(high))
        return F.when(first <= last, F.sequence(first, last))

    return days, low, high


def every_month_end(high: date) -> tuple[Days, None, date]:
    """All month-ends up to a day, however far back contracts go."""

    def days(lo: Column, hi: Column) -> Column:
        first, last = lo, F.least(hi, F.lit(high))
        # months whose last day is not after the last day asked for
        begin, end = F.trunc(first, "month"), F.add_months(F.trunc(F.date_add(last, 1), "month"), -1)
        return F.when(begin <= end, F.transform(F.sequence(begin, end, F.expr("INTERVAL 1 MONTH")), F.last_day))

    return days, None, high


CELLS = ("n", "arr", "included", "oldest", "used", "early")


def _changes(b, low: Bound | None, high: Bound, usage: bool = True) -> DataFrame:
    """(account_id, day, n, arr, included, oldest, used, early): what changes on that day; money in cents.

    An account's rows are brought together as they are, one per contract dates or day of usage, and only then turned into
    changes, so that a day of usage travels once and not once per change that it makes. Contracts and usage are dealt out
    alike, so their union needs no further shuffle. Without ``usage`` the last three stay 0.
    """
    p, tasks = b.p, b.account_tasks
    high = I.as_day(high)
    contracts = b.stg_contracts.where(F.col("start_date") <= high)
    entered = None
    if low is not None:
        low = I.as_day(low)
        entered = F.date_sub(low, p.window_days)
        contracts = contracts.where(F.col("end_date") >= low)
    zero = F.lit(0).cast("bigint")

    def change(day: Column, **cells: Column) -> Column:
        return F.struct(day.alias("day"), *[cells.get(n, zero).cast("bigint").alias(n) for n in CELLS])

    def inlined(rows: DataFrame, changes: Column) -> DataFrame:
        return rows.select("account_id", F.inline(changes)).where(F.col("day") <= high)

    if not usage:
        deltas = I.daily_deltas(contracts).repartition(tasks, "account_id")
        sums = {"n": F.col("d_n"), "arr": F.col("d_arr_cents"), "included": F.col("d_included")}
        return inlined(deltas, F.array(change(F.col("day"), **sums)))
    # The stretches of an account are disjoint, so a running sum holds the start day of the current one.
    held = I.with_stretch(I.totals_by_dates(contracts).repartition(tasks, "account_id"))
    old, ended = I.daynum("start_date"), F.date_add("end_date", 1)
    # an amount that is missing counts as 0
    sums = {"n": F.col("n"), "arr": F.coalesce("arr_cents", zero), "included": F.coalesce("included", zero)}
    terms = F.array(change(F.col("start_date"), **sums), change(ended, **{c: -x for c, x in sums.items()}))
    stretch = F.array(change(F.col("from_day"), oldest=old), change(ended, oldest=-old))
    of_contracts = inlined(held, F.when(F.col("from_day").isNull(), terms).otherwise(F.concat(terms, stretch)))
    seen = b.valid_daily.where(F.col("usage_date") <= high)
    if entered is not None:
        seen = I.in_months(seen, entered, high).where(F.col("usage_date") > entered)
    # Spark leaves this shuffle out where the usage comes from a join that has dealt it out so already
    used = seen.select("account_id", "usage_date", (F.col("credits_consumed") * 100).cast("bigint").alias("cents"))
    used = used.repartition(tasks, "account_id")
    # Usage enters the window, moves into its first month, and leaves both on the same day.
    x, at = F.col("cents"), F.col("usage_date")
    of_usage = inlined(used, F.array(
        change(at, used=x),
        change(F.date_add(at, p.window_days - p.m1_days), early=x),
        change(F.date_add(at, p.window_days), used=-x, early=-x),
    ))
    return of_contracts.unionByName(of_usage)


def _stretches(b, request: tuple[Days, Bound | None, Bound], usage: bool = True) -> DataFrame:
    """Per account the stretches (since, until) with an active contract over which nothing changes and that hold a requested day."""
    days, low, high = request
    high = I.as_day(high)
    line = W.partitionBy("account_id").orderBy("day")
    run = line.rowsBetween(W.unboundedPreceding, 0)
    # Of several changes on one day only the last has days before the next change, and it holds them all.
    held = _changes(b, low, high, usage).select(
        "account_id",
        F.col("day").alias("since"),
        F.coalesce(F.date_sub(F.lead("day").over(line), 1), high).alias("until"),
        *[F.sum(c).over(run).alias(c) for c in (CELLS if usage else CELLS[:3])],
    )
    begin = F.col("since") if low is None else F.greatest(F.col("since"), I.as_day(low))
    held = held.where((F.col("n") > 0) & (F.col("until") >= begin))
    return held.where(F.size(days(F.col("since"), F.col("until"))) > 0)


def _money(cents: str) -> Column:
    return (F.col(cents).cast("decimal(26,0)") * F.lit(Decimal("0.01"))).cast("decimal(28,2)")


def active_days(b, low: Bound, high: Bound) -> DataFrame:
    """Contract sums per account and day of [low, high] on which it has an active contract, from contract changes alone.

    The sums are worked out, as they are published, once per stretch; a day is only a copy of its stretch.
    """
    days, *_ = request = every_day(low, high)
    sums = _stretches(b, request, usage=False).select(
        "account_id",
        days(F.col("since"), F.col("until")).alias("days"),
        # an active contract without an amount counts as 0
        F.coalesce(_money("arr"), F.lit(0).cast("decimal(28,2)")).alias("committed_arr_on_day"),
        (F.coalesce("included", F.lit(0)) / 30.0).alias("daily_included_credits"),
        F.col("n").alias("active_contract_count"),
        (F.col("n") > 1).alias("has_overlap_on_day"),
    )
    constant = [c for c in sums.columns if c not in ("account_id", "days")]
    return publish_early(sums, constant).select("account_id", F.explode("days").alias("day"), *constant)


def metric_on(b, request: tuple[Days, Bound | None, Bound], published: bool = False, gathered: bool = False) -> DataFrame:
    """(account, day) metric with band and account attributes.

    All but the day and the age of the contract is worked out once per stretch: a stretch is cut on the day from which the age
    lets a spike count, the only use that the score makes of the age. ``published`` also rounds these columns there, as
    ``edges.publish`` would on each day. With ``gathered`` the rows of a quarter are brought together, sorted by day, for a writer by
    day: as sums and attributes, from which the score and what follows from it are worked out after that shuffle.
    """
    p = b.p
    days, *_ = request
    held = _stretches(b, request)
    oldest = F.date_add(F.lit(date(1970, 1, 1)), F.col("oldest").cast("int"))
    since, until, turn = F.col("since"), F.col("until"), F.date_add(oldest, p.spike_min_age)
    piece = lambda lo, hi: F.struct(lo.alias("since"), hi.alias("until"))
    whole = (since >= turn) | (until < turn)
    cut = F.when(whole, F.array(piece(since, until))).otherwise(
        F.array(piece(since, F.date_sub(turn, 1)), piece(turn, until))
    )
    pieces = held.select("account_id", *CELLS, F.inline(cut))
    # attributes (one row per account) join the stretches, which are far fewer than the days they unfold to
    sums = (
        pieces.select("*", days(F.col("since"), F.col("until")).alias("days"))
        .where(F.size("days") > 0)
        .join(b.stg_accounts, "account_id")
        .select("account_id", "company_name", "rep_id", "region", "segment", *CELLS, "since", "days")
    )
    at, kept = "since", "days"
    if gathered:
        at = kept = "as_of_date"
        sums = sums.withColumn(at, F.explode("days")).drop("since", "days").withColumn("_quarter", F.trunc(at, "quarter"))
        # an account's days of a quarter lie side by side, so what they share is compressed away
        sums = sums.hint("rebalance", F.col("_quarter")).drop("_quarter")
        # in the order that a writer by day asks for, so that it need not sort the wider rows
        sums = sums.sortWithinPartitions(at)
    state = (
        sums.select(
            "account_id",
            "company_name",
            "rep_id",
            "region",
            "segment",
            kept,
            F.date_add(F.lit(date(1970, 1, 1)), F.col("oldest").cast("int")).alias("oldest_active_start"),
            F.col("n").alias("n_active_contracts"),
            _money("arr").alias("committed_arr"),
            F.col("included").alias("included_monthly_credits"),
            _money("used").alias("credits_90d"),
            _money("early").alias("credits_month_1"),
            F.datediff(at, F.date_add(F.lit(date(1970, 1, 1)), F.col("oldest").cast("int"))).cast("bigint").alias("contract_age_days"),
        )
        .withColumn("utilization_u", S.utilization(F.col("credits_90d"), F.col("included_monthly_credits")))
        .withColumn("m1_share", S.share(F.col("credits_month_1"), F.col("credits_90d")))
    )
    carr = F.col("committed_arr").cast("double") * F.col("healthscore")
    scored = models.with_band(models.scored(state, p).withColumn("carr", carr), p)
    if published:
        scored = publish_early(scored, ["committed_arr", "credits_90d", "utilization_u", "m1_share", "healthscore", "carr"])
    unfolded = scored if gathered else scored.withColumn("as_of_date", F.explode("days"))
    return unfolded.select(
        "as_of_date",
        "account_id",
        "company_name",
        "rep_id",
        "region",
        "segment",
        "n_active_contracts",
        "committed_arr",
        "credits_90d",
        "utilization_u",
        "m1_share",
        "healthscore",
        "carr",
        F.datediff("as_of_date", "oldest_active_start").cast("bigint").alias("contract_age_days"),
        "band",
    )


def carr_account_day(b) -> DataFrame:
    """Every account on every day that is kept hot (25 months up to the as-of date)."""
    return metric_on(b, every_day(b.p.retention_from, b.p.as_of))


def carr_account_day_published(b) -> DataFrame:
    """``carr_account_day`` with its columns in published form."""
    return metric_on(b, every_day(b.p.retention_from, b.p.as_of), published=True)


def carr_account_month_end(b) -> DataFrame:
    """Every account on every month-end up to the as-of date."""
    return b.all_month_ends.withColumnRenamed("as_of_date", "month_end")


def publish_month_ends(b, path: str) -> list[date]:
    """``sinks.publish_months`` of ``carr_account_month_end``, whose rows are brought together before they are scored."""
    rows = metric_on(b, every_month_end(b.p.as_of), gathered=True).withColumnRenamed("as_of_date", "month_end")
    return sinks.publish_months(rows, path, gathered=True)


def carr_per_rep(month_ends: DataFrame) -> DataFrame:
    """(month_end, rep_id, carr) of an account-level month-end frame."""
    return month_ends.groupBy("month_end", "rep_id").agg(carr_sum().cast("double").alias("carr"))


def carr_rep_month_end(b) -> DataFrame:
    per_rep = b.all_month_ends.groupBy("rep_id", F.col("as_of_date").alias("month_end")).agg(*models.sums())
    return (
        b.stg_sales_reps.join(per_rep, "rep_id")
        .select("month_end", "rep_id", "rep_name", "region", "segment", "n_accounts", "committed_arr", "carr",
                models.weighted_hs())
    )


def compare(b, old: DataFrame, new: DataFrame) -> DataFrame:
    """One row (n_rows, n_changed): the rows of a full outer join of ``old`` and ``new`` on month and account, and those of them whose
    carr differs.

    Counted per month, account and value, so that ``new`` stays where it was worked out (its accounts are dealt out already) and
    only ``old`` travels; a key that repeats counts all its pairs, as the join would.
    """
    keys = ["account_id", "month_end"]

    def side(df: DataFrame, in_old: int) -> DataFrame:
        return df.select("*", F.lit(in_old).cast("bigint").alias("n_old"), F.lit(1 - in_old).cast("bigint").alias("n_new"))

    old, new = (df.select(*keys, "carr") for df in (old, new))
    rows = side(old.repartition(b.account_tasks, "account_id"), 1).unionByName(side(new, 0))
    n_old, n_new = F.col("n_old"), F.col("n_new")
    values = rows.groupBy(*keys, "carr").agg(F.sum("n_old").alias("n_old"), F.sum("n_new").alias("n_new"))
    # a row without a partner differs unless it has no value
    valued = F.when(F.col("carr").isNull(), F.lit(0)).otherwise(n_old + n_new)
    found = values.groupBy(*keys).agg(
        F.sum("n_old").alias("n_old"),
        F.sum("n_new").alias("n_new"),
        F.sum(n_old * n_new).alias("same"),
        F.sum(valued).alias("valued"),
    )
    both = (n_old > 0) & (n_new > 0)
    zero = F.lit(0).cast("bigint")
    n_rows = F.when(both, n_old * n_new).otherwise(n_old + n_new)
    n_changed = F.when(both, n_old * n_new - F.col("same")).otherwise(F.col("valued"))
    return found.agg(F.coalesce(F.sum(n_rows), zero).alias("n_rows"), F.coalesce(F.sum(n_changed), zero).alias("n_changed"))


def restatement_diff(
    frozen: DataFrame, recomputed: DataFrame, tolerance: float = 0.0, key: str = "account_id"
) -> DataFrame:
    """All rows of closed months whose recomputed value differs from the published one; published rows stay as they are.

    ``needs_restatement`` marks the differences above ``tolerance``; the others need a note only.
    """
    keys = ["month_end", key]
    old = frozen.select(*keys, F.col("carr").alias("old_value"))
    new = recomputed.select(*keys, F.col("carr").alias("new_value"))
    delta = F.coalesce(F.col("new_value"), F.lit(0.0)) - F.coalesce(F.col("old_value"), F.lit(0.0))
    return (
        old.join(new, keys, "full_outer")
        .where(~F.col("old_value").eqNullSafe(F.col("new_value")))
        .withColumn("delta", delta)
        .withColumn("needs_restatement", F.abs("delta") > tolerance)
        .withColumnRenamed("month_end", "as_of_month")
    )
