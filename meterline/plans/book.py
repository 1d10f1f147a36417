"""The layered tables of one snapshot as lazily built DataFrames.

``Book`` wires sources to staging, intermediate, metric and mart tables. Each property is a plan, not data:
nothing runs until a result is written or read. ``Book.stored`` swaps the tables that were written by
``plans.build`` in, so reports read materialised marts instead of repeating the upstream plan.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage as U
from ..operators.intervals import in_months
from ..params import Params
from ..session import ready_for_checkpoint, written_once
from ..sources.sinks import read_table
from . import history, models, variants


#: Rows of the written roll-up for each task that works on whole accounts: three changes of each fit a task's share of memory
#: many times, so that their sort does not spill.
ROLLUP_ROWS = 250_000


class Book:
    def __init__(self, sources: dict[str, DataFrame], params: Params | None = None):
        self.sources = sources
        self.p = params or Params()
        self._facts_of: Book | None = None
        self._least_tasks = 0

    @classmethod
    def stored(cls, spark: SparkSession, sources: dict[str, DataFrame], folder: str, params: Params | None = None):
        book = cls(sources, params)
        for name in models.TABLES + models.SHARED:
            setattr(book, name, read_table(spark, f"{folder}/{name}"))
        book.stg_daily_usage_logs = book.stg_daily_usage_logs.drop("usage_month")
        book.rolled = book.settled = book
        book.usage_rollup = book.usage_daily.drop("usage_class")
        book.valid_daily = book.usage_daily.where(f"usage_class = '{U.VALID}'").drop("usage_class")
        return book

    @property
    def spark(self) -> SparkSession:
        return self.sources["accounts"].sparkSession

    def with_history(self, folder: str) -> Book:
        """Month-ends and the daily mart as ``build.write_history`` has written them."""
        daily = read_table(self.spark, f"{folder}/carr_account_day")
        ends = read_table(self.spark, f"{folder}/carr_account_month_end").withColumnRenamed("month_end", "as_of_date")
        self.all_month_ends = ends
        self.month_end_metric = ends.where(F.col("as_of_date").isin(self.p.month_ends))
        two = [self.p.prior_as_of, self.p.as_of]
        self.movement_metric = in_months(daily, *two).where(F.col("as_of_date").isin(two)).drop("usage_month")
        return self

    @property
    def account_tasks(self) -> int:
        """Number of tasks that accounts are dealt out to. A stretch unfolds to many days, so the input bytes that adaptive coalescing
        goes by say little about their work; the session's own number is kept, or more for a large written roll-up."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self._least_tasks)

    @cached_property
    def rolled(self) -> Book:
        """The same book over a roll-up that is written once, for reports that read it more than once."""
        book = Book(self.sources, self.p)
        book.usage_rollup = written_once(self.usage_rollup, "rollup")
        book._facts_of = self
        book.rolled = book
        return book

    @cached_property
    def settled(self) -> Book:
        """The same book over a roll-up written once and a checkpointed mart, for reports of many parts: they share one pass over
        the raw logs."""
        ready_for_checkpoint(self.spark)
        book = Book(self.sources, self.p)
        book.usage_rollup = self.rolled.usage_rollup
        book.active_usage = book.active_usage.checkpoint()
        book.mart_carr_current = book.mart_carr_current.checkpoint()
        book._facts_of = self
        book.rolled = book.settled = book
        return book

    def at(self, as_of: date) -> Book:
        """The book of another as-of date over the same written roll-up, which does not depend on that date."""
        book = Book(self.sources, replace(self.p, as_of=as_of))
        book.usage_rollup = self.rolled.usage_rollup
        book._least_tasks = self._rollup_tasks
        if book.account_tasks == book._least_tasks:
            # dealt out before the lookup of the spans, which by itself would use the session's number
            usage, spans = (df.repartition(book.account_tasks, "account_id") for df in (book.usage_rollup, book.spans))
            book.valid_daily = U.valid_only(usage, spans)
        book.rolled = book
        return book

    @cached_property
    def _rollup_tasks(self) -> int:
        # the count comes from the footers of the written files
        return -(-self.rolled.usage_rollup.count() // ROLLUP_ROWS)

    @cached_property
    def log_facts(self) -> DataFrame:
        """One checkpointed row with all that the checks ask of the raw logs, in one scan, but for their distinct ids."""
        if self._facts_of is not None:
            return self._facts_of.log_facts
        ready_for_checkpoint(self.spark)
        p, logs = self.p, self.sources["daily_usage_logs"]
        day = F.col("date").cast("date")
        nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in logs.columns]
        return logs.agg(
            F.count("*").alias("n"),
            F.count_if(F.col("compute_credits_consumed") < 0).alias("n_negative"),
            F.count_if(~day.between(F.lit(p.observed_from), F.lit(p.observed_to))).alias("n_outside"),
            F.max(F.when(day <= F.lit(p.as_of), day)).alias("last_day"),
            *nulls,
        ).checkpoint()

    @cached_property
    def log_ids(self) -> DataFrame:
        """One checkpointed row with the number of distinct log ids. Counted apart from ``log_facts``, so that the ids travel alone,
        and only for the checks that ask for them."""
        if self._facts_of is not None:
            return self._facts_of.log_ids
        ready_for_checkpoint(self.spark)
        return self.sources["daily_usage_logs"].agg(F.countDistinct("log_id").alias("n_ids")).checkpoint()

    # staging
    @cached_property
    def stg_sales_reps(self) -> DataFrame:
        return models.stg_sales_reps(self.sources["sales_reps"])

    @cached_property
    def stg_accounts(self) -> DataFrame:
        return models.stg_accounts(self.sources["accounts"], self.stg_sales_reps, self.p)

    @cached_property
    def stg_contracts(self) -> DataFrame:
        return models.stg_contracts(self.sources["contracts"], self.p)

    @cached_property
    def stg_daily_usage_logs(self) -> DataFrame:
        return models.stg_daily_usage_logs(self.sources["daily_usage_logs"])

    # shared roll-ups
    @cached_property
    def spans(self) -> DataFrame:
        return U.account_spans(self.sources["accounts"], self.stg_contracts)

    @cached_property
    def usage_rollup(self) -> DataFrame:
        """(account, day) usage: the one pass over the raw logs that everything else reuses."""
        return U.daily_rollup(self.stg_daily_usage_logs)

    @cached_property
    def usage_daily(self) -> DataFrame:
        """The roll-up with the class of each row."""
        return U.classify_daily(self.usage_rollup, self.spans)

    @cached_property
    def valid_daily(self) -> DataFrame:
        return U.valid_only(self.usage_rollup, self.spans)

    # intermediate
    @cached_property
    def int_orphan_usage(self) -> DataFrame:
        return models.int_orphan_usage(self.stg_daily_usage_logs, self.spans, self.p)

    @cached_property
    def int_account_active_contracts(self) -> DataFrame:
        return models.int_account_active_contracts(self.stg_contracts, self.p)

    @cached_property
    def active_usage(self) -> DataFrame:
        return models.active_usage(self.int_account_active_contracts, self.valid_daily, self.p)

    @cached_property
    def int_usage_rolled(self) -> DataFrame:
        return models.int_usage_rolled(self.active_usage)

    # history
    @cached_property
    def observed(self) -> tuple[Column, Column]:
        """First and last day of usage known on the as-of date, as scalar subqueries that are read when a plan runs."""
        known = self.stg_daily_usage_logs.where(F.col("usage_date") <= F.lit(self.p.as_of))
        days = known.agg(F.min("usage_date").alias("low"), F.max("usage_date").alias("high"))
        return days.select("low").scalar(), days.select("high").scalar()

    @cached_property
    def all_month_ends(self) -> DataFrame:
        """The metric of every account on each month-end up to the as-of date, with band."""
        return history.metric_on(self, history.every_month_end(self.p.as_of))

    @cached_property
    def month_end_metric(self) -> DataFrame:
        """The metric of every account on each of the last month-ends, with band."""
        return history.metric_on(self, history.listed(self.p.month_ends))

    @cached_property
    def movement_metric(self) -> DataFrame:
        """The metric on the as-of date and on the earlier date it is compared with."""
        return history.metric_on(self, history.listed([self.p.prior_as_of, self.p.as_of]))

    # variants
    @cached_property
    def rule_archetype(self) -> DataFrame:
        return variants.rule_archetype(self)

    @cached_property
    def labels(self) -> DataFrame:
        """Given ground-truth labels, else labels by rule."""
        return self.sources.get("account_archetypes", self.rule_archetype)

    @cached_property
    def orphan_accounts(self) -> DataFrame:
        return variants.join_anti_account_rep(self)

    @cached_property
    def orphan_contracts(self) -> DataFrame:
        return variants.join_anti_contract_account(self)

    @cached_property
    def covered_days(self) -> DataFrame:
        return variants.covered_account_days(self)

    @cached_property
    def clean_daily(self) -> DataFrame:
        return variants.clean_daily(self)

    @cached_property
    def spec_m1(self) -> DataFrame:
        return variants.spec_m1_share(self)

    @cached_property
    def expanded_flag(self) -> DataFrame:
        return variants.expanded_flag(self)

    # metric
    @cached_property
    def metric_healthscore(self) -> DataFrame:
        return models.metric_healthscore(self.active_usage, self.stg_accounts, self.p)

    @cached_property
    def metric_carr(self) -> DataFrame:
        return models.metric_carr(self.active_usage, self.stg_accounts, self.p)

    # mart
    @cached_property
    def mart_carr_current(self) -> DataFrame:
        return models.mart_carr_current(self.metric_carr, self.p)

    @cached_property
    def mart_carr_by_rep(self) -> DataFrame:
        return models.mart_carr_by_rep(self.stg_sales_reps, self.mart_carr_current)

    @cached_property
    def mart_carr_by_region(self) -> DataFrame:
        return models.mart_carr_by_region(self.mart_carr_current)

    @cached_property
    def mart_dq_summary(self) -> DataFrame:
        return models.mart_dq_summary(
            self.sources,
            self.usage_daily,
            self.int_account_active_contracts,
            self.mart_carr_current,
            self.p,
        )
