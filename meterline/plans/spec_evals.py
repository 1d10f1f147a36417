"""Evaluations that need order statistics, several days, or a parameter grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.edges import CARR_SUM
from ..operators import ordered as O
from ..operators.skew import salted_join
from ..session import scratch_path
from . import history, trends
from .evals import labelled
from .marts import desc, money

AT_RISK_LABELS = ["shelfware", "spike_drop"]

# Published range of the median score per label.
EXPECTED_MEDIAN = {
    "shelfware": (0.40, 0.40),
    "spike_drop": (0.40, 0.55),
    "overage": (1.12, 1.30),
    "normal": (0.70, 1.12),
}


def hs_dist_archetype(b) -> DataFrame:
    """Deciles and median of the score per label; the median may miss its published range by 0.10."""
    q = O.percentiles(
        labelled(b).select("archetype", "healthscore"),
        ["archetype"],
        "healthscore",
        {"p10": 0.1, "median": 0.5, "p90": 0.9},
    )
    low, high = [
        F.element_at(F.create_map(*[F.lit(x) for k, v in EXPECTED_MEDIAN.items() for x in (k, v[i])]), F.col("archetype"))
        for i in (0, 1)
    ]
    # carr / committed revenue equals the score of an account, so one distribution serves both.
    return q.withColumn("passed", F.col("median").between(low - 0.10, high + 0.10))


def _threshold(df: DataFrame, value: str, q: float) -> DataFrame:
    return O.percentiles(df.select(value), [], value, {"threshold": q})


def _share_beyond(b, value: str, q: float, label: str, below: bool, need: float) -> DataFrame:
    """Share of a label's accounts on the wanted side of a percentile of all accounts."""
    mart = labelled(b).select("archetype", F.col(value).cast("double").alias(value))
    limit = _threshold(mart, value, q).scalar()
    side = F.col(value) <= F.col("threshold") if below else F.col(value) >= F.col("threshold")
    row = (
        mart.withColumn("threshold", limit)
        .where(F.col("archetype") == label)
        .agg(F.count("*").alias("n"), F.count_if(side).alias("n_inside"), F.max("threshold").alias("threshold_value"))
    )
    share = F.when(F.col("n") > 0, F.col("n_inside") / F.col("n"))
    return row.withColumn("inside_share", share).withColumn("passed", F.coalesce(share >= need, F.lit(False)))


def eval_bottom_decile(b) -> DataFrame:
    return _share_beyond(b, "carr", 0.10, "shelfware", True, 0.85)


def eval_top_quartile(b) -> DataFrame:
    return _share_beyond(b, "healthscore", 0.75, "overage", False, 0.80)


def eval_false_positive(b) -> DataFrame:
    row = labelled(b).where("archetype = 'normal'").agg(
        F.count("*").alias("n"), F.count_if(F.col("healthscore") < 0.50).alias("n_low")
    )
    share = F.when(F.col("n") > 0, F.col("n_low") / F.col("n"))
    return row.withColumn("low_share", share).withColumn("passed", F.coalesce(share <= 0.05, F.lit(False)))


def _scorers(b) -> DataFrame:
    """(scorer, score, at_risk) for the three ways to rank accounts."""
    p = b.p
    used = b.int_usage_rolled.select("account_id", "credits_90d")
    exact = lambda c: F.col(c).cast(CARR_SUM)
    mart = labelled(b).join(used, "account_id", "left")
    pairs = F.array(
        F.struct(F.lit("committed_arr").alias("scorer"), exact("committed_arr").alias("score")),
        F.struct(
            F.lit("consumption").alias("scorer"),
            (exact("credits_90d") * F.lit(p.price_per_credit).cast("decimal(4,2)")).cast(CARR_SUM).alias("score"),
        ),
        F.struct(F.lit("carr").alias("scorer"), exact("carr").alias("score")),
    )
    return mart.select(F.col("archetype").isin(AT_RISK_LABELS).cast("bigint").alias("at_risk"), F.inline(pairs))


def eval_auc_pr(b) -> DataFrame:
    """Area under the precision-recall curve, lowest scores first; equal scores enter the curve together."""
    t = O.running_totals(
        _scorers(b), ["scorer"], "score", {"n": F.count("*"), "pos": F.sum("at_risk")}
    )
    precision = (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))
    step = F.when(F.col("pos_all") > 0, F.col("pos") / F.col("pos_all")) * precision
    auc = t.groupBy("scorer").agg(F.sum(step.cast("decimal(28,15)")).cast("double").alias("auc_pr"))
    return _with_margin(auc, "auc_pr", 0.10)


def eval_r2(b) -> DataFrame:
    """Share of the label's variance that each scorer explains."""
    r = F.corr(F.col("score").cast("double"), F.col("at_risk").cast("double"))
    return _with_margin(_scorers(b).groupBy("scorer").agg((r * r).alias("r2")), "r2", 0.15)


def _with_margin(df: DataFrame, value: str, need: float) -> DataFrame:
    """Adds the lead of carr over the better baseline; the window runs over three rows."""
    rows = W.partitionBy()
    ours = F.max(F.when(F.col("scorer") == "carr", F.col(value))).over(rows)
    best = F.max(F.when(F.col("scorer") != "carr", F.col(value))).over(rows)
    return df.withColumn("margin", ours - best).withColumn("passed", F.coalesce(F.col("margin") >= need, F.lit(False)))


def eval_topk_overlap(b, k: int = 100) -> DataFrame:
    """How many of the k largest accounts by carr are also among the k largest by committed revenue."""
    top = lambda c: b.mart_carr_current.select("account_id", c).orderBy(*desc(c), "account_id").limit(k)
    both = top("carr").select("account_id").join(top("committed_arr").select("account_id"), "account_id")
    row = both.agg(F.count("*").alias("n_common"))
    share = F.col("n_common") / F.lit(k)
    return row.withColumn("overlap_share", share).withColumn("passed", share.between(0.50, 0.90))


def eval_rank_spearman(b) -> DataFrame:
    """Rank correlation of reps between the two days, ties at their average rank."""
    both = _ranked_on_both_days(b)
    return both.agg(F.count("*").alias("n_reps"), F.corr("avg_rank", "prev_avg_rank").alias("rho")).withColumn(
        "passed", F.coalesce(F.col("rho") >= 0.85, F.lit(False))
    )


def _ranked_on_both_days(b) -> DataFrame:
    """Reps present on both days, ranked among each other."""
    p = b.p
    reps = O.settled(trends.both_days(b, ["rep_id"]).where("carr IS NOT NULL AND prev_carr IS NOT NULL"))
    now = O.ranked_values(reps, [], "carr", descending=True).select("carr", "rank", "avg_rank")
    before = O.ranked_values(reps, [], "prev_carr", descending=True).select(
        "prev_carr", F.col("rank").alias("prev_rank"), F.col("avg_rank").alias("prev_avg_rank")
    )
    out = salted_join(reps, now, ["carr"], ["rep_id"], p.skew_salts, "inner")
    return salted_join(out, before, ["prev_carr"], ["rep_id"], p.skew_salts, "inner")


def eval_rank_movement(b) -> DataFrame:
    moved = F.abs(F.col("rank") - F.col("prev_rank")) > 5
    row = _ranked_on_both_days(b).agg(F.count("*").alias("n_reps"), F.count_if(moved).alias("n_moved"))
    share = F.when(F.col("n_reps") > 0, F.col("n_moved") / F.col("n_reps"))
    return row.withColumn("moved_share", share).withColumn("passed", F.coalesce(share <= 0.20, F.lit(False)))


FLOORS = [0.30, 0.40, 0.50]
CAPS = [1.20, 1.30, 1.40]


def eval_param_grid(b) -> DataFrame:
    """Floor x cap grid: total carr of each cell against the default cell, and rep rank correlation with the next
    floor and the next cap. Each account is unfolded into its nine cells in place and summed per rep at once."""
    p = b.p
    cells = F.array(
        *[
            F.struct(F.lit(i * 3 + j).alias("cell"), F.lit(f).alias("hs_floor"), F.lit(c).alias("hs_cap"))
            for i, f in enumerate(FLOORS)
            for j, c in enumerate(CAPS)
        ]
    )
    grid = b.mart_carr_current.select("rep_id", "committed_arr", "utilization_u", "modifier", F.inline(cells))
    base = S.base_score(F.col("utilization_u"), p, floor=F.col("hs_floor"))
    hs = F.greatest(F.col("hs_floor"), F.least(F.col("hs_cap"), base * F.col("modifier")))
    carr = (money("committed_arr") * hs).cast(CARR_SUM)
    reps = O.settled(grid.groupBy("cell", "rep_id").agg(F.sum(carr).alias("carr")))
    ranked = O.ranked_values(reps, ["cell"], "carr", descending=True)
    by_rep = (
        salted_join(reps, ranked.select("cell", "carr", "avg_rank"), ["cell", "carr"], ["rep_id"], p.skew_salts, "inner")
        .groupBy("rep_id")
        .agg(
            *[F.max(F.when(F.col("cell") == k, F.col("avg_rank"))).alias(f"r{k}") for k in range(9)],
            *[F.max(F.when(F.col("cell") == k, F.col("carr"))).alias(f"c{k}") for k in range(9)],
        )
    )
    corr = lambda x, y: F.corr(f"r{x}", f"r{y}").alias(f"rho_{x}_{y}")
    steps = [(k, k + 3) for k in range(6)] + [(k, k + 1) for k in range(9) if k % 3 < 2]
    row = by_rep.agg(*[F.sum(f"c{k}").alias(f"t{k}") for k in range(9)], *[corr(x, y) for x, y in steps])
    default = money("t4")

    def line(k: int) -> Column:
        i, j = divmod(k, 3)
        rho = lambda to, ok: F.col(f"rho_{k}_{to}") if ok else F.lit(None).cast("double")
        return F.struct(
            F.lit(FLOORS[i]).alias("hs_floor"),
            F.lit(CAPS[j]).alias("hs_cap"),
            F.col(f"t{k}").alias("total_carr"),
            F.when(default > 0, money(f"t{k}") / default - 1).alias("change_pct"),
            rho(k + 3, i < 2).alias("rho_next_floor"),
            rho(k + 1, j < 2).alias("rho_next_cap"),
        )

    out = row.select(F.inline(F.array(*[line(k) for k in range(9)])))
    ok = (
        (F.abs("change_pct") <= 0.03)
        & (F.coalesce("rho_next_floor", F.lit(1.0)) >= 0.95)
        & (F.coalesce("rho_next_cap", F.lit(1.0)) >= 0.95)
    )
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))


def eval_top1_share(b) -> DataFrame:
    exact = F.col("carr").cast(CARR_SUM)
    row = b.mart_carr_current.agg(F.max(exact).alias("top_carr"), F.sum(exact).alias("total_carr"))
    share = F.when(F.col("total_carr") > 0, money("top_carr") / money("total_carr"))
    return row.withColumn("top_share", share).withColumn("passed", F.coalesce(share <= 0.03, F.lit(False)))


def eval_monotone(b) -> DataFrame:
    """Accounts whose utilisation rises every month, without spike, expansion or contract change: how many lose more
    than 0.05 of score in a month. The window per account runs over its month-ends."""
    p = b.p
    line = W.partitionBy("account_id").orderBy("as_of_date")
    u, hs = F.col("utilization_u"), F.col("healthscore")
    steps = b.month_end_metric.select(
        "account_id",
        (u - F.lag(u).over(line)).alias("du"),
        (F.lag(hs).over(line) - hs).alias("drop"),
        (F.col("n_active_contracts") == F.lag("n_active_contracts").over(line)).alias("same_contracts"),
        F.coalesce(S.is_spike(F.col("m1_share"), F.col("contract_age_days"), p), F.lit(False)).alias("spike"),
        F.coalesce(S.is_expanding(F.col("n_active_contracts"), u, p), F.lit(False)).alias("expanding"),
    )
    per_account = steps.groupBy("account_id").agg(
        F.min("du").alias("min_du"),
        F.max(F.when(F.col("same_contracts"), F.col("drop"))).alias("max_drop"),
        F.max("spike").alias("spike"),
        F.max("expanding").alias("expanding"),
    )
    row = per_account.where("min_du > 0 AND NOT spike AND NOT expanding").agg(
        F.count("*").alias("n_monotone"), F.count_if(F.col("max_drop") > 0.05).alias("n_violating")
    )
    share = F.when(F.col("n_monotone") > 0, F.col("n_violating") / F.col("n_monotone")).otherwise(0.0)
    return row.withColumn("violating_share", share).withColumn("passed", share <= 0.02)


# The published worked examples (revenue, utilisation, month-1 share, age, contracts, published result).
# The published expansion result follows the day-by-day reading, where any overlap expands.
WORKED_EXAMPLES = [
    ("shelfware", 220000.0, 0.0, None, 365, 1, False, 88000.0),
    ("normal", 48000.0, 0.758, None, 365, 1, False, 48000.0),
    ("overage", 33000.0, 1.321, None, 365, 1, False, 39600.0),
    ("spike_drop", 120000.0, 0.733, 0.92, 160, 1, False, 60000.0),
    ("expansion", 230000.0, 0.917, None, 365, 2, True, 253000.0),
    ("new_logo", 600000.0, None, None, 8, 1, False, 600000.0),
]


def worked_examples(spark, p) -> DataFrame:
    """The published examples through the score functions, to the cent."""
    schema = ("example string, arr double, u double, m1 double, age bigint, n bigint, expanded boolean, published double")
    ex = spark.createDataFrame(WORKED_EXAMPLES, schema)
    mod = S.modifier(S.is_spike(F.col("m1"), F.col("age"), p), F.col("expanded"), p)
    carr = F.col("arr") * S.healthscore(S.base_score(F.col("u"), p), mod, p)
    return ex.select("example", "published", carr.alias("carr"), (F.abs(carr - F.col("published")) <= 0.01).alias("passed"))


def eval_worked_examples(b) -> DataFrame:
    """The examples' rule applied to the whole mart: the result of every account, recomputed from its inputs and
    from the plain ratio form of the rule, agrees to the cent."""
    p = b.p
    u = F.col("utilization_u")
    slope = (1.0 - p.hs_floor) / (p.healthy_u_min - p.shelfware_u_max)
    base = (
        F.when(u.isNull(), 1.0)
        .when(u < p.shelfware_u_max, p.hs_floor)
        .when(u < p.healthy_u_min, p.hs_floor + (u - p.shelfware_u_max) * slope)
        .when(u <= p.healthy_u_max, 1.0)
        .otherwise(F.least(u - (p.healthy_u_max - 1.0), F.lit(1.0 + p.expansion_u_bonus_cap)))
    )
    recomputed = money("committed_arr") * F.greatest(
        F.lit(p.hs_floor), F.least(F.lit(p.hs_cap), base * F.col("modifier"))
    )
    return (
        b.mart_carr_current.withColumn("off", F.abs(recomputed - F.col("carr")) > 0.01)
        .groupBy("band")
        .agg(F.count("*").alias("n_accounts"), F.count_if("off").alias("n_off"))
        .withColumn("passed", F.col("n_off") == 0)
    )


def eval_determinism(b) -> DataFrame:
    """The month-end metric built twice from rows in another order."""
    from .book import Book
    from .catalog import checksum

    again = Book({n: df.repartition(F.xxhash64(*reversed(df.columns))) for n, df in b.sources.items()}, b.p)
    runs = checksum(b.metric_carr).unionByName(checksum(again.metric_carr))
    same = (F.min("n_rows") == F.max("n_rows")) & (F.min("sum_hash") == F.max("sum_hash"))
    return runs.agg(F.max("n_rows").alias("n_rows"), same.alias("identical"))


def eval_freeze(b) -> DataFrame:
    """Month-end rows that an earlier run published against the same months computed on a later as-of date."""
    later, earlier = b.at(b.p.month_ends[-1]), b.at(b.p.month_ends[-2])
    path = scratch_path(b.spark, "published")
    history.publish_month_ends(earlier, path)
    closed = F.col("month_end") <= F.lit(earlier.p.as_of)
    new = history.carr_account_month_end(later).where(closed)
    row = history.compare(later, b.spark.read.parquet(path), new)
    return row.withColumn("identical", F.col("n_changed") == 0)
