"""The score as Column expressions. Shared by the snapshot, history and variant plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Params

# Band names, in order of precedence.
BANDS = ["at_risk_shelfware", "spike_drop", "expansion", "overage", "healthy"]

# Display names of the bands.
BAND_DISPLAY = {
    "at_risk_shelfware": "Shelfware",
    "spike_drop": "Spike & Drop",
    "expansion": "Mid-Year Expansions",
    "overage": "Consistent Overages",
    "healthy": "Healthy",
}

# Wording of the account narrative. %s stands for a percentage, a count or a dollar amount.
NO_SCORE_TEXT = "No active contract on the snapshot date; metric not computed."
SCORE_TEXT = "HealthScore is **%s** — %s. cARR is %s against Committed ARR of %s."
DRIVER_TEXT = {
    "at_risk_shelfware": "Trailing-90-day utilization is only %s of included credits.",
    "spike_drop": "Month-1 of the 90-day window accounts for %s of total usage — classic spike-drop.",
    "expansion": "Utilization at %s with %s overlapping contracts — the account is expanding.",
    "overage": "Utilization at %s, consistently above included — the customer is paying overage.",
    "healthy": "Utilization at %s, within the healthy band; no anomaly flags tripped.",
}
OTHER_DRIVER_TEXT = "Utilization at %s; modifier=%s."
NO_USAGE_TEXT = {
    "at_risk_shelfware": "No usage observed in the trailing 90 days despite an active contract.",
    "healthy": "No usage data yet — HealthScore defaults to booking trust.",
}
BAND_COPY = {
    "at_risk_shelfware": "shelfware-leaning",
    "spike_drop": "spike-drop pattern",
    "expansion": "expanding",
    "overage": "paying overage",
    "healthy": "healthy",
}


def utilization(credits: Column, included_monthly: Column) -> Column:
    """Credits over three months of included credits; NULL where nothing is included."""
    expected = (included_monthly * 3).cast("double")
    return F.when(included_monthly != 0, credits.cast("double") / expected)


def share(part: Column, whole: Column) -> Column:
    """part / whole as double; NULL where the whole is 0 or NULL."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def base_score(u: Column, p: Params, floor: Column | None = None) -> Column:
    """Piecewise linear in u: floor, ramp, plateau at 1, capped bonus. NULL u scores 1."""
    low = F.lit(p.hs_floor) if floor is None else floor
    ramp = low + (u - p.shelfware_u_max) * (1.0 - low) / (F.lit(p.healthy_u_min) - F.lit(p.shelfware_u_max))
    bonus = 1.0 + F.least(u - p.healthy_u_max, F.lit(p.expansion_u_bonus_cap))
    return (
        F.when(u.isNull(), 1.0)
        .when(u < p.shelfware_u_max, low)
        .when(u < p.healthy_u_min, ramp)
        .when(u <= p.healthy_u_max, 1.0)
        .otherwise(bonus)
    )


def is_spike(m1: Column, age: Column, p: Params) -> Column:
    return (m1 >= p.spike_m1_share) & (age >= p.spike_min_age)


def is_expanding(n_contracts: Column, u: Column, p: Params) -> Column:
    return (n_contracts >= 2) & (u > p.expansion_u_min)


def modifier(spike: Column, expanding: Column, p: Params) -> Column:
    """One modifier at a time; the spike wins."""
    return F.when(spike, p.spike_modifier).when(expanding, p.expansion_modifier).otherwise(1.0)


def healthscore(base: Column, mod: Column, p: Params) -> Column:
    return F.greatest(F.lit(p.hs_floor), F.least(F.lit(p.hs_cap), base * mod))


def band(hs: Column, m1: Column, age: Column, n_contracts: Column, u: Column, p: Params) -> Column:
    """First match wins, in the order of BANDS."""
    return (
        F.when(hs <= p.band_at_risk_max, "at_risk_shelfware")
        .when(is_spike(m1, age, p), "spike_drop")
        .when(is_expanding(n_contracts, u, p), "expansion")
        .when(u > p.band_overage_min, "overage")
        .otherwise("healthy")
    )


def _mapped(key: Column, values: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), key)


def band_display(b: Column) -> Column:
    return _mapped(b, BAND_DISPLAY)


def _whole(x: Column) -> Column:
    """The nearest whole number to the exact binary value, ties to even. The fraction of a double is exact."""
    v = x.cast("double")
    low = F.floor(v)
    rest = v - low
    up = (rest > 0.5) | ((rest == 0.5) & (low % 2 != 0))
    return low + up.cast("bigint")


def dollars_text(x: Column) -> Column:
    return F.format_string("$%,d", _whole(x))


def percent_text(x: Column) -> Column:
    return F.concat(_whole(x.cast("double") * 100).cast("string"), F.lit("%"))


def two_decimals(x: Column) -> Column:
    """Two decimals of a value from 1/8 to below 8, rounded on its exact binary value, ties to even.

    Such a double is a whole number of 2**-55, taken here as two exact halves; hundred times that number fits 128 bits.
    """
    v = x.cast("double")
    high = F.floor(v * float(1 << 28))
    low = F.floor((v * float(1 << 28) - high) * float(1 << 27))
    parts = high.cast("decimal(38,0)") * F.lit(1 << 27).cast("decimal(12,0)") + low.cast("decimal(12,0)")
    units = (parts.cast("decimal(24,0)") * F.lit(100).cast("decimal(3,0)")).cast("decimal(28,0)")
    one = F.lit(1 << 55).cast("decimal(20,0)")
    whole = F.floor(units / one).cast("bigint")
    rest = units - whole.cast("decimal(20,0)") * one
    half = F.lit(1 << 54).cast("decimal(20,0)")
    cents = whole + ((rest > half) | ((rest == half) & (whole % 2 != 0))).cast("bigint")
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def narrative(p: Params) -> Column:
    """Two sentences per account: the score line and the main driver. Expects the columns of the current mart."""
    u, b = F.col("utilization_u"), F.col("band")
    slots = {name: [percent_text(u)] for name in DRIVER_TEXT}
    slots["spike_drop"] = [percent_text(F.col("m1_share"))]
    slots["expansion"] += [F.col("n_active_contracts").cast("string")]

    driver = F
    for name, text in NO_USAGE_TEXT.items():
        driver = driver.when((b == name) & u.isNull(), text)
    for name, text in DRIVER_TEXT.items():
        driver = driver.when(b == name, F.format_string(text, *slots[name]))
    driver = driver.otherwise(F.format_string(OTHER_DRIVER_TEXT, percent_text(u), two_decimals(F.col("modifier"))))

    score = F.format_string(
        SCORE_TEXT,
        two_decimals(F.col("healthscore")),
        _mapped(b, BAND_COPY),
        dollars_text(F.col("carr")),
        dollars_text(F.col("committed_arr")),
    )
    return F.when(F.col("healthscore").isNull(), NO_SCORE_TEXT).otherwise(F.concat(score, F.lit("\n\n"), driver))


def histogram_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the top edge falls in the last bin."""
    raw = F.floor((x - low) / (high - low) * bins)
    return F.when(high > low, F.least(raw, F.lit(bins - 1))).otherwise(0).cast("bigint")
