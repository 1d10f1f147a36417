"""Every tunable of the metric in one frozen value object.

The as-of date is always an input: no plan in this package reads a clock.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta


def month_end(d: date) -> date:
    """Last day of the month of ``d``."""
    first_of_next = date(d.year + d.month // 12, d.month % 12 + 1, 1)
    return first_of_next - timedelta(days=1)


@dataclass(frozen=True)
class Params:
    as_of: date = date(1999, 6, 30)
    window_days: int = 90
    m1_days: int = 30

    # score
    hs_floor: float = 0.40
    hs_cap: float = 1.30
    shelfware_u_max: float = 0.30
    healthy_u_min: float = 0.70
    healthy_u_max: float = 1.10
    expansion_u_bonus_cap: float = 0.20
    spike_m1_share: float = 0.70
    spike_min_age: int = 90
    spike_modifier: float = 0.50
    expansion_modifier: float = 1.10
    expansion_u_min: float = 1.00
    pre_signal_days: int = 30

    # bands
    band_at_risk_max: float = 0.55
    band_overage_min: float = 1.10
    card_overage_min: float = 1.12

    # money
    price_per_credit: float = 1.00
    commission_rate: float = 0.10
    overage_label_ratio: float = 1.20

    # reporting ranges
    observed_from: date = date(1995, 1, 2)
    observed_to: date = date(2001, 11, 4)
    retention_months: int = 25
    trend_months: int = 12
    movement_days: int = 30
    expansion_lookback_days: int = 365

    # access
    viewer_email: str = "R000001@example.com"

    # execution
    skew_salts: int = 8

    @property
    def window_start(self) -> date:
        """Exclusive lower bound of the trailing window."""
        return self.as_of - timedelta(days=self.window_days)

    @property
    def m1_end(self) -> date:
        """Inclusive upper bound of the window's first month."""
        return self.window_start + timedelta(days=self.m1_days)

    @property
    def prior_as_of(self) -> date:
        return self.as_of - timedelta(days=self.movement_days)

    @property
    def month_ends(self) -> list[date]:
        """The last ``trend_months`` month-ends that are not after the as-of date, oldest first."""
        last = month_end(self.as_of)
        if last > self.as_of:
            last = self.as_of.replace(day=1) - timedelta(days=1)
        out = [last]
        while len(out) < self.trend_months:
            out.append(out[-1].replace(day=1) - timedelta(days=1))
        return out[::-1]

    @property
    def quarter_ends(self) -> list[date]:
        return [d for d in self.month_ends if d.month % 3 == 0]

    @property
    def retention_from(self) -> date:
        """First day that is kept in daily detail: ``retention_months`` before the as-of date, exclusive."""
        months = self.as_of.year * 12 + self.as_of.month - 1 - self.retention_months
        y, m = divmod(months, 12)
        last = month_end(date(y, m + 1, 1))
        return date(y, m + 1, min(self.as_of.day, last.day)) + timedelta(days=1)
