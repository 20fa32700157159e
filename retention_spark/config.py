"""Every constant of the analysis in one place; operators hold none of their own."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from decimal import Decimal


@dataclass(frozen=True)
class AnalysisConfig:
    """Dates, thresholds and scenario rates of one analysis run.

    The defaults are the published values of the analysis (fixed values).
    """

    # Payments after `cut` are ignored; usage is read inside [win_start, win_end].
    cut: date = date(2017, 3, 31)
    win_start: date = date(2017, 1, 1)
    win_end: date = date(2017, 3, 31)

    # Zone in which an epoch-millisecond registration becomes a calendar date.
    tz: str = "UTC"

    # Ages outside these inclusive bounds are treated as missing.
    age_min: int = 13
    age_max: int = 85

    # Plan types by upper bound in days, first match wins.
    plan_edges: tuple[tuple[int, str], ...] = ((7, "Trial"), (30, "Monthly"), (90, "Quarterly"))
    plan_else: str = "Long-term"
    monthly_days: int = 30

    # Below this share of exposure days a user is 'Light', otherwise 'Regular'.
    tier_edge: Decimal = Decimal("0.49")

    # Plan lengths reported by the adoption queries.
    adoption_min_users: int = 500
    adoption_plans: tuple[int, ...] = (30, 90, 100, 180, 195, 360, 410)

    # Retention scenario: target churn rates, currency units per dollar, days per year.
    optimistic_rate: Decimal = Decimal("0.0383")
    conservative_rate: Decimal = Decimal("0.1195")
    fx: int = 30
    year_days: int = 365

    def __post_init__(self) -> None:
        if self.win_end < self.win_start:
            raise ValueError("win_end lies before win_start")

    @property
    def win_days(self) -> int:
        return (self.win_end - self.win_start).days + 1
