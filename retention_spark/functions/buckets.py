"""Ordered bucket labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AnalysisConfig


def bucket(spec: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """First condition that is true names the bucket; none, or only NULLs, gives `otherwise`."""
    head, *rest = spec
    label = F.when(head[0], head[1])
    for condition, name in rest:
        label = label.when(condition, name)
    return label.otherwise(otherwise)


def plan_type(days: Column, cfg: AnalysisConfig) -> Column:
    """Plan type of a plan length; an unknown length counts as the longest type."""
    return bucket([(days <= edge, name) for edge, name in cfg.plan_edges], cfg.plan_else)


def engagement_tier(rate: Column, cfg: AnalysisConfig) -> Column:
    """Tier of an already rounded active-day rate."""
    return bucket(
        [(rate == 0, "Dormant"), (rate < F.lit(cfg.tier_edge), "Light User")], "Regular"
    )
