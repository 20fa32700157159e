"""Subscriber-retention analytics as composable PySpark DataFrame operators."""

from .config import AnalysisConfig

__all__ = ["AnalysisConfig"]
