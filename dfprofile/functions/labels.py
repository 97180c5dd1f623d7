"""Label rules as column expressions (`when` chains)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's): correlation strength cut points.
STRENGTH_CUTS = [(0.9, "very_strong"), (0.7, "strong"), (0.5, "moderate"), (0.3, "weak")]
STRENGTH_ELSE = "very_weak"

# Data-quality score cut points.
QUALITY_CUTS = [(90, "excellent"), (75, "good"), (60, "fair"), (40, "poor")]
QUALITY_ELSE = "very_poor"


def _chain(x: Column, cuts, default: str) -> Column:
    expr = None
    for cut, label in cuts:
        expr = F.when(x >= cut, label) if expr is None else expr.when(x >= cut, label)
    return expr.otherwise(default)


def correlation_strength(abs_corr: Column) -> Column:
    """Strength label of an absolute correlation."""
    return _chain(abs_corr, STRENGTH_CUTS, STRENGTH_ELSE)


def quality_label(score: Column) -> Column:
    """Q5: assessment label of a quality score."""
    return _chain(score, QUALITY_CUTS, QUALITY_ELSE)


def strength_sql(x: str) -> str:
    parts = " ".join(f"WHEN {x} >= {c} THEN '{lab}'" for c, lab in STRENGTH_CUTS)
    return f"CASE {parts} ELSE '{STRENGTH_ELSE}' END"


def quality_sql(x: str) -> str:
    parts = " ".join(f"WHEN {x} >= {c} THEN '{lab}'" for c, lab in QUALITY_CUTS)
    return f"CASE {parts} ELSE '{QUALITY_ELSE}' END"
