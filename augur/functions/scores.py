"""Scores of probabilities against outcomes. Undefined values are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def clip(p: Column, eps: float = EPS) -> Column:
    """Null stays null, which least and greatest alone would skip."""
    return F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1.0 - eps)), F.lit(eps)))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def brier(p: Column, outcome: Column) -> Column:
    return (p - outcome) * (p - outcome)


def log_loss(p: Column, outcome: Column, eps: float = EPS) -> Column:
    q = clip(p, eps)
    return -F.ln(F.when(outcome == 1, q).otherwise(1 - q))


def logit(p: Column) -> Column:
    q = clip(p)
    return F.ln(q / (1 - q))


def mean(x: Column) -> Column:
    """Of finite values; null without any."""
    return F.avg(finite(x))


def population_std(x: Column) -> Column:
    return F.stddev_pop(x)


def pearson(x: Column, y: Column) -> Column:
    """Null for fewer than two pairs or without variance."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= 2, r)


def base_rate(raw: Column) -> Column:
    """A prior read as text or number, clipped; null unless finite."""
    return clip(finite(raw.try_cast("double")))


def prediction_from_text(prediction: Column, parseable: Column) -> Column:
    """A posterior from a CSV row: only where marked parseable, a number within [0, 1]; clipped."""
    p = finite(prediction.try_cast("double"))
    good = F.coalesce(parseable.cast("string").isin("True", "true", "1"), F.lit(False))
    return F.when(good & p.between(0.0, 1.0), clip(p))


def update_direction_correct(outcome: Column, prior: Column, posterior: Column) -> Column:
    return ((outcome == 1) & (posterior >= prior)) | ((outcome == 0) & (posterior <= prior))
