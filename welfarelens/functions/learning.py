"""Row-level losses and indicators for estimated quantiles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pinball_loss(outcome, estimate, tau) -> Column:
    """tau * max(y - q, 0) + (1 - tau) * max(q - y, 0)."""
    y, q = col(outcome), col(estimate)
    t = tau if isinstance(tau, Column) else F.lit(float(tau))
    loss = t * F.greatest(y - q, F.lit(0.0)) + (1 - t) * F.greatest(q - y, F.lit(0.0))
    return F.when(y.isNotNull() & q.isNotNull(), loss)


def below_estimate(outcome, estimate, closed: bool = False) -> Column:
    """Whether the outcome lies below the estimate (or on it, if ``closed``)."""
    return col(outcome) <= col(estimate) if closed else col(outcome) < col(estimate)
