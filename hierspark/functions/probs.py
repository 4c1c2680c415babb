"""Probability expressions on logit arrays and on single scores."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside a lambda an expression would be evaluated again for each element."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column) -> Column:
    """Softmax of an ``ARRAY<DOUBLE>``, shifted by its maximum so ``exp`` cannot overflow; linear in the width."""
    shifted = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(shifted, lambda weights: let(total(weights), lambda whole: F.transform(weights, lambda w: w / whole)))


def log_sum_exp(logits: Column) -> Column:
    return let(F.array_max(logits), lambda top: top + F.ln(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))))


def log_prob(logits: Column, pos: Column) -> Column:
    """Log-softmax of one zero-based position."""
    return F.element_at(logits, pos + 1) - log_sum_exp(logits)


def mean_log_prob(logits: Column) -> Column:
    """Mean of the log-softmax over all positions."""
    return total(logits) / F.size(logits) - log_sum_exp(logits)


def floor_prob(prob: Column, threshold) -> Column:
    """Zero below the threshold; a score equal to the threshold survives."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(prob < t, F.lit(0.0)).otherwise(prob)


def floor_uniform(values: Column) -> Column:
    """Zero the elements below ``1 / size`` of a full score array."""
    return let(F.lit(1.0) / F.size(values), lambda limit: F.transform(values, lambda x: floor_prob(x, limit)))


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda a, x: a * x)


def geometric_mean(values: Column) -> Column:
    """``NULL`` for an empty array."""
    n = F.size(values)
    return F.when(n > 0, F.pow(product(values), F.lit(1.0) / n))
