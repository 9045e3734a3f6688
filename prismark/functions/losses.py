"""Distribution distances over arrays of log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPSILON = 2.220446049250313e-16


def log_softmax(values: Column) -> Column:
    """Log-probabilities of an array of logits."""
    top = F.array_max(values)
    total = F.aggregate(F.transform(values, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    return F.transform(values, lambda x: x - top - F.log(total))


def mass(logs: Column) -> Column:
    return F.aggregate(F.transform(logs, F.exp), F.lit(0.0), lambda s, x: s + x)


def sparse_forward_kl(teacher: Column, student: Column, temperature: float = 1.0) -> Column:
    """Forward KL on the teacher's top entries, with what is left of both as one more outcome.

    Null where the teacher's mass exceeds 1.
    """
    p, q = mass(teacher), F.least(mass(student), F.lit(1.0 - EPSILON))
    inner = F.aggregate(F.zip_with(teacher, student, lambda t, s: F.exp(t) * (t - s)), F.lit(0.0), lambda a, x: a + x)
    rest = F.greatest(1.0 - p, F.lit(EPSILON))
    return F.when(p <= 1.0001, (inner + rest * (F.log(rest) - F.log1p(-q))) * temperature**2)
