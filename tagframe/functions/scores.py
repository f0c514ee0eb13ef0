"""Score → class / confidence expressions and repeatable hash-based draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def argmax2(logit0, logit1) -> Column:
    """Two-class argmax; a tie goes to class 0 (first maximum)."""
    return F.when(_c(logit1) > _c(logit0), F.lit(1)).otherwise(F.lit(0))


def softmax_p1(logit0, logit1) -> Column:
    """Softmax probability of class 1, max subtracted first for stability."""
    m = F.greatest(_c(logit0), _c(logit1))
    e0 = F.exp(_c(logit0) - m)
    e1 = F.exp(_c(logit1) - m)
    return e1 / (e0 + e1)


def softmax(arr) -> Column:
    """Softmax of an ``ARRAY<DOUBLE>`` of logits."""
    a = _c(arr)
    m = F.array_max(a)
    ex = F.transform(a, lambda x: F.exp(x - m))
    return F.transform(ex, lambda x: x / F.aggregate(ex, F.lit(0.0), lambda s, y: s + y))


def argmax(arr) -> Column:
    """0-based index of the first maximum of an array."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def threshold_class(p, cut: float = 0.5) -> Column:
    """Probability rule of the bag-of-words runs: ``p >= cut`` is class 1 (a tie goes to 1)."""
    return F.when(_c(p) >= F.lit(cut), F.lit(1)).otherwise(F.lit(0))


def uniform(key, seed: int) -> Column:
    """Repeatable draw in [0, 1) from ``md5(key || ':' || seed)``; same value in SQL."""
    h = F.md5(F.concat(_c(key).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
