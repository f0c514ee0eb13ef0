"""Label binarisation, class maps, error outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw labels that count as "true" / "false" statements.
TRUE_LABELS = (3, 4, 5)
FALSE_LABELS = (0, 1, 2)
OUT_OF_RANGE = "Out-Of-Range"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def label_isin(label) -> Column:
    """``label in {3,4,5}`` as 0/1; every other value, null included, is 0."""
    return F.coalesce(_c(label).isin(*TRUE_LABELS), F.lit(False)).cast("int")


def label_three_way(label) -> Column:
    """{3,4,5} → 1, {0,1,2} → 0, anything else → null (see ``label_status``)."""
    lab = _c(label)
    return (F.when(lab.isin(*TRUE_LABELS), F.lit(1))
            .when(lab.isin(*FALSE_LABELS), F.lit(0))
            .otherwise(F.lit(None).cast("int")))


def label_status(label) -> Column:
    """``'ok'`` when ``label_three_way`` is defined, else ``'Out-Of-Range'``."""
    return F.when(_c(label).isin(*TRUE_LABELS, *FALSE_LABELS), F.lit("ok")).otherwise(F.lit(OUT_OF_RANGE))


def label_inverted(label, positive=FALSE_LABELS) -> Column:
    """``label in positive`` → 1 else 0; the default marks {0,1,2} as 1."""
    return F.coalesce(_c(label).isin(*positive), F.lit(False)).cast("int")


def class_map(label_binary) -> Column:
    """Binary label → ``{"1": b, "0": not b}``."""
    b = _c(label_binary).cast("boolean")
    return F.create_map(F.lit("1"), b, F.lit("0"), ~b)


def outcome(label, prediction) -> Column:
    """``TP`` / ``FP`` / ``FN`` / ``TN`` for a binary label and prediction."""
    y, p = _c(label), _c(prediction)
    return (F.when((y == 1) & (p == 1), F.lit("TP"))
            .when((y == 0) & (p == 1), F.lit("FP"))
            .when((y == 1) & (p == 0), F.lit("FN"))
            .when((y == 0) & (p == 0), F.lit("TN")))


def entity_display(word, entity) -> Column:
    """Python's repr of a ``(word, entity)`` tuple."""
    from tagframe.sources.literals import py_str
    return F.concat(F.lit("("), py_str(_c(word)), F.lit(", "), py_str(_c(entity)), F.lit(")"))
