"""Scores of treatment against background, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import LOG10_E, pscore


def log_lr(x: Column, y: Column) -> Column:
    """Log10 likelihood ratio of enrichment, negative where depleted."""
    v = (x * (F.log(x) - F.log(y)) + y - x) * LOG10_E
    return F.when(x > y, v).when(x < y, -v).otherwise(0.0)


def log_lr_sym(x: Column, y: Column) -> Column:
    """Log10 likelihood ratio between two conditions, positive where the first is larger."""
    return F.when(x > y, (x * (F.log(x) - F.log(y)) + y - x) * LOG10_E).when(x < y, (y * (F.log(x) - F.log(y)) + y - x) * LOG10_E).otherwise(0.0)


#: Methods on (treatment, control) that need no other row. ``q`` needs the whole track: see ``operators.qvalue``.
METHODS = {
    "p": lambda t, c: pscore(t, c),
    "l": log_lr,
    "s": log_lr_sym,
    "f": lambda t, c: F.log10(F.try_divide(t, c)),
    "F": lambda t, c: F.try_divide(t, c),
    "d": lambda t, c: t - c,
    "M": lambda t, c: F.greatest(t, c),
}
#: Methods by the name used on command lines.
NAMES = {"ppois": "p", "qpois": "q", "subtract": "d", "logFE": "f", "FE": "F", "logLR": "l", "slogLR": "s", "max": "M"}


def score(method: str, treat: Column, ctrl: Column, pseudocount: float = 0.0, treat_depth: float = 1.0, ctrl_depth: float = 1.0) -> Column:
    """Score of a segment by a method's letter; the pseudocount is added to both sides (not for ``d``, ``m`` and ``M``)."""
    if method == "m":  # signal per million reads of the treatment
        return treat / treat_depth
    if method in ("d", "M"):
        return METHODS[method](treat, ctrl)
    return METHODS[method](treat + pseudocount, ctrl + pseudocount)


def normalization(mode: str, treat_depth: float, ctrl_depth: float, was: str = "N") -> tuple[float, float]:
    """Factors for treatment and control from mode ``was``: T to the treatment's depth, C to the control's, M to a million, N as counted."""
    from_counts = {"T": (1.0, treat_depth / ctrl_depth), "C": (ctrl_depth / treat_depth, 1.0), "M": (1.0 / treat_depth, 1.0 / ctrl_depth), "N": (1.0, 1.0)}
    (t, c), (t0, c0) = from_counts[mode], from_counts[was]
    return t / t0, c / c0


def normalize(cells: DataFrame, mode: str, treat_depth: float, ctrl_depth: float, was: str = "N") -> DataFrame:
    """Cells with ``treat`` and ``ctrl`` taken from one normalization to another."""
    t, c = normalization(mode, treat_depth, ctrl_depth, was)
    return cells.withColumn("treat", F.col("treat") * t).withColumn("ctrl", F.col("ctrl") * c)
