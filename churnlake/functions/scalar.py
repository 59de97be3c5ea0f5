"""Scalar Column helpers (SC1-SC17)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: ColumnOrName) -> Column:
    """SC1: strip leading/trailing whitespace, any Unicode space (``trim``
    only removes blanks). ``(?U)`` makes ``\\s`` Unicode-aware in Java regex."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def clip_lower(c: ColumnOrName, lo) -> Column:
    """SC4: pandas ``clip(lower=lo)``; NULL stays NULL (``greatest`` skips NULLs)."""
    c = col(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(c, F.lit(lo)))


def clip(c: ColumnOrName, lo=None, hi=None) -> Column:
    """SC4: clip to [lo, hi]; NULL stays NULL."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def safe_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """SC5: division that yields NULL for a zero divisor under ANSI mode."""
    return F.try_divide(col(a), col(b))


def flag(cond: Column) -> Column:
    """SC6: boolean to 0/1 int; NULL comparisons count as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def logit(p: ColumnOrName) -> Column:
    """SC7: log(p / (1 - p))."""
    p = col(p)
    return F.ln(p / (F.lit(1.0) - p))


def sigmoid(x: ColumnOrName) -> Column:
    """SC7: 1 / (1 + exp(-x))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def round_half_even(c: ColumnOrName, scale: int = 0) -> Column:
    """SC8: Python/NumPy rounding (half-even)."""
    return F.bround(col(c), scale)


def round_half_up(c: ColumnOrName, scale: int = 0) -> Column:
    """SC9: JavaScript ``Math.round`` style rounding (half-up)."""
    return F.round(col(c), scale)


def fixed(c: ColumnOrName, digits: int) -> Column:
    """SC9: fixed-dp text like ``toFixed`` (no thousands separator)."""
    return F.format_string(f"%.{digits}f", col(c))


def trunc_int(c: ColumnOrName) -> Column:
    """SC10: Python ``int()`` truncation toward zero."""
    return col(c).cast("int")


def case_map(c: ColumnOrName, mapping: Mapping, default=None) -> Column:
    """SC12: dictionary lookup as a literal map (no join, stays in codegen)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = m[col(c)]
    return out if default is None else F.coalesce(out, F.lit(default))


def banding(c: ColumnOrName, cuts: Sequence[tuple[float, str]], otherwise: str, strict: bool = True) -> Column:
    """SC11: conditional chain ``> cut_1 -> label_1, > cut_2 -> label_2, ...``.

    ``strict`` uses ``>``, else ``>=``."""
    c = col(c)
    expr = None
    for cut, label in cuts:
        cond = (c > cut) if strict else (c >= cut)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(otherwise)


def soften(p: ColumnOrName, temperature: float = 2.5, lo: float = 0.001, hi: float = 0.999) -> Column:
    """SV1: clamp to [lo, hi], divide the logit by ``temperature``, back to a
    probability, times 100."""
    pc = F.least(F.greatest(col(p).cast("double"), F.lit(lo)), F.lit(hi))
    return sigmoid(logit(pc) / F.lit(float(temperature))) * F.lit(100.0)
