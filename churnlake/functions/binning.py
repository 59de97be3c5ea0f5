"""Interval binning (FE1), quantile cuts (FE2) and equal-frequency bins (FE3).

Bins are ``CASE`` expressions over the column, so the plan size is the number
of bins and everything stays inside whole-stage codegen. Data-dependent edges
(quantiles) are computed by a one-row aggregate that is cross-joined to the
rows: one lazy plan, no driver round trip.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import ColumnOrName, col

NAN_LABEL = "nan"  # what pandas ``cut(...).astype(str)`` yields outside the bins


def _edge(e: float) -> Column | None:
    return None if math.isinf(e) else F.lit(e)


def cut(c: ColumnOrName, edges: Sequence, labels: Sequence[str], right: bool = True,
        parity_nan: bool = False) -> Column:
    """FE1: ``pd.cut`` with explicit edges.

    ``right=True`` gives (e_i, e_i+1], ``right=False`` gives [e_i, e_i+1).
    Values outside every bin and NULLs give NULL, or the string ``'nan'`` in
    parity mode (R5). Edges may be ``±inf``; they may also be Columns (edges
    computed by an aggregate).
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("labels must be one fewer than the number of bin edges")
    x = col(c)
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lo_c = lo if isinstance(lo, Column) else _edge(lo)
        hi_c = hi if isinstance(hi, Column) else _edge(hi)
        conds = []
        if lo_c is not None:
            conds.append(x > lo_c if right else x >= lo_c)
        if hi_c is not None:
            conds.append(x <= hi_c if right else x < hi_c)
        cond = conds[0] if conds else x.isNotNull()
        for extra in conds[1:]:
            cond = cond & extra
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    miss = F.lit(NAN_LABEL) if parity_nan else F.lit(None).cast("string")
    return expr.otherwise(miss)


def quantile_stats(df: DataFrame, c: str, probs: Sequence[float], name: str = "q") -> DataFrame:
    """One-row DataFrame with the exact linear-interpolated quantiles of ``c``
    (pandas ``quantile``, DuckDB ``quantile_cont``) in an array column.

    Computed by distributed selection (``quantiles.exact_quantiles``): the
    driver sees per-bucket counts and a bounded number of values, never the
    whole value distribution, and no task merges every distinct value."""
    from .quantiles import quantile_row
    return quantile_row(df, c, probs, name)


def quantile_cut(df: DataFrame, c: str, probs: Sequence[float], labels: Sequence[str], out: str,
                 stats: DataFrame | None = None, parity_nan: bool = False) -> DataFrame:
    """FE2: ``pd.cut`` at (-inf, q(p_1), ..., q(p_k), inf], right-closed.

    ``stats`` is the one-row quantile table to use (fit on another table,
    R2); by default the quantiles of ``df`` itself.
    """
    if len(labels) != len(probs) + 1:
        raise ValueError("need len(probs) + 1 labels")
    st = stats if stats is not None else quantile_stats(df, c, probs, f"_{out}_q")
    qname = st.columns[0]
    edges = [-math.inf] + [F.col(qname)[i] for i in range(len(probs))] + [math.inf]
    joined = df.crossJoin(F.broadcast(st))  # one row by construction
    return joined.withColumn(out, cut(F.col(c), edges, labels, right=True, parity_nan=parity_nan)).drop(qname)


def qcut(df: DataFrame, c: str, q: int, labels: Sequence[str], out: str,
         on_duplicate: str = "raise") -> DataFrame:
    """FE3: ``pd.qcut(c, q, labels, duplicates='drop')``.

    Edges are the exact quantiles at 0, 1/q, ..., 1; the first bin includes
    its lower edge. pandas drops duplicate edges but keeps ``q`` labels and
    then fails (R6): by default the same error is raised inside the plan via
    ``raise_error``; ``on_duplicate='merge'`` drops duplicate edges and uses
    the first labels instead.
    """
    if len(labels) != q:
        raise ValueError("need q labels")
    probs = [i / q for i in range(q + 1)]
    qname = f"_{out}_edges"
    st = quantile_stats(df, c, probs, qname)
    if on_duplicate == "merge":
        st = st.withColumn(qname, F.array_distinct(F.col(qname)))
    elif on_duplicate != "raise":
        raise ValueError("on_duplicate must be 'raise' or 'merge'")
    e = F.col(qname)
    x = F.col(c)
    expr = F.when(x.isNull(), F.lit(None).cast("string"))
    for i, label in enumerate(labels):
        # bin i is [e0, e1] for i == 0, else (e_i, e_i+1]; with merged edges
        # only the first size(e) - 1 labels are reachable
        cond = (F.lit(i + 1) < F.size(e)) & (x <= F.element_at(e, i + 2))
        if i == 0:  # a single distinct edge (constant column, merge mode): one bin
            cond = cond | (F.size(e) == 1)
        expr = expr.when(cond, F.lit(label))
    expr = expr.otherwise(F.lit(None).cast("string"))
    if on_duplicate == "raise":
        expr = F.when(F.size(F.array_distinct(e)) < F.size(e),
                      F.raise_error(F.lit("Bin labels must be one fewer than the number of bin edges"))
                      .cast("string")).otherwise(expr)
    return df.crossJoin(F.broadcast(st)).withColumn(out, expr).drop(qname)
