"""Exponentially weighted means and deviations.

``ewm`` is exact: the recursion runs per key in Arrow batches of whole series.  ``ewm_fold`` is a native
expression over the last rows, exact to the weight that lies beyond them; use it for short spans, long
series and streams.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.expr import KEY, ORDER, C, frame


class Ewm(NamedTuple):
    """An output column: what is averaged, how, and whether deviation instead of mean."""

    out: str
    column: str
    span: float | None = None
    alpha: float | None = None
    adjust: bool = False
    std: bool = False


def ewm(df: DataFrame, wanted: list[Ewm], key: str = KEY, order: str = ORDER) -> DataFrame:
    """Adds the wanted columns; NULL is missing, and weights decay over gaps."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(w.out, T.DoubleType()) for w in wanted)])

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        for w in wanted:
            e = pdf[w.column].astype(float).ewm(span=w.span, alpha=w.alpha, adjust=w.adjust)
            pdf[w.out] = e.std() if w.std else e.mean()
        return pdf

    return df.groupBy(key).applyInPandas(run, schema)


def alpha_of(span: float) -> float:
    return 2.0 / (span + 1.0)


def rows_for(alpha: float, error: float = 1e-14) -> int:
    """Rows after which all older weight together is below ``error``."""
    return math.ceil(math.log(error) / math.log(1.0 - alpha))


def ewm_fold(x: str | Column, alpha: float, rows: int | None = None, key: str = KEY, order: str = ORDER) -> Column:
    """Recursive mean (adjust=False) over the last rows, seeded with the first of them."""
    values = F.collect_list(C(x)).over(frame((rows or rows_for(alpha)) - 1, 0, key, order))
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(values, 0).cast("double"), lambda a, v: a * (1 - alpha) + v * alpha)
