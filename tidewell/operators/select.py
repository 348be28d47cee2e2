"""Feature selection: correlation pruning, variance inflation, binned mutual information, importance.

Moments of all columns come from one aggregation; only the small matrix of columns is on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _moments(columns: list[str], centre: list[float]):
    """Partial sums (i, j, n, a, b, aa, bb, ab) over the rows where both columns are known, one set a task."""

    def run(batches):
        import pyarrow as pa

        c = len(columns)
        sums = np.zeros((6, c, c))
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(c)], 1) - np.array(centre)
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0.0), known.astype(float)
            sums += [m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x]
        i, j = np.tril_indices(c, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(s[i, j]) for s in sums)], ["i", "j", "n", "a", "b", "aa", "bb", "ab"])

    return run


def _pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, r) of columns j < i: Pearson from one pass of matrix products, whose size doesn't depend on the rows."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    centre = x.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns]).first()  # keeps the sums small
    parts = x.mapInArrow(_moments(columns, [float(v) for v in centre]), "i int, j int, n double, a double, b double, aa double, bb double, ab double")
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")])
    va, vb = F.col("n") * F.col("aa") - F.col("a") * F.col("a"), F.col("n") * F.col("bb") - F.col("b") * F.col("b")
    return s.select("i", "j", F.when((va > 0) & (vb > 0), (F.col("n") * F.col("ab") - F.col("a") * F.col("b")) / F.sqrt(va * vb)).alias("r"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson, over the rows where both columns are known."""
    out = np.eye(len(columns))
    for r in _pairs(df, columns).collect() if len(columns) > 1 else []:  # a row per pair of columns
        out[r.i, r.j] = out[r.j, r.i] = np.nan if r.r is None else r.r
    return out


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long (a, b, r) for every pair of columns."""
    name = lambda c: F.element_at(F.array(*[F.lit(x) for x in columns]), F.col(c) + 1)
    return _pairs(df, columns).select(name("j").alias("a"), name("i").alias("b"), "r")


def prune_correlated(df: DataFrame, columns: list[str], most: float = 0.95) -> list[str]:
    """Columns without the later one of every pair correlated to ``most`` or more."""
    r = np.abs(correlation_matrix(df, columns))
    return [c for i, c in enumerate(columns) if not (r[i, :i] >= most).any()]


def _inflation(r: np.ndarray) -> np.ndarray:
    """1 / (1 - R2) of each column on the others, from a correlation matrix that may be singular."""
    out = np.ones(len(r))
    for i in range(len(r)):
        o = [j for j in range(len(r)) if j != i]
        if o:
            out[i] = 1 / max(1 - r[i, o] @ np.linalg.pinv(r[np.ix_(o, o)]) @ r[o, i], 1e-12)
    return out


def vif(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance inflation factors."""
    return dict(zip(columns, _inflation(correlation_matrix(df, columns)).tolist(), strict=True))


def prune_vif(df: DataFrame, columns: list[str], most: float = 10.0) -> list[str]:
    """Drops the column of greatest factor until all are within bounds; the matrix is computed once."""
    r, left = correlation_matrix(df, columns), list(range(len(columns)))
    while len(left) > 1:
        d = _inflation(r[np.ix_(left, left)])
        if d.max() <= most:
            break
        left.pop(int(d.argmax()))
    return [columns[i] for i in left]


def mutual_information(df: DataFrame, feature: str, label: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of equal-width bins of a feature and a label, one row."""
    ends = df.agg(F.min(feature).alias("lo"), F.max(feature).alias("hi"))
    x = df.where(F.col(feature).isNotNull() & F.col(label).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor(F.try_divide(F.col(feature) - F.col("lo"), width)), F.lit(bins - 1))
    c = x.groupBy(F.coalesce(b, F.lit(0)).alias("b"), F.col(label).alias("y")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    every = F.sum("n").over(Window.partitionBy(F.lit(1)))
    p = c.select("n", (F.col("n") / every).alias("p"), (F.sum("n").over(Window.partitionBy("b")) / every).alias("pb"), (F.sum("n").over(Window.partitionBy("y")) / every).alias("py"))
    return p.agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pb") * F.col("py")))).alias("mutual_information"))


def top_variance(df: DataFrame, columns: list[str], k: int = 3) -> list[str]:
    got = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first().asDict()
    return sorted(columns, key=lambda c: (-(got[c] or 0.0), c))[:k]


#: Blocks of features by parts of their names, first match wins.
BLOCKS = (("momentum", ("rsi", "macd", "roc", "momentum", "ema", "sma")), ("volatility", ("vol_", "volatility", "atr", "bb_", "parkinson", "garman")), ("liquidity", ("volume", "depth", "liquidity", "amihud")), ("microstructure", ("spread", "imbalance", "impact", "flow", "iceberg")))


def assign_blocks(columns: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {b: [] for b, _ in BLOCKS}
    for c in columns:
        for b, parts in BLOCKS:
            if any(p in c.lower() for p in parts):
                out[b].append(c)
                break
    return out


def principal_components(df: DataFrame, columns: list[str], share: float = 0.95) -> tuple[DataFrame, np.ndarray]:
    """Standardised columns projected on the components that hold ``share`` of the variance (pc_0, pc_1, ...)."""
    s = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    values, vectors = np.linalg.eigh(correlation_matrix(df, columns))
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    n = int(np.searchsorted(np.cumsum(values) / values.sum(), share) + 1)
    z = [(F.col(c) - s[c].m) / (s[c].s or 1.0) for c in columns]
    return df.withColumns({f"pc_{k}": sum((z[i] * float(vectors[i, k]) for i in range(len(columns))), F.lit(0.0)) for k in range(n)}), vectors[:, :n]


def split_by_time(df: DataFrame, shares: tuple[float, float] = (0.7, 0.15), key: str = "symbol") -> DataFrame:
    """split train, validation or test by position in time."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy("ts"))
    total = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("split", F.when(n <= F.floor(total * shares[0]), "train").when(n <= F.floor(total * (shares[0] + shares[1])), "validation").otherwise("test"))


def time_series_folds(df: DataFrame, folds: int = 5, key: str = "symbol") -> DataFrame:
    """fold -1 is training only; fold i is the i-th test block."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy("ts")) - 1
    total = F.count("*").over(Window.partitionBy(key))
    size = F.floor(total / (folds + 1))
    return df.withColumn("fold", F.greatest(F.least(F.floor(F.try_divide(n - (total - size * folds), size)), F.lit(folds - 1)), F.lit(-1)).cast("int"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * n_class) for each label, in place of synthetic samples."""
    from pyspark.sql import Window

    every = Window.partitionBy(F.lit(1))  # a row per class
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    return c.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Codes of distinct values in alphabetic order."""
    from pyspark.sql import Window

    codes = df.where(F.col(column).isNotNull()).select(column).distinct().withColumn(out, F.row_number().over(Window.orderBy(column)) - 1)  # a row per value
    return df.join(codes, column, "left")
