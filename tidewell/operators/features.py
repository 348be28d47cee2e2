"""Derived features: stationarity, interactions, supports, multi-timeframe sets, label intensities and weights, model stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import expr as E


def stationarity(df: DataFrame, column: str, key: str = E.KEY, n: int = 20) -> DataFrame:
    """Per series: slope over position, lag-1 autocorrelation, ratio of the last to the first rolling deviation."""
    x = df.withColumns({"_i": (F.row_number().over(E.series(key)) - 1).cast("double"), "_l": E.lag(column, key=key), "_s": E.std(column, n, key=key)})
    return x.groupBy(key).agg(F.regr_slope(column, "_i").alias("slope"), F.corr(column, "_l").alias("autocorrelation"), F.try_divide(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("_i"))), F.min_by("_s", F.when(F.col("_s").isNotNull(), F.col("_i")))).alias("deviation_ratio"))


def safe_returns(df: DataFrame, column: str = "close", key: str = E.KEY) -> DataFrame:
    """Relative and logarithmic changes of the carried-forward column, 0 where undefined."""
    x = df.withColumn("_f", E.ffill(column, key=key))
    return x.withColumns({"pct_change": F.coalesce(E.pct("_f", key=key), F.lit(0.0)), "log_return": F.coalesce(E.log_return("_f", key=key), F.lit(0.0))}).drop("_f")


def interactions(df: DataFrame, predictors: list[str], targets: list[str]) -> DataFrame:
    """Products, ratios and conditional emphasis (doubled where both are above 0) of pairs at the same bar."""
    out = {}
    for p in predictors:
        for t in targets:
            out[f"{p}_x_{t}"] = F.col(p) * F.col(t)
            out[f"{p}_over_{t}"] = E.div(p, t)
            out[f"{p}_if_{t}"] = F.when((F.col(p) > 0) & (F.col(t) > 0), 2.0 * F.col(p)).otherwise(F.col(p))
    return df.withColumns(out)


def strongest(df: DataFrame, columns: list[str], k: int, key: str = E.KEY) -> DataFrame:
    """For the last row of each key: the k columns of greatest absolute value, long."""
    last = df.groupBy(key).agg(*[F.max_by(c, "ts").alias(c) for c in columns])
    rows = F.array_sort(F.array(*[F.struct((-F.abs(c)).alias("o"), F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns]))
    return last.select(key, F.explode(F.slice(rows, 1, k)).alias("x")).select(key, "x.feature", "x.value")


def supports(df: DataFrame, n: int = 20, key: str = E.KEY) -> DataFrame:
    """Rolling support and resistance with the classic pivots of the bar before."""
    h, l, c = (E.lag(x, key=key) for x in ("high", "low", "close"))
    p = (h + l + c) / 3
    return df.withColumns({"support": E.low("low", n, 1, key=key), "resistance": E.high("high", n, 1, key=key), "pivot_r1": 2 * p - l, "pivot_s1": 2 * p - h, "momentum_n": E.diff("close", n, key=key)})


def multi_timeframe(bars: DataFrame, frames: dict[str, str], key: str = E.KEY, causal: bool = True) -> DataFrame:
    """Change, volatility and volume ratio of each longer timeframe on base bars.  frames: interval here to interval in SQL."""
    from tidewell.operators.align import higher_timeframe
    from tidewell.operators.bars import resample

    out = bars
    for f, interval in frames.items():
        r = resample(bars, f).withColumn("_r", E.pct("close", key=key))
        own = [f"{f}_change", f"{f}_volatility", f"{f}_volume_ratio"]
        r = r.select(key, "ts", F.col("_r").alias(own[0]), E.std("_r", 20, 2, key=key).alias(own[1]), E.div("volume", E.mean("volume", 20, 1, key=key)).alias(own[2]))
        out = higher_timeframe(out, r, own, interval, key, causal)
    return out


def expanding_rank(df: DataFrame, column: str, key: str = E.KEY, block: int = 2048) -> DataFrame:
    """Share of values so far that are at most the current one (NULL for NULL, which doesn't count).

    Per series in Arrow batches: a block of values is looked up in the sorted values before it and compared within itself.
    """

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("ts")
        at = table.schema.names.index(column)
        known = np.flatnonzero(table.column(at).is_valid().to_numpy())
        v = table.column(at).take(pa.array(known)).to_numpy().astype(float)
        seen, out = np.zeros(0), np.full(len(table), np.nan)
        for i in range(0, len(v), block):
            own = v[i : i + block]
            inside = np.tril(own[None, :] <= own[:, None]).sum(1)
            out[known[i : i + block]] = (np.searchsorted(seen, own, "right") + inside) / (i + 1 + np.arange(len(own)))
            seen = np.sort(np.concatenate([seen, own]), kind="stable")
        return table.append_column(f"{column}_rank", pa.array(out, pa.float64(), mask=np.isnan(out)))

    from pyspark.sql import types as T

    return df.groupBy(key).applyInArrow(run, T.StructType([*df.schema.fields, T.StructField(f"{column}_rank", T.DoubleType())]))


def normalised(bars: DataFrame, n: int = 20, key: str = E.KEY) -> DataFrame:
    """Log price without its rolling mean, and volume in rolling deviations from its mean (frames may be shorter at the start)."""
    p, w = F.ln("close"), E.frame(n - 1, 0, key=key)
    return bars.withColumns({"detrended": p - F.avg(p).over(w), "normalised_volume": F.try_divide(F.col("volume") - F.avg("volume").over(w), F.stddev_samp("volume").over(w))})


def snapshot(df: DataFrame, columns: list[str], flags: dict, key: str = E.KEY, ts: str = "ts") -> DataFrame:
    """The latest row of each series: values and flags (conditions, 1 or 0)."""
    x = df.select(key, ts, *columns, *[E.flag(c).alias(n) for n, c in flags.items()])
    return x.groupBy(key).agg(F.max_by(F.struct(ts, *columns, *flags), ts).alias("x")).select(key, "x.*")


def volume_summary(bars: DataFrame, n: int = 20, k: int = 5, key: str = E.KEY) -> DataFrame:
    """At the last bar of each series: vwap of n bars, volume-price trend, change of volume over k bars and its ratio to the mean of n."""
    x = bars.withColumn("_f", F.col("volume") * E.pct("close", key=key)).withColumns({
        "vwap": E.div(E.total(F.col("close") * F.col("volume"), n, key=key), E.total("volume", n, key=key)), "vpt": E.cumulative("_f", key=key),
        "volume_roc": E.pct("volume", k, key=key), "volume_ma_ratio": E.div("volume", E.mean("volume", n, key=key)),
    })
    return x.groupBy(key).agg(F.max_by(F.struct("ts", "vwap", "vpt", "volume_roc", "volume_ma_ratio"), "ts").alias("_x")).select(key, "_x.*")


def slopes(df: DataFrame, columns: tuple[str, ...] = ("ema_20", "sma_50"), key: str = E.KEY) -> DataFrame:
    """Change of each column from the bar before."""
    return df.withColumns({f"{c}_slope": E.diff(c, key=key) for c in columns})


def intensity(df: DataFrame, scales: dict[str, tuple[float, float]], ranks: list[str], out: str = "intensity") -> DataFrame:
    """Mean of linear scales (column between lo and hi, within [0, 1]) and of ranks already in [0, 1]."""
    parts = [E.clip((F.col(c) - lo) / (hi - lo), 0, 1) for c, (lo, hi) in scales.items()] + [F.col(r) for r in ranks]
    return df.withColumn(out, sum(parts[1:], parts[0]) / len(parts))


def label_weights(df: DataFrame, keys: list[str], intensity_: str = "intensity", confidence: str = "confidence", reliability: str = "reliability") -> DataFrame:
    """Weights by intensity times confidence times reliability that add up to 1 within the keys."""
    w = F.col(intensity_) * F.col(confidence) * F.col(reliability)
    return df.withColumn("_w", w).withColumn("weight", F.coalesce(F.try_divide("_w", F.sum("_w").over(Window.partitionBy(*keys))), F.lit(0.0))).drop("_w")


def state_medians(df: DataFrame, state: str, columns: list[str]) -> DataFrame:
    return df.groupBy(state).agg(*[F.median(c).alias(f"{c}_median") for c in columns])


def data_quality(df: DataFrame, ts: str = "ts", minutes: int = 60, key: str = E.KEY) -> DataFrame:
    """Rows, nulls, repeated timestamps and coverage of the expected grid per key."""
    cols = [c for c in df.columns if c not in (key, ts)]
    nulls = sum((F.sum(F.col(c).isNull().cast("int")) for c in cols), F.lit(0))
    span = (F.unix_timestamp(F.max(ts).cast("timestamp")) - F.unix_timestamp(F.min(ts).cast("timestamp"))) / (60 * minutes) + 1
    return df.groupBy(key).agg(F.count("*").alias("n_rows"), nulls.cast("long").alias("n_null"), (F.count("*") - F.count_distinct(ts)).alias("n_repeated"), F.try_divide(F.count_distinct(ts), span).alias("coverage"))


def gaussian_states(df: DataFrame, columns: list[str], k: int, seed: int = 7) -> DataFrame:
    """Posteriors of a Gaussian mixture over columns, in place of hidden Markov states (it knows no order in time)."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df)
    m = GaussianMixture(k=k, seed=seed, featuresCol="_v", predictionCol="state", probabilityCol="_p").fit(x)
    return m.transform(x).withColumn("posteriors", vector_to_array("_p")).drop("_v", "_p")


def importance(df: DataFrame, columns: list[str], label: str, seed: int = 7) -> list[tuple[str, float]]:
    """Feature importances of boosted trees (another model than the ones they stand in for)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df)
    m = GBTClassifier(featuresCol="_v", labelCol=label, maxIter=10, maxDepth=3, seed=seed).fit(x)
    return sorted(zip(columns, m.featureImportances.toArray().tolist(), strict=True), key=lambda v: -v[1])
