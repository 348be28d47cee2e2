"""Regime rules, transitions and forecasts of regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import expr as E
from tidewell.functions.ewm import Ewm, ewm
from tidewell.operators.indicators import adx_ref


def ema_adx_features(bars: DataFrame, fast: int = 21, slow: int = 55, n: int = 14) -> DataFrame:
    return adx_ref(ewm(bars, [Ewm("ema_fast", "close", span=fast), Ewm("ema_slow", "close", span=slow)]), n)


def classify(features: DataFrame, slow: int = 55, trend: float = 25.0, sideways: float = 20.0, least_separation: float = 0.0) -> DataFrame:
    """regime BULL, BEAR or SIDEWAYS and a confidence, from ema_fast, ema_slow and adx.  0 < sideways < trend."""
    if not 0 < sideways < trend or least_separation < 0:
        raise ValueError("0 < sideways < trend, and separation isn't negative")
    x = features.withColumn("separation", F.coalesce(F.try_divide(F.abs(F.col("ema_fast") - F.col("ema_slow")), E.mean("close", slow)), F.lit(0.0)))
    adx, apart = F.col("adx"), F.col("separation")
    trending = (adx > sideways) & (adx >= trend) & (apart >= least_separation)
    regime = F.when(trending & (F.col("ema_fast") > F.col("ema_slow")), "BULL").when(trending & (F.col("ema_fast") < F.col("ema_slow")), "BEAR").otherwise("SIDEWAYS")
    share = lambda c: E.clip(c, 0, 1)
    flat, rising = 1 - adx / sideways, (share((adx - sideways) / (trend - sideways)) + share(10 * apart)) / 2
    return x.withColumn("regime", regime).withColumn("confidence", E.clip(F.when(F.col("regime") == "SIDEWAYS", flat).otherwise(rising), 0.2, 1))


def regime_ema_adx(bars: DataFrame) -> DataFrame:
    return classify(ema_adx_features(bars))


#: Steps of the trend, sideways and separation thresholds, their bounds, and the least distance of the first two.
STEPS, ADX_BOUNDS, SEPARATION_BOUNDS, GAP = (2.0, 1.0, 0.0005), (5.0, 60.0), (0.0, 0.02), 1.0


def calibrate(features: DataFrame, low: float = 0.25, high: float = 0.35, rounds: int = 6, trend: float = 25.0, sideways: float = 20.0, separation: float = 0.0) -> DataFrame:
    """Moves the thresholds until the share of SIDEWAYS is within bounds: one row of thresholds, the share and the rounds taken.

    Too many make trends easier (all thresholds fall), too few make them harder.  All states that rounds can reach are known
    beforehand, so their shares come from one aggregation and the walk through them from the driver.
    """
    def moved(state: tuple[float, float, float], sign: int) -> tuple[float, float, float]:
        t, s, e = state
        t = min(max(t + sign * STEPS[0], ADX_BOUNDS[0]), ADX_BOUNDS[1])
        s = min(max(s + sign * STEPS[1], ADX_BOUNDS[0]), t - GAP)
        return t, s, min(max(e + sign * STEPS[2], SEPARATION_BOUNDS[0]), SEPARATION_BOUNDS[1])

    reach, edge = {(trend, sideways, separation)}, {(trend, sideways, separation)}
    for _ in range(rounds):
        edge = {moved(x, sign) for x in edge for sign in (-1, 1)} - reach
        reach |= edge
    order = sorted(reach)
    x = classify(features, trend=trend, sideways=sideways)
    up = F.col("ema_fast") != F.col("ema_slow")
    flat = lambda t, s, e: F.avg((~((F.col("adx") > s) & (F.col("adx") >= t) & (F.col("separation") >= e) & up)).cast("int"))
    got = x.agg(*[F.coalesce(flat(*v), F.lit(0.0)).alias(f"s{n}") for n, v in enumerate(order)]).first()
    share, state, n = {v: got[f"s{i}"] for i, v in enumerate(order)}, (trend, sideways, separation), 0
    while n < rounds and not low <= share[state] <= high:
        state, n = moved(state, -1 if share[state] > high else 1), n + 1
    return features.sparkSession.createDataFrame([(*state, float(share[state]), n)], "trend double, sideways double, separation double, share double, rounds int")


def distribution(df: DataFrame, column: str = "regime", keys: list[str] | None = None) -> DataFrame:
    """Counts and shares of values."""
    c = df.groupBy(*(keys or []), column).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*(keys or [F.lit(1)]))))


def transitions(df: DataFrame, column: str = "regime", key: str = E.KEY) -> DataFrame:
    """Rows at which the value differs from the row before."""
    x = df.withColumns({"from_value": E.lag(column, key=key), "row_index": F.row_number().over(E.series(key)) - 1})
    return x.where(F.col("from_value").isNotNull() & (F.col("from_value") != F.col(column))).select(key, "ts", "row_index", "from_value", F.col(column).alias("to_value"))


def transition_matrix(df: DataFrame, column: str = "regime", key: str = E.KEY) -> DataFrame:
    """Long (from_value, to_value, n, p): counts of successions, and their share of the row."""
    x = df.select(F.col(column).alias("from_value"), E.lag(column, -1, key=key).alias("to_value")).where("to_value is not null")
    c = x.groupBy("from_value", "to_value").agg(F.count("*").alias("n"))
    return c.withColumn("p", F.col("n") / (F.sum("n").over(Window.partitionBy("from_value")) + 1e-9))


def next_probabilities(df: DataFrame, values: list[str], column: str = "regime", key: str = E.KEY) -> DataFrame:
    """p_next_<value>: the share of successions of the row's value that went there, over all series; 0 where it has none.

    The matrix has a row per value, so Spark broadcasts it by its measured size.
    """
    m = transition_matrix(df, column, key).groupBy(F.col("from_value").alias(column)).agg(*[F.sum(F.when(F.col("to_value") == v, F.col("p"))).alias(f"p_next_{v}") for v in values])
    return df.join(m, column, "left").withColumns({f"p_next_{v}": F.coalesce(f"p_next_{v}", F.lit(0.0)) for v in values})


def smoothed_probabilities(df: DataFrame, values: list[str], column: str = "regime", span: int = 3) -> DataFrame:
    """p_<value> by exponential means of indicators, normalised; change, second change and entropy."""
    x = df.withColumns({f"_i_{v}": (F.col(column) == v).cast("double") for v in values})
    x = ewm(x, [Ewm(f"_e_{v}", f"_i_{v}", span=span) for v in values])
    total = sum((F.col(f"_e_{v}") for v in values), F.lit(0.0))
    x = x.withColumns({f"p_{v}": F.col(f"_e_{v}") / total for v in values})
    x = x.withColumns({f"dp_{v}": F.coalesce(E.diff(f"p_{v}"), F.lit(0.0)) for v in values})
    x = x.withColumns({f"d2p_{v}": F.coalesce(E.diff(f"dp_{v}"), F.lit(0.0)) for v in values})
    entropy = -sum((F.col(f"p_{v}") * F.ln(F.greatest(F.col(f"p_{v}"), F.lit(1e-12))) for v in values), F.lit(0.0))
    return x.withColumn("entropy", entropy).drop(*[f"_{k}_{v}" for k in "ie" for v in values])


def emergence(df: DataFrame, p: str, horizon: int = 5, run: int = 3, level: float = 0.6, key: str = E.KEY) -> DataFrame:
    """1 where within the next bars p stays at or above the level for a run."""
    ok = lambda k: F.coalesce(E.lag(p, -k, key=key) >= level, F.lit(False))
    any_run = F.lit(False)
    for s in range(1, horizon - run + 2):
        whole = F.lit(True)
        for k in range(s, s + run):
            whole = whole & ok(k)
        any_run = any_run | whole
    return df.withColumn("emergence", any_run.cast("int"))


def exit_hazard(df: DataFrame, value: str, column: str = "regime", key: str = E.KEY) -> DataFrame:
    """1 where the value holds now and not at the next bar; the last bar has none."""
    nxt = E.lag(column, -1, key=key)
    return df.withColumn("exit_hazard", F.when(nxt.isNotNull(), ((F.col(column) == value) & (nxt != value)).cast("int")).otherwise(0))


def cosine(a, b):
    """Cosine of two arrays; NULL where one has length 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


def cosine_to_centroid(df: DataFrame, vector: str, label: str, dimensions: int) -> DataFrame:
    """Each row's cosine to the mean vector of its label; centroids are one grouped aggregate."""
    mean = df.groupBy(label).agg(F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(dimensions)]).alias("centroid"))
    return df.join(mean, label).withColumn("cosine", cosine(F.col(vector), F.col("centroid")))


def entropy_of(vector):
    """Shannon entropy of absolute values taken as shares."""
    a = F.transform(vector, lambda x: F.abs(x.cast("double")))
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return -F.aggregate(a, F.lit(0.0), lambda s, x: s + F.when(x > 0, x / total * F.ln(x / total)).otherwise(0.0))


def combination_key(df: DataFrame, blocks: list[str], least_share: float = 0.005) -> DataFrame:
    """block:state|... keys, kept where frequent enough."""
    x = df.withColumn("combination", F.concat_ws("|", *[F.concat(F.lit(f"{b}:"), F.col(b).cast("string")) for b in blocks]))
    total = x.count()
    frequent = x.groupBy("combination").count().where(F.col("count") >= least_share * total).select("combination")
    return x.join(frequent, "combination", "left_semi")


def state_names(df: DataFrame, score: str, names: tuple[str, str, str] = ("low", "mid", "high")) -> DataFrame:
    """Tertile names of states by score."""
    r = F.percent_rank().over(Window.orderBy(score))  # a row per state
    return df.withColumn("state_name", F.when(r < 1 / 3, names[0]).when(r < 2 / 3, names[1]).otherwise(names[2]))


def location(bars: DataFrame, long: int = 720, short: int = 24, near: float = 0.01, least_touches: int = 1, of: str | None = None, key: str = E.KEY) -> DataFrame:
    """Where a bar stands: PIVOT_S or PIVOT_R near a classic level of the ``short`` bars before, HVN_SUPPORT or HVN_RESISTANCE near one of
    the two levels of greatest volume that were touched, CONFLUENCE_S or CONFLUENCE_R near both kinds, else OPEN_RANGE.

    ``of``: the column that is compared with the levels; by default the change of the close, as in the model this restates (which
    is near a price only where prices are near 0); "close" compares prices.  The first ``long`` bars are OPEN_RANGE.
    """
    from tidewell.operators.profile import volume_levels

    w = E.frame(short, -1, key=key)
    x = bars.withColumns({"_i": F.row_number().over(E.series(key)) - 1, "_n": F.count("*").over(Window.partitionBy(key)), "_v": F.col(of) if of else E.diff("close", key=key), "_h": F.max("high").over(w), "_l": F.min("low").over(w), "_c": F.last("close").over(w)})
    v, h, l = F.col("_v"), F.col("_h"), F.col("_l")
    x = x.withColumn("_p", (h + l + F.col("_c")) / 3)
    p = F.col("_p")
    close_to = lambda level: F.coalesce(F.abs(v - level) / (F.abs(v) + 1e-8) <= near, F.lit(False))
    at = lambda level: (level > 0) & close_to(level)
    pivot = F.when(at(2 * p - h) | at(p - (h - l)), "S").when(at(2 * p - l) | at(p + (h - l)), "R")
    levels = volume_levels(bars, 2, key).where(F.col("touches") >= least_touches).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "price"))).alias("_levels"))  # two levels a series
    x = x.withColumn("_pivot", pivot).join(levels, key, "left")
    hit = F.get(F.filter(F.coalesce("_levels", F.array().cast("array<struct<rank:int,price:double>>")), lambda y: close_to(y["price"])), 0)
    x = x.withColumn("_node", F.when(hit.isNotNull(), F.when(v > hit["price"], "SUPPORT").otherwise("RESISTANCE")))
    both = F.when((F.col("_pivot") == "S") & (F.col("_node") == "SUPPORT"), "CONFLUENCE_S").when((F.col("_pivot") == "R") & (F.col("_node") == "RESISTANCE"), "CONFLUENCE_R")
    name = F.coalesce(both, F.concat(F.lit("PIVOT_"), "_pivot"), F.concat(F.lit("HVN_"), "_node"), F.lit("OPEN_RANGE"))
    ready = (F.col("_n") >= long) & (F.col("_i") >= long) & v.isNotNull()
    return x.withColumn("location", F.when(ready, name).otherwise("OPEN_RANGE")).drop("_i", "_n", "_v", "_h", "_l", "_c", "_p", "_pivot", "_levels", "_node")


def volatile(df: DataFrame, n: int = 100, share: float = 0.8, atr: float = 0.035, width: float = 0.045, key: str = E.KEY) -> DataFrame:
    """1 where any sign of high volatility shows: a high rolling rank of either volatility, a wide normalised ATR or band, or a rise of volatility.

    Columns: ewma_volatility_20, volatility_10, volatility_20, atr_normalized, bb_width.
    """
    ranks = [F.coalesce(E.rolling_rank_pct(c, n, key=key) > share, F.lit(False)) for c in ("ewma_volatility_20", "volatility_10")]
    more = [F.coalesce(c, F.lit(False)) for c in (F.col("atr_normalized") > atr, F.col("bb_width") > width, E.diff("volatility_20", key=key) > 0)]
    out = ranks[0] | ranks[1]
    for c in more:
        out = out | c
    return df.withColumn("volatility_regime", out.cast("int"))


REGIME_FEATURES = (
    "log_returns", "price_change", "high_low_diff_ratio", "close_open_diff_ratio", "volatility_20", "volatility_10", "volatility_5", "ewma_volatility_20", "volume_ratio", "volume_change",
    "rsi", "macd", "macd_signal", "macd_hist", "bb_position", "bb_width", "atr", "atr_normalized", "adx", "volatility_regime", "volatility_acceleration", "volatility_momentum",
)


def regime_features(bars: DataFrame, key: str = E.KEY) -> DataFrame:
    """REGIME_FEATURES of every bar; NULL while a window is not full."""
    from tidewell.operators.indicators import atr, bollinger, macd, rsi

    c, tiny = F.col, 1e-8
    ratio = lambda a, b: F.when(F.abs(E.diff(b, key=key)) > tiny, E.clip(E.div(E.diff(a, key=key), E.diff(b, key=key)), -100, 100)).otherwise(1.0)
    x = bars.withColumns({"log_returns": E.log_return("close", key=key), "price_change": E.pct("close", key=key), "high_low_diff_ratio": ratio("high", "low"), "close_open_diff_ratio": ratio("close", "open"), "volume_change": E.pct("volume", key=key)})
    x = x.withColumns({f"volatility_{n}": E.std("log_returns", n, key=key) for n in (20, 10, 5)})
    x = ewm(x, [Ewm("ewma_volatility_20", "log_returns", span=20, std=True)])
    mean = E.mean("volume", 20, key=key)
    x = x.withColumn("volume_ratio", F.when(mean > tiny, E.clip(E.div("volume", mean), 0, 50)).otherwise(1.0))
    x = adx_ref(atr(bollinger(macd(rsi(x)))))
    x = x.withColumn("atr_normalized", E.clip(c("atr") / (F.abs(E.diff("close", key=key)) + tiny), 0, 10))
    x = volatile(x, key=key).withColumns({"volatility_acceleration": E.diff("volatility_20", key=key), "volatility_momentum": E.diff("volatility_20", 5, key=key)})
    return x.select(*bars.columns, *REGIME_FEATURES)
