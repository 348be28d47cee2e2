"""Technical indicators as window expressions over bars (symbol, ts, open, high, low, close, volume).

Each function takes bars and returns them with named columns added.  ``on='diff'`` applies an indicator to
price differences instead of prices.  Warm-up values are NULL unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import expr as E
from tidewell.functions.ewm import Ewm, ewm


def _source(bars: DataFrame, on: str, column: str = "close") -> DataFrame:
    return bars.withColumn("_x", E.diff(column) if on == "diff" else F.col(column))


def moving_averages(bars: DataFrame, windows: tuple[int, ...] = (5, 10, 20, 50), spans: tuple[int, ...] = (12, 20, 26, 50), on: str = "price") -> DataFrame:
    bars = _source(bars, on).withColumns({f"sma_{n}": E.mean("_x", n) for n in windows})
    bars = _source(bars.drop("_x"), on)
    return ewm(bars, [Ewm(f"ema_{n}", "_x", span=n) for n in spans]).drop("_x")


#: What RSI is where the mean loss is 0, by convention.
RSI_FLAT = {"neutral": 50.0, "zero": 0.0, "strong": 100.0}


def rsi(bars: DataFrame, n: int = 14, least_rows: int | None = 1, flat: str = "neutral", on: str = "price", out: str = "rsi") -> DataFrame:
    """Relative strength by simple means of gains and losses."""
    bars = _source(bars, on).withColumn("_d", E.diff("_x"))
    gain, loss = F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0), F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)
    bars = bars.withColumns({"_g": gain, "_l": loss}).withColumns({"_g": E.mean("_g", n, least_rows), "_l": E.mean("_l", n, least_rows)})
    value = 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide("_g", "_l"))
    return bars.withColumn(out, F.when(F.col("_l").isNull(), None).otherwise(F.coalesce(value, F.lit(RSI_FLAT[flat])))).drop("_x", "_d", "_g", "_l")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, adjust: bool = False, on: str = "price") -> DataFrame:
    """macd, macd_signal, macd_hist, by name."""
    bars = ewm(_source(bars, on), [Ewm("_f", "_x", span=fast, adjust=adjust), Ewm("_s", "_x", span=slow, adjust=adjust)]).withColumn("macd", F.col("_f") - F.col("_s"))
    bars = ewm(bars, [Ewm("macd_signal", "macd", span=signal, adjust=adjust)])
    return bars.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_x", "_f", "_s")


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, least_rows: int | None = 1, on: str = "price") -> DataFrame:
    """bb_upper, bb_lower, bb_position, bb_width, bb_z."""
    bars = _source(bars, on).withColumns({"_m": E.mean("_x", n, least_rows), "_s": E.std("_x", n, least_rows)})
    bars = bars.withColumns({"bb_upper": F.col("_m") + k * F.col("_s"), "bb_lower": F.col("_m") - k * F.col("_s")})
    return bars.withColumns({
        "bb_position": F.try_divide(F.col("_x") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")),
        "bb_width": F.try_divide(F.col("bb_upper") - F.col("bb_lower"), "_m"),
        "bb_z": F.try_divide(F.col("_x") - F.col("_m"), "_s"),
    }).drop("_x", "_m", "_s")


def true_range() -> Column:
    """Greatest of high - low and the distances to the previous close (NULL ones skipped)."""
    c1 = E.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c1), F.abs(F.col("low") - c1))


def atr(bars: DataFrame, n: int = 14, least_rows: int | None = None, out: str = "atr") -> DataFrame:
    return bars.withColumn("tr", true_range()).withColumn(out, E.mean("tr", n, least_rows))


def atr_wilder(bars: DataFrame, n: int = 14) -> DataFrame:
    return ewm(bars.withColumn("tr", true_range()), [Ewm("atr", "tr", alpha=1 / n)])


def adx_ref(bars: DataFrame, n: int = 14, fill: float = 25.0) -> DataFrame:
    """ADX by exponential means with the unsigned falling move: minus DM is the rise of the low."""
    up, down = E.diff("high"), E.diff("low")
    bars = bars.withColumns({"tr": true_range(), "_u": up, "_d": down})
    bars = bars.withColumns({"_p": F.when((F.col("_u") > F.col("_d")) & (F.col("_u") > 0), F.col("_u")).when(F.col("_u").isNotNull(), 0.0), "_m": F.when((F.col("_d") > F.col("_u")) & (F.col("_d") > 0), F.col("_d")).when(F.col("_d").isNotNull(), 0.0)})
    bars = ewm(bars, [Ewm("_a", "tr", alpha=1 / n), Ewm("_pe", "_p", alpha=1 / n), Ewm("_me", "_m", alpha=1 / n)])
    plus, minus = 100 * F.try_divide("_pe", "_a"), 100 * F.try_divide("_me", "_a")
    bars = bars.withColumn("_dx", 100 * F.try_divide(F.abs(plus - minus), plus + minus))
    bars = ewm(bars, [Ewm("adx", "_dx", alpha=1 / n)])
    return bars.withColumn("adx", F.coalesce("adx", F.lit(fill))).drop("_u", "_d", "_p", "_m", "_a", "_pe", "_me", "_dx", "tr")


def adx_wilder(bars: DataFrame, n: int = 14, least_rows: int = 5, fill: float = 20.0) -> DataFrame:
    """ADX by rolling means with the usual sign of the falling move."""
    bars = bars.withColumns({"tr": true_range(), "_u": E.diff("high"), "_d": -E.diff("low")})
    bars = bars.withColumns({"_p": F.when((F.col("_u") > F.col("_d")) & (F.col("_u") > 0), F.col("_u")).otherwise(0.0), "_m": F.when((F.col("_d") > F.col("_u")) & (F.col("_d") > 0), F.col("_d")).otherwise(0.0)})
    bars = bars.withColumns({"_a": E.mean("tr", n, least_rows), "_pe": E.mean("_p", n, least_rows), "_me": E.mean("_m", n, least_rows)})
    plus, minus = 100 * F.try_divide("_pe", "_a"), 100 * F.try_divide("_me", "_a")
    bars = bars.withColumn("_dx", 100 * F.try_divide(F.abs(plus - minus), plus + minus))
    return bars.withColumn("adx", F.coalesce(E.mean("_dx", n, least_rows), F.lit(fill))).drop("_u", "_d", "_p", "_m", "_a", "_pe", "_me", "_dx", "tr")


def stochastic(bars: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    """stoch_k (smoothed) and stoch_d; definition: published."""
    low, high = E.low("low", n), E.high("high", n)
    bars = bars.withColumn("_k", 100 * F.try_divide(F.col("close") - low, high - low))
    return bars.withColumn("stoch_k", E.mean("_k", smooth)).withColumn("stoch_d", E.mean("stoch_k", smooth)).drop("_k")


def williams_r(bars: DataFrame, n: int = 14) -> DataFrame:
    low, high = E.low("low", n), E.high("high", n)
    return bars.withColumn("willr", -100 * F.try_divide(high - F.col("close"), high - low))


def cci(bars: DataFrame, n: int = 20) -> DataFrame:
    """Commodity channel index; the mean deviation is that of the window around its own mean."""
    bars = bars.withColumn("_t", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("_m", E.mean("_t", n)).withColumn("_v", F.collect_list("_t").over(E.frame(n - 1)))
    dev = F.aggregate("_v", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("_m"))) / n
    return bars.withColumn("cci", F.when(F.col("_m").isNotNull(), F.try_divide(F.col("_t") - F.col("_m"), 0.015 * dev))).drop("_t", "_m", "_v")


def obv(bars: DataFrame) -> DataFrame:
    return bars.withColumn("_s", F.coalesce(F.signum(E.diff("close")), F.lit(0.0)) * F.col("volume")).withColumn("obv", E.cumulative("_s")).drop("_s")


def volume_price_trend(bars: DataFrame) -> DataFrame:
    return bars.withColumn("_v", F.coalesce(E.pct("close") * F.col("volume"), F.lit(0.0))).withColumn("vpt", E.cumulative("_v")).drop("_v")


def vwap(bars: DataFrame, n: int = 20) -> DataFrame:
    bars = bars.withColumn("_pv", F.col("close") * F.col("volume"))
    return bars.withColumn("vwap", F.try_divide(E.total("_pv", n), E.total("volume", n))).drop("_pv")


def roc(bars: DataFrame, lengths: tuple[int, ...] = (5, 10)) -> DataFrame:
    return bars.withColumns({f"roc_{n}": E.pct("close", n) for n in lengths})


def momentum(bars: DataFrame) -> DataFrame:
    """Summed differences over 5, 10, 20 bars, rates of change and their strength."""
    bars = bars.withColumn("_d", E.diff("close"))
    bars = bars.withColumns({f"momentum_{n}": E.total("_d", n) for n in (5, 10, 20)})
    return roc(bars).withColumn("momentum_strength", F.coalesce(F.try_divide(F.abs("momentum_10"), "close"), F.lit(0.0))).drop("_d")


def zscore(bars: DataFrame, column: str, n: int = 50, least_rows: int = 10, out: str = "z") -> DataFrame:
    return bars.withColumn(out, F.coalesce(F.try_divide(F.col(column) - E.mean(column, n, least_rows), E.std(column, n, least_rows)), F.lit(0.0)))


#: Indicator lengths by timeframe.
LENGTHS = {"1m": {"rsi": 7, "macd": (6, 12, 4), "bb": 10}, "5m": {"rsi": 10, "macd": (8, 17, 6), "bb": 15}, "15m": {"rsi": 14, "macd": (12, 26, 9), "bb": 20}, "1h": {"rsi": 14, "macd": (12, 26, 9), "bb": 20}}


def timeframe_set(bars: DataFrame, timeframe: str) -> DataFrame:
    """Momentum, trend, band, volume and volatility indicators with the lengths of a timeframe."""
    own = LENGTHS[timeframe]
    n = own["bb"]
    out = adx_wilder(cci(williams_r(stochastic(volume_price_trend(obv(atr(bollinger(macd(rsi(bars, own["rsi"]), *own["macd"]), n))))))))
    out = vwap(out, n)
    out = out.withColumns({"_r": E.pct("close"), "roc": E.pct("close", 10), "volume_sma": E.mean("volume", n), "volume_momentum": E.pct("volume", 5)})
    square = E.total(F.col("_r") * F.col("_r"), n)
    out = out.withColumns({"volatility": E.std("_r", n), "realized_volatility": F.sqrt(square), "volume_ratio": E.div("volume", "volume_sma")})
    return out.withColumn("volatility_ratio", E.div("volatility", E.mean("volatility", 2 * n))).drop("_r")


def timeframe_sets(bars: DataFrame, frames: dict[str, str], wanted: list[str], key: str = E.KEY) -> DataFrame:
    """The wanted indicators of several longer timeframes beside every base bar (suffix _<timeframe>), from closed bars only.

    frames: timeframe to its interval in SQL.
    """
    from tidewell.operators.align import higher_timeframe
    from tidewell.operators.bars import resample

    out = bars
    for name, interval in frames.items():
        own = timeframe_set(resample(bars, name), name if name in LENGTHS else "1h").select(key, "ts", *[F.col(c).alias(f"{c}_{name}") for c in wanted])
        out = higher_timeframe(out, own, [f"{c}_{name}" for c in wanted], interval, key)
    return out


def time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Calendar parts (Monday is 0), cyclic pairs and trading-session flags by hour."""
    h, d, m = F.hour(ts), F.weekday(ts), F.month(ts)
    angle = lambda x, n: 2 * 3.141592653589793 * x / n
    return df.withColumns({
        "hour": h, "day_of_week": d, "day_of_month": F.dayofmonth(ts), "month": m, "quarter": F.quarter(ts),
        "hour_sin": F.sin(angle(h, 24)), "hour_cos": F.cos(angle(h, 24)), "dow_sin": F.sin(angle(d, 7)), "dow_cos": F.cos(angle(d, 7)),
        "asia": ((h >= 0) & (h < 8)).cast("int"), "london": ((h >= 8) & (h < 16)).cast("int"), "new_york": ((h >= 13) & (h < 21)).cast("int"),
    })


def combined_features(bars: DataFrame) -> DataFrame:
    """Twelve columns for event windows: carried forward, then 0."""
    out = bars.withColumn("log_return", E.log_return("close")).withColumn("volatility_20", E.std("log_return", 20, 5))
    out = atr(bollinger(macd(rsi(out, 14, 14)), least_rows=20), 14, 14)
    out = out.withColumns({"volume_ratio": F.try_divide("volume", E.mean("volume", 20, 1)), "range_ratio": F.try_divide(F.col("high") - F.col("low"), "close"), "body_ratio": F.try_divide(F.col("close") - F.col("open"), "open")})
    names = ["log_return", "volatility_20", "rsi", "macd", "macd_signal", "macd_hist", "bb_position", "bb_width", "atr", "volume_ratio", "range_ratio", "body_ratio"]
    return out.withColumns({c: F.coalesce(E.ffill(c), F.lit(0.0)) for c in names}).select(*bars.columns, *names)
