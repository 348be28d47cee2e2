"""Risk and performance statistics as aggregates over returns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import expr as E

YEAR = math.sqrt(252)


def returns_summary(df: DataFrame, r: str = "r", key: str = E.KEY) -> DataFrame:
    """Sharpe, Sortino, 5 % value at risk, expected shortfall, profit factor, win rate and excess kurtosis."""
    q = df.groupBy(key).agg(F.percentile(r, 0.05).alias("_q"))
    x, v = df.join(q, key), F.col(r)
    down = F.stddev_samp(F.when(v < 0, v))
    return x.groupBy(key).agg(
        F.count(r).alias("n"), (F.try_divide(F.avg(r), F.stddev_samp(r)) * YEAR).alias("sharpe"), (F.try_divide(F.avg(r), down) * YEAR).alias("sortino"), F.abs(F.first("_q")).alias("var_95"), F.abs(F.avg(F.when(v <= F.col("_q"), v))).alias("cvar_95"),
        F.try_divide(F.sum(F.when(v > 0, v)), -F.sum(F.when(v < 0, v))).alias("profit_factor"), F.avg(F.when(v.isNotNull(), (v > 0).cast("int"))).alias("win_rate"),
    )


def equity(df: DataFrame, r: str = "r", key: str = E.KEY) -> DataFrame:
    """Compounded equity (returns above -1) and drawdown from its running maximum."""
    x = df.withColumn("equity", F.exp(F.sum(F.log1p(F.coalesce(r, F.lit(0.0)))).over(E.series(key).rowsBetween(Window.unboundedPreceding, 0))))
    return x.withColumn("drawdown", F.col("equity") / E.expanding_max("equity", key=key) - 1)


def max_drawdown(df: DataFrame, r: str = "r", key: str = E.KEY) -> DataFrame:
    return equity(df, r, key).groupBy(key).agg(F.min("drawdown").alias("max_drawdown"))


def gated_sharpe(df: DataFrame, gate: str, r: str = "r", key: str = E.KEY) -> DataFrame:
    """Sharpe of gated rows, of all rows, their difference and the share of gated rows."""
    own = F.when(F.col(gate) == 1, F.col(r))
    a, b = F.try_divide(F.avg(own), F.stddev_samp(own)) * YEAR, F.try_divide(F.avg(r), F.stddev_samp(r)) * YEAR
    return df.groupBy(key).agg(a.alias("gated_sharpe"), b.alias("sharpe"), (a - b).alias("lift"), F.avg((F.col(gate) == 1).cast("int")).alias("coverage"))


def kelly(df: DataFrame, r: str = "r", key: str = E.KEY, lookback: int = 60, confidence: float = 1.0, leverage: float = 1.0, most: float = 0.25) -> DataFrame:
    """1 and the Kelly fraction (mean over variance) of the last ``lookback`` returns, reduced for leverage beyond 10 and for doubt, within [0, most].

    1 where there are fewer returns or they don't vary.
    """
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts")))
    x = df.where(F.col(r).isNotNull()).withColumn("_n", back).where(F.col("_n") <= lookback)
    f = F.try_divide(F.avg(r), F.var_samp(r)) * min(1.0, 10.0 / max(1.0, leverage)) * (0.5 + 0.5 * confidence)
    got = x.groupBy(key).agg(F.when((F.count("*") >= lookback) & (F.var_samp(r) > 0), 1 + E.clip(f, 0, most)).alias("kelly"))
    return df.select(key).distinct().join(got, key, "left").select(key, F.coalesce("kelly", F.lit(1.0)).alias("kelly"))


def prediction_scores(df: DataFrame, confidence: str, prediction: str, label: str, least: float = 0.6, unit: float = 0.01, key: str = E.KEY) -> DataFrame:
    """Trades where confident, a unit won or lost by the label; totals and win rate."""
    traded = F.col(confidence) >= least
    won = F.col(prediction) == F.col(label)
    pnl = F.when(traded & won, unit).when(traded, -unit).otherwise(0.0)
    return df.groupBy(key).agg(F.sum(traded.cast("int")).alias("trades"), F.sum(pnl).alias("pnl"), F.avg(F.when(traded, won.cast("int"))).alias("win_rate"))


def activation_threshold(df: DataFrame, intensity: str, r: str = "r", label: str = "label", grid: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """For each threshold, of the rows at or above it: frequency, hit rate, profit factor and mean return (one aggregation for the whole grid).

    Wins are gains of rows of label 1, losses those of label -1; without losses the factor is the gain itself.
    """
    v, i, y = F.coalesce(F.col(r), F.lit(0.0)), F.col(intensity), F.col(label)

    def one(t: float):
        on = F.coalesce(i >= t, F.lit(False))
        gain = F.coalesce(F.sum(F.when(on & (y == 1) & (v > 0), v)), F.lit(0.0))
        loss = -F.coalesce(F.sum(F.when(on & (y == -1) & (v < 0), v)), F.lit(0.0))
        hit = F.avg(F.when(on, F.coalesce((y == 1).cast("int"), F.lit(0))))
        return F.struct(F.lit(t).alias("threshold"), F.avg(on.cast("int")).alias("frequency"), hit.alias("hit_rate"), F.when(loss > 0, gain / loss).otherwise(gain).alias("profit_factor"), F.avg(F.when(on, v)).alias("avg_return"))

    return df.agg(F.array(*[one(t) for t in grid]).alias("x")).select(F.explode("x").alias("x")).select("x.*").where("frequency > 0")


def best_threshold(df: DataFrame, intensity: str, r: str = "r", label: str = "label", least: float = 0.01, most: float = 0.5, fallback: float | None = 0.5, **kw) -> DataFrame:
    """The threshold of greatest profit factor whose frequency is within bounds (the lowest of equal ones), or the fallback (None: no row)."""
    x = activation_threshold(df, intensity, r, label, **kw).where(F.col("frequency").between(least, most))
    top = x.agg(F.max_by(F.struct(*x.columns), F.struct("profit_factor", -F.col("threshold"))).alias("x"))
    if fallback is None:
        return top.where(F.col("x").isNotNull()).select("x.*")
    rest = {c: F.coalesce(F.col(f"x.{c}"), F.lit(fallback if c == "threshold" else 0.0)).alias(c) for c in x.columns}
    return top.select(*rest.values())


def market_scores(bars: DataFrame, key: str = E.KEY, n: int = 20, long: int = 100) -> DataFrame:
    """Per series, at its last bar: strength and stress and liquidity (0 to 100), their parts, and the trend and volume states."""
    x = bars.withColumns({"_r": E.pct("close", key=key), "_top": E.high("close", n, key=key), "_mv": E.mean("volume", n, key=key), "_back": F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts")))})
    x = x.withColumns({"_sd": E.std("_r", n, key=key), "_sdl": E.std("_r", long, key=key)})
    last = lambda c: F.max(F.when(F.col("_back") == 1, F.col(c)))
    recent = F.col("_back") <= n
    first = F.max_by("close", F.when(recent, F.col("_back")))
    s = x.groupBy(key).agg(
        F.avg((F.col("_r") > 0).cast("int")).alias("_up"), F.avg(F.abs("_r")).alias("_move"), F.coalesce(F.try_divide(last("_sd"), last("_sdl")), F.lit(1.0)).alias("volatility_stress"),
        F.coalesce(F.abs(F.try_divide(last("close") - last("_top"), last("_top"))), F.lit(0.0)).alias("drawdown_stress"), F.try_divide(F.avg(F.when(recent, F.col("volume"))), F.avg("volume")).alias("_share"),
        F.avg(F.when(recent, E.div(F.col("high") - F.col("low"), "close"))).alias("spread"), last("_sd").alias("_sd"), E.div(last("volume"), last("_mv")).alias("_vr"), F.try_divide(last("volume"), F.avg("volume")).alias("_now"),
        F.try_divide(last("close") - first, first).alias("_trend"), F.sum(recent.cast("int")).alias("_rows"),
    )
    clip100 = lambda c: E.clip(c, 0, 100)
    s = s.withColumns({"volume_stress": E.clip(1 - F.coalesce("_share", F.lit(1.0)), 0, 1), "impact": F.coalesce(F.when(F.col("_vr") > 0, F.col("_sd") / F.col("_vr")).otherwise(F.col("_sd")), F.lit(0.0)), "spread": F.coalesce("spread", F.lit(0.0))})
    volume = F.when(F.coalesce("_share", F.lit(1.0)) > 1.2, 80).when(F.coalesce("_share", F.lit(1.0)) < 0.8, 30).otherwise(60)
    parts = lambda c: F.greatest(F.lit(0.0), 100 - 1000 * F.col(c))
    return s.select(
        key, clip100(F.coalesce("_up", F.lit(0.5)) * 60 + F.least(F.coalesce("_move", F.lit(0.0)) * 1000, F.lit(40.0))).alias("strength"),
        clip100(40 * F.col("volatility_stress") + 40 * F.col("drawdown_stress") + 20 * F.col("volume_stress")).alias("stress"), clip100((volume + parts("spread") + parts("impact")) / 3).alias("liquidity"),
        "volatility_stress", "drawdown_stress", "volume_stress",
        F.when(F.col("_rows") < 10, "UNKNOWN").when(F.col("_trend") > 0.02, "BULLISH").when(F.col("_trend") < -0.02, "BEARISH").otherwise("SIDEWAYS").alias("trend"),
        F.when(F.col("_now") > 1.5, "HIGH").when(F.col("_now") < 0.5, "LOW").otherwise("NORMAL").alias("volume_state"),
    )


#: The adverse risk that each leverage still bears.
LEVERAGE_RISK = {10: 0.1, 15: 0.08, 20: 0.07, 25: 0.06, 30: 0.05, 40: 0.04, 50: 0.035, 60: 0.03, 75: 0.025, 100: 0.02}


def liquidation_price(entry, leverage, long: bool = True):
    """Price at which the margin is exhausted."""
    return entry * (1 - 1 / leverage) if long else entry * (1 + 1 / leverage)


def liquidation_prices(df: DataFrame, price: str = "close", long: bool = True, leverages: tuple[int, ...] = tuple(LEVERAGE_RISK)) -> DataFrame:
    """Long: leverage, liquidation price and the relative distance to it."""
    v, l = F.col(price), F.col("leverage")
    x = df.withColumn("leverage", F.explode(F.array(*[F.lit(n) for n in leverages]))).withColumn("liquidation_price", liquidation_price(v, l, long))
    return x.withColumn("distance", F.abs(v - F.col("liquidation_price")) / v)


def safe_leverage(risk, multiplier: float = 0.8, least: int = 10, most: int = 100, levels: dict[int, float] = LEVERAGE_RISK):
    """The greatest leverage whose level bears the adverse risk (levels fall as leverage rises), times a safety factor, within bounds."""
    own = F.coalesce(*[F.when(risk <= bears, n) for n, bears in sorted(levels.items(), reverse=True)], F.lit(least))
    return F.greatest(F.lit(least), F.least((own * multiplier).cast("int"), F.lit(most)))


def risk_level(risk):
    """Name of an adverse risk."""
    return F.when(risk <= 0.05, "VERY_LOW").when(risk <= 0.1, "LOW").when(risk <= 0.2, "MODERATE").when(risk <= 0.3, "HIGH").otherwise("VERY_HIGH")


def volatility_percentile(df: DataFrame, r: str = "r", n: int = 20, key: str = E.KEY) -> DataFrame:
    """Per series, the share of its rows whose deviation of n returns is below the last one; one half with fewer than n returns."""
    x = df.where(F.col(r).isNotNull()).withColumn("_v", E.std(r, n, key=key))
    x = x.withColumn("_now", F.max_by("_v", "ts").over(Window.partitionBy(key)))
    below = F.avg(E.flag(F.col("_v") < F.col("_now")))
    return x.groupBy(key).agg(F.when(F.count("*") >= n, below).otherwise(0.5).alias("volatility_percentile"))


def expert_weights(df: DataFrame, keys: list[str], expert: str, most: int = 3, least: float = 0.15, alpha: float = 0.7, beta: float = 0.3) -> DataFrame:
    """Long (keys, expert, gate, weight): confidence times reliability times gate, over their sum within the keys.

    Of experts whose intensity is ``least`` or more the ``most`` strongest count (ties: by name); the gate mixes intensity and
    emergence, and is lowered by the exit hazard where the expert is the current one.  A column ``generalist`` adds a row of that
    name, lowered by the hazard always.  Without any weight all are 0.  Columns: intensity, emergence, confidence, reliability
    (1 if missing), current, exit_hazard (0 if missing).
    """
    own = Window.partitionBy(*keys)
    stay = F.greatest(1 - F.coalesce("exit_hazard", F.lit(0.0)), F.lit(0.0))
    strong = df.where(F.col("intensity") >= least).withColumn("_n", F.row_number().over(own.orderBy(F.desc("intensity"), expert))).where(F.col("_n") <= most)
    gate = E.clip(alpha * F.col("intensity") + beta * F.coalesce("emergence", F.lit(0.0)), 0, 1) * F.when(F.col("current"), stay).otherwise(1.0)
    positive = lambda x: F.greatest(x, F.lit(0.0))
    x = strong.select(*keys, F.col(expert).alias("expert"), gate.alias("gate"), (positive(F.coalesce("confidence", F.lit(0.0))) * positive(F.coalesce("reliability", F.lit(1.0))) * gate).alias("_w"))
    if "generalist" in df.columns:
        one = df.where("generalist is not null").groupBy(*keys).agg(F.max("generalist").alias("_g"), F.min(stay).alias("_s"))
        x = x.unionByName(one.select(*keys, F.lit("generalist").alias("expert"), F.col("_s").alias("gate"), (positive(F.col("_g")) * F.col("_s")).alias("_w")))
    return x.withColumn("weight", F.coalesce(F.try_divide(F.col("_w"), F.sum("_w").over(own)), F.lit(0.0))).drop("_w")


def prediction_curve(df: DataFrame, confidence: str, prediction: str, label: str, least: float = 0.6, unit: float = 0.01, key: str = E.KEY) -> DataFrame:
    """Trades where confident, in order: result and running total, and how far that is below its peak."""
    x = df.where(F.col(confidence) >= least).withColumn("pnl", F.when(F.col(prediction) == F.col(label), unit).otherwise(-unit))
    x = x.withColumn("cumulative", E.cumulative("pnl", key=key))
    return x.withColumn("drawdown", F.greatest(E.expanding_max("cumulative", key=key), F.lit(0.0)) - F.col("cumulative"))
