"""Setups told from single bars: rules over momentum, bands, ranges and volume, as columns, and their values at the last bar.

A rule that meets a missing value doesn't hold.  Everything is a window over the rows before, so no rule looks ahead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import expr as E
from tidewell.operators import indicators as I


@dataclass(frozen=True)
class Limits:
    """Thresholds and look-backs of the rules."""

    volatility: float = 0.02
    momentum: float = 0.01
    volume: float = 1.5
    edge_low: float = 0.2
    edge_high: float = 0.8
    mid_low: float = 0.3
    mid_high: float = 0.7
    compression_width: float = 0.05
    triangle_width: float = 0.03
    trend_momentum: float = 0.02
    breakout_momentum: float = 0.01
    failed_momentum: float = 0.005
    overbought: float = 70.0
    oversold: float = 30.0
    ignition_high: float = 60.0
    ignition_low: float = 40.0
    stop_hunt_volume: float = 2.0
    ignition_volume: float = 3.0
    breakout_rows: int = 20
    stop_hunt_rows: int = 15
    narrow: float = 0.02
    progress: float = 0.001
    histogram: float = 0.001
    compression_ratio: float = 0.8
    expansion_ratio: float = 1.5


SETUPS = (
    "strong_trend_continuation", "exhaustion_reversal", "range_mean_reversion", "breakout_success", "breakout_failure", "volatility_compression", "volatility_expansion",
    "flag_formation", "triangle_formation", "rectangle_formation", "momentum_ignition", "passive_absorption_bid", "passive_absorption_ask",
    "stop_hunt_below_low", "stop_hunt_above_high", "ignition_bar", "micro_momentum_divergence",
)
CONFIDENCES = ("strong_trend_confidence", "exhaustion_confidence", "range_reversion_confidence", "breakout_confidence", "volatility_confidence")


def setup_features(bars: DataFrame) -> DataFrame:
    """What the rules read: momentum_5 and _10, rsi, bb_position, bb_width (of returns), volume_ratio, volatility_10 and _20 and their ratio, price_position, macd_hist.

    With fewer than ten returns the volatilities are 0, their ratio 1 and the width 0.1; with fewer than twenty the width is 0.
    """
    x = I.macd(I.rsi(bars, 14, 14, "strong"), adjust=True)
    x = I.bollinger(x, 20, 2.0, 20).withColumn("_r", E.pct("close"))
    flat = F.col("bb_upper") == F.col("bb_lower")
    top, bottom = F.coalesce(E.high("high", 20), F.col("high")), F.coalesce(E.low("low", 20), F.col("low"))
    x = x.withColumns({
        "momentum_5": E.pct("close", 5), "momentum_10": E.pct("close", 10), "rsi": F.coalesce("rsi", F.lit(100.0)), "bb_position": F.when(flat, 0.5).otherwise(F.col("bb_position")),
        "volume_ratio": F.coalesce(E.div("volume", E.mean("volume", 20)), F.lit(1.0)), "volatility_10": F.coalesce(E.std("_r", 10), F.lit(0.0)), "volatility_20": F.coalesce(E.std("_r", 20, 10), F.lit(0.0)),
        "_m": E.mean("_r", 20), "_s": E.std("_r", 20), "_n": F.count("_r").over(E.frame(19)), "price_position": F.coalesce(E.div(F.col("close") - bottom, top - bottom), F.lit(0.5)),
    })
    width = F.when(F.col("_n") < 10, 0.1).when(F.col("_m") > 0, 4 * F.col("_s") / F.col("_m")).otherwise(0.0)
    ratio = F.when(F.col("volatility_20") > 0, F.col("volatility_10") / F.col("volatility_20")).otherwise(1.0)
    return x.withColumns({"bb_width": width, "volatility_ratio": ratio}).drop("_r", "_m", "_s", "_n", "bb_upper", "bb_lower", "bb_z", "macd", "macd_signal")


def _inside(x: Column, lo: float, hi: float) -> Column:
    return (x > lo) & (x < hi)


def setups(features: DataFrame, limits: Limits | None = None) -> DataFrame:
    """SETUPS (0 or 1) and CONFIDENCES of every bar, from the columns of ``setup_features`` and the bars themselves."""
    c, at = F.col, limits or Limits()
    short = I.rsi(features, 5, 1, "neutral", out="_rsi")
    x = short.withColumns({
        "_top": F.max("high").over(E.frame(at.breakout_rows, -1)), "_bottom": F.min("low").over(E.frame(at.breakout_rows, -1)),
        "_hunt_top": F.max("high").over(E.frame(at.stop_hunt_rows, -1)), "_hunt_bottom": F.min("low").over(E.frame(at.stop_hunt_rows, -1)),
        "_progress": F.abs(E.pct("close", 4)), "_range": c("high") - c("low"), "_wide": E.high("high", 10) - E.low("low", 10),
        "_before": F.when(F.count("high").over(E.frame(9, -1)) == 9, F.max("high").over(E.frame(9, -1))), "_rsi_before": F.when(F.count("_rsi").over(E.frame(10, -1)) >= 2, F.max("_rsi").over(E.frame(10, -1))),
    }).withColumn("_mean_range", E.mean("_range", 20))
    five, ten, band, width, volume = c("momentum_5"), c("momentum_10"), c("bb_position"), c("bb_width"), c("volume_ratio")
    edge = (band < at.edge_low) | (band > at.edge_high)
    busy = volume > at.volume
    up, down = (c("close") > c("_top")) & (five > at.breakout_momentum), (c("close") < c("_bottom")) & (five < -at.breakout_momentum)
    stuck = busy & (c("_progress") < at.progress)
    hunted = volume > at.stop_hunt_volume
    rules = {
        "strong_trend_continuation": (ten > at.trend_momentum) & _inside(band, at.mid_low, at.mid_high) & _inside(c("rsi"), at.oversold + 10, at.overbought),
        "exhaustion_reversal": ((c("rsi") > at.overbought) | (band > at.edge_high)) & (five < 0) & busy,
        "range_mean_reversion": edge & (c("volatility_20") < at.volatility) & (F.abs(ten) < at.momentum),
        "breakout_success": (up | down) & busy,
        "breakout_failure": edge & (F.abs(five) < at.failed_momentum),
        "volatility_compression": (width < at.compression_width) & (c("volatility_ratio") < at.compression_ratio),
        "volatility_expansion": (c("volatility_ratio") > at.expansion_ratio) & busy,
        "flag_formation": (F.abs(five) > at.trend_momentum) & (c("volatility_10") < at.volatility),
        "triangle_formation": width < at.triangle_width,
        "rectangle_formation": _inside(c("price_position"), at.mid_low, at.mid_high) & (width < at.compression_width),
        "momentum_ignition": ((c("rsi") > at.ignition_high) | (c("rsi") < at.ignition_low)) & (F.abs("macd_hist") > at.histogram) & (F.abs(five) > at.momentum),
        "passive_absorption_bid": stuck & (five > 0),
        "passive_absorption_ask": stuck & (five < 0),
        "stop_hunt_below_low": (c("low") < c("_hunt_bottom")) & (c("close") > c("_hunt_bottom")) & hunted,
        "stop_hunt_above_high": (c("high") > c("_hunt_top")) & (c("close") < c("_hunt_top")) & hunted,
        "ignition_bar": (volume > at.ignition_volume) & (c("_range") > 2 * c("_mean_range")) & (E.div("_wide", "close") < at.narrow),
        "micro_momentum_divergence": (c("high") > c("_before")) & (c("_rsi") < c("_rsi_before")),
    }
    x = x.withColumns({k: E.flag(v) for k, v in rules.items()})
    where = lambda name, v: F.when(c(name) == 1, F.least(v, F.lit(1.0))).otherwise(0.0)
    sure = {
        "strong_trend_confidence": where("strong_trend_continuation", 10 * F.abs(ten)), "exhaustion_confidence": where("exhaustion_reversal", (c("rsi") - 70) / 30),
        "range_reversion_confidence": where("range_mean_reversion", 2 * F.abs(band - 0.5)), "breakout_confidence": where("breakout_success", volume / 2), "volatility_confidence": F.least(c("volatility_ratio"), F.lit(1.0)),
    }
    return x.withColumns(sure).select(*features.columns, *SETUPS, *CONFIDENCES)


def at_last_bar(df: DataFrame, columns: list[str], key: str = E.KEY, order: str = E.ORDER) -> DataFrame:
    """One row per series: the columns at its last row, by one aggregation."""
    return df.groupBy(key).agg(F.max_by(F.struct(order, *columns), order).alias("_x")).select(key, "_x.*")
