"""Candlestick patterns: constants and rules over the current and the previous bars.

Rows whose 20-bar means aren't known yet are dropped first, as are those rows from the view of ``lag``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import expr as E

#: Thresholds of the patterns.
ENGULFING, SMALL_BODY, SHADOW, TWEEZER, MARUBOZU, DOJI = 1.1, 0.3, 2.0, 0.02, 0.1, 0.1
PATTERNS = ("bullish_engulfing", "bearish_engulfing", "hammer", "hanging_man", "shooting_star", "inverted_hammer", "tweezer_top", "tweezer_bottom", "bullish_marubozu", "bearish_marubozu", "rising_three_methods", "falling_three_methods", "doji", "spinning_top")
BULLISH = ("bullish_engulfing", "hammer", "inverted_hammer", "tweezer_bottom", "bullish_marubozu", "rising_three_methods")
BEARISH = ("bearish_engulfing", "hanging_man", "shooting_star", "tweezer_top", "bearish_marubozu", "falling_three_methods")


def prepare(bars: DataFrame) -> DataFrame:
    span = F.col("high") - F.col("low")
    body = F.abs(F.col("close") - F.col("open"))
    bars = bars.withColumns({"body": body, "upper": F.col("high") - F.greatest("open", "close"), "lower": F.least("open", "close") - F.col("low"), "span": span, "body_ratio": body / F.when(span == 0, 1.0).otherwise(span), "bullish": F.col("close") > F.col("open")})
    bars = bars.withColumns({"avg_body": E.mean("body", 20), "avg_span": E.mean("span", 20)})
    return bars.where("avg_body is not null and avg_span is not null")


def _three(up: bool):
    """Five candles: a long one, three small opposite ones within its range, and a long one beyond it."""
    at = lambda c, k: E.lag(c, k) if k else F.col(c)
    mean = sum((at("body", k) for k in range(5)), F.lit(0.0)) / 5
    same = lambda k: at("bullish", k) if up else ~at("bullish", k)
    rule = same(4) & (at("body", 4) > mean) & same(0) & (at("body", 0) > mean)
    rule &= (at("close", 0) > at("close", 4)) if up else (at("close", 0) < at("close", 4))
    for k in (3, 2, 1):
        rule &= ~same(k) & (at("high", k) <= at("high", 4)) & (at("low", k) >= at("low", 4))
    return rule


def patterns(bars: DataFrame) -> DataFrame:
    """All patterns as booleans."""
    x = prepare(bars)
    c, o, h, l, body, upper, lower, span, ratio, bull = (F.col(n) for n in ("close", "open", "high", "low", "body", "upper", "lower", "span", "body_ratio", "bullish"))
    c1, o1, h1, l1, body1, bull1 = (E.lag(n) for n in ("close", "open", "high", "low", "body", "bullish"))
    small_up = (ratio <= SMALL_BODY) & (lower > body * SHADOW) & (upper < body * 0.5)
    small_down = (ratio <= SMALL_BODY) & (upper > body * SHADOW) & (lower < body * 0.5)
    smooth = (upper < span * MARUBOZU) & (lower < span * MARUBOZU)
    rules = {
        "bullish_engulfing": bull & ~bull1 & (o < c1) & (c > o1) & (body > body1 * ENGULFING),
        "bearish_engulfing": ~bull & bull1 & (o > c1) & (c < o1) & (body > body1 * ENGULFING),
        "hammer": small_up, "hanging_man": small_up & (c1 > c), "shooting_star": small_down, "inverted_hammer": small_down & (c1 < c),
        "tweezer_top": (F.abs(h - h1) <= TWEEZER * h) & (h > c) & (h1 > c1), "tweezer_bottom": (F.abs(l - l1) <= TWEEZER * l) & (l < o) & (l1 < o1),
        "bullish_marubozu": smooth & bull, "bearish_marubozu": smooth & ~bull, "rising_three_methods": _three(True), "falling_three_methods": _three(False),
        "doji": ratio <= DOJI, "spinning_top": (ratio <= 0.3) & (F.abs(upper - lower) < 0.2 * span) & (upper > 0.1 * span) & (lower > 0.1 * span),
    }
    return x.withColumns({n: F.coalesce(r, F.lit(False)) for n, r in rules.items()})


def confidences(x: DataFrame) -> DataFrame:
    """Confidence of each kind of pattern, 0 where it is absent."""
    tiny = 1e-8
    body1, h1, l1 = E.lag("body"), E.lag("high"), E.lag("low")
    on = lambda p, v: F.when(F.col(p), v).otherwise(0.0)
    low_wick, high_wick = F.least(F.col("lower") / (F.col("body") + tiny), F.lit(3.0)), F.least(F.col("upper") / (F.col("body") + tiny), F.lit(3.0))
    engulf = F.least(F.col("body") / (body1 + tiny), F.lit(2.0))
    return x.withColumns({
        "bullish_engulfing_confidence": on("bullish_engulfing", engulf), "bearish_engulfing_confidence": on("bearish_engulfing", engulf), "hammer_confidence": on("hammer", low_wick), "hanging_man_confidence": on("hanging_man", low_wick), "shooting_star_confidence": on("shooting_star", high_wick),
        "inverted_hammer_confidence": on("inverted_hammer", high_wick), "tweezer_top_confidence": on("tweezer_top", 1 - F.abs(F.col("high") - h1) / (F.col("high") + tiny)), "tweezer_bottom_confidence": on("tweezer_bottom", 1 - F.abs(F.col("low") - l1) / (F.col("low") + tiny)),
        "marubozu_confidence": F.when(F.col("bullish_marubozu") | F.col("bearish_marubozu"), 1 - (F.col("upper") + F.col("lower")) / (F.col("span") + tiny)).otherwise(0.0), "doji_confidence": on("doji", 1 - F.col("body_ratio")),
    })


def counts(x: DataFrame, n: int = 20) -> DataFrame:
    """Rolling counts of each pattern, totals, density and the share of bullish ones."""
    num = lambda names: sum((F.col(p).cast("int") for p in names), F.lit(0))
    x = x.withColumns({"_all": num(PATTERNS), "_up": num(BULLISH), "_down": num(BEARISH)})
    x = x.withColumns({f"{p}_count": E.total(F.col(p).cast("int"), n, 1) for p in PATTERNS} | {"pattern_count": E.total("_all", n, 1), "bullish_count": E.total("_up", n, 1), "bearish_count": E.total("_down", n, 1)})
    return x.withColumns({"pattern_density": F.col("pattern_count") / n, "bullish_share": F.coalesce(F.try_divide("bullish_count", F.col("bullish_count") + F.col("bearish_count")), F.lit(0.0))}).drop("_all", "_up", "_down")
