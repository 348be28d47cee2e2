"""Ticks to bars, bars to longer bars, dense spines and per-minute trade statistics.

Bars come from one grouped aggregation with map-side combining; first and last are minima and maxima
by (ts, trade_id), so ties are defined and no sort is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.expr import KEY, ffill

UNITS = {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week"}


def bucket(ts: str | Column, interval: str) -> Column:
    """Start of the bucket, e.g. of ``5m``, ``1h``, ``1d``; keeps TIMESTAMP_NTZ."""
    n, unit = int(interval[:-1]), UNITS[interval[-1].lower()]
    return F.window(ts, f"{n} {unit}")["start"]


def trades_to_bars(trades: DataFrame, interval: str, key: str | None = KEY) -> DataFrame:
    """open, high, low, close, volume, trades per bucket (and key); empty buckets are absent."""
    at = F.struct("ts", "trade_id")
    keys = [key] if key else []
    return trades.groupBy(*keys, bucket("ts", interval).alias("bar")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"), F.count("*").alias("trades"),
    ).withColumnRenamed("bar", "ts")


def resample(bars: DataFrame, interval: str, key: str | None = KEY, extra: dict[str, Column] | None = None) -> DataFrame:
    """Longer bars: first open, highest, lowest, last close, summed volume; other columns by ``extra`` (default mean)."""
    keys = [key] if key else []
    known = {"open": F.min_by("open", "ts"), "high": F.max("high"), "low": F.min("low"), "close": F.max_by("close", "ts"), "volume": F.sum("volume"), "trades": F.sum("trades")}
    rest = {c: F.avg(c) for c, t in bars.dtypes if c not in (*known, *keys, "ts") and t in ("double", "float", "int", "bigint")}
    aggs = [e.alias(c) for c, e in {**known, **rest, **(extra or {})}.items() if c in bars.columns or c in (extra or {})]
    return bars.groupBy(*keys, bucket("ts", interval).alias("bar")).agg(*aggs).withColumnRenamed("bar", "ts")


def spine(df: DataFrame, interval: str, key: str | None = KEY) -> DataFrame:
    """Every bucket start from the first to the last bar of each key."""
    n, unit = int(interval[:-1]), UNITS[interval[-1].lower()]
    keys = [key] if key else []
    ends = df.groupBy(*keys).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select(*keys, F.explode(F.sequence("a", "b", F.expr(f"interval {n} {unit}"))).alias("ts"))


def dense_bars(bars: DataFrame, interval: str, key: str | None = KEY) -> DataFrame:
    """Bars with empty buckets filled: prices carried forward, volume and trades 0."""
    keys = [key] if key else []
    out = spine(bars, interval, key).join(bars, [*keys, "ts"], "left")
    by = keys or [F.lit(1)]
    fill = {c: ffill(c, key=by) for c in ("open", "high", "low", "close") if c in bars.columns}
    zero = {c: F.coalesce(c, F.lit(0).cast(dict(bars.dtypes)[c])) for c in ("volume", "trades") if c in bars.columns}
    return out.withColumns({**fill, **zero})


def minute_stats(trades: DataFrame, key: str | None = KEY) -> DataFrame:
    """Per minute: summed quantity, count, mean, least and greatest price."""
    keys = [key] if key else []
    return trades.groupBy(*keys, bucket("ts", "1m").alias("bar")).agg(F.sum("quantity").alias("trade_volume"), F.count("*").alias("trade_count"), F.avg("price").alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price")).withColumnRenamed("bar", "ts")


def last_per_bucket(df: DataFrame, interval: str, column: str, key: str = KEY) -> DataFrame:
    return df.groupBy(key, bucket("ts", interval).alias("bar")).agg(F.max_by(column, "ts").alias(column)).withColumnRenamed("bar", "ts")
