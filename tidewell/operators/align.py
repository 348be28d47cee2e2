"""Time alignment: as-of joins, exact match with carry-forward, spines and nearest levels.

The as-of join is a union and one window per key: each side is shuffled once by the key and no pair is
ever formed.  A hot key can be cut into time chunks (``chunk``): each chunk is opened by the last right row
before it, so the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.expr import KEY, ffill


def asof_backward(left: DataFrame, right: DataFrame, values: list[str], key: str = KEY, ts: str = "ts", tolerance: str | None = None, chunk: str | None = None) -> DataFrame:
    """Each left row with the latest right row at or before it.

    tolerance: an interval beyond which a match is dropped; chunk: an interval by which series are cut.
    """
    l = left.withColumn("_side", F.lit(1)).withColumns({f"_r_{v}": F.lit(None).cast(dict(right.dtypes)[v]) for v in values} | {"_r_ts": F.lit(None).cast(dict(right.dtypes)[ts])})
    r = right.select(key, ts, F.lit(0).alias("_side"), *[F.col(v).alias(f"_r_{v}") for v in values], F.col(ts).alias("_r_ts"))
    keys = [key]
    if chunk:
        part = lambda c: F.window(c, chunk)["start"]
        l, r = l.withColumn("_chunk", part(F.col(ts))), r.withColumn("_chunk", part(F.col(ts)))
        lasts = r.groupBy(key, "_chunk").agg(F.max_by(F.struct(*[c for c in r.columns if c not in (key, "_chunk")]), ts).alias("x"))
        need = l.select(key, "_chunk").distinct()
        both = need.withColumn("x", F.lit(None).cast(lasts.schema["x"].dataType)).unionByName(lasts).groupBy(key, "_chunk").agg(F.first("x", True).alias("x"))
        before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
        openers = both.select(key, "_chunk", F.last("x", True).over(before).alias("o")).where("o is not null").select(key, "_chunk", "o.*")
        r = r.unionByName(openers)
        keys.append("_chunk")
    w = Window.partitionBy(*keys).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    joined = l.unionByName(r, allowMissingColumns=True)
    # values travel together, so a NULL value of the latest row stays NULL
    latest = F.last(F.when(F.col("_side") == 0, F.struct("_r_ts", *[f"_r_{v}" for v in values])), True).over(w)
    joined = joined.withColumn("_m", latest).where("_side = 1")
    ok = F.lit(True) if tolerance is None else F.col(f"_m._r_ts") + F.expr(f"interval {tolerance}") >= F.col(ts)
    return joined.select(*left.columns, *[F.when(ok, F.col(f"_m._r_{v}")).alias(v) for v in values])


def map_ffill(left: DataFrame, right: DataFrame, value: str, key: str = KEY, within_day: bool = False) -> DataFrame:
    """Exact match on key and ts, then carried forward (within the day, if wanted); off-grid right rows are lost."""
    out = left.join(right.select(key, "ts", value), [key, "ts"], "left")
    keys = [key, "_day"] if within_day else [key]
    out = out.withColumn("_day", F.to_date("ts")) if within_day else out
    return out.withColumn(value, ffill(value, key=keys)).drop("_day")


def point_in_time(df: DataFrame, at, key: str = KEY) -> DataFrame:
    """The last row at or before a moment, per key."""
    cols = [c for c in df.columns if c != key]
    return df.where(F.col("ts") <= at).groupBy(key).agg(F.max_by(F.struct(*cols), "ts").alias("x")).select(key, "x.*")


def reindex(grid: DataFrame, values: DataFrame, fills: dict[str, object], key: str = KEY) -> DataFrame:
    """Values on a grid of key and ts; where missing, the fill."""
    out = grid.join(values.select(key, "ts", *fills), [key, "ts"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fills.items()})


def higher_timeframe(base: DataFrame, coarse: DataFrame, values: list[str], interval: str, key: str = KEY, causal: bool = True) -> DataFrame:
    """Coarse columns on base rows; causal: a coarse bar is known only when it has ended."""
    if causal:
        coarse = coarse.withColumn("ts", F.col("ts") + F.expr(f"interval {interval}"))
    return asof_backward(base, coarse, values, key)


def nearest_level(df: DataFrame, levels: list[float], column: str = "close") -> F.Column:
    """Least relative distance to any of a few literal levels."""
    near = F.array_min(F.array(*[F.abs(F.col(column) - F.lit(float(x))) for x in levels]))
    return F.try_divide(near, F.col(column))


def with_weights(df: DataFrame, weights: DataFrame, keys: list[str], column: str = "sample_weight", default: float = 1.0) -> DataFrame:
    """Left join of one column, with a value for rows that have none."""
    own = weights.select(*keys, F.col(column).alias("_w"))
    return df.join(own, keys, "left").withColumn(column, F.coalesce("_w", F.lit(default))).drop("_w")


def index_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on the index; what the right side lacks is 0 in its numeric columns."""
    own = [c for c in right.columns if c not in keys]
    return left.join(right, keys, "left").na.fill(0, own)


def on_common_index(frames: list[DataFrame], keys: list[str]) -> list[DataFrame]:
    """Each frame with the index values that all of them have."""
    common = frames[0].select(*keys)
    for f in frames[1:]:
        common = common.intersect(f.select(*keys))
    return [f.join(common, keys, "left_semi") for f in frames]


def outer_features(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of the outputs of several generators; their columns are prefixed by the generator's name."""
    out = None
    for name, f in parts.items():
        own = f.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in f.columns if c not in keys])
        out = own if out is None else out.join(own, keys, "full")
    return out
