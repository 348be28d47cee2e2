"""Volume profiles, levels, pivots and their clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import expr as E


def volume_profile(bars: DataFrame, bins: int = 100, key: str = E.KEY) -> DataFrame:
    """Volume by equal-width bins (right-closed, the lowest includes its edge) of the mid price."""
    x = bars.withColumn("_m", (F.col("high") + F.col("low")) / 2)
    ends = x.groupBy(key).agg(F.min("_m").alias("_lo"), F.max("_m").alias("_hi"))
    x = x.join(ends, key)
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.greatest(F.coalesce(F.ceil(F.try_divide(F.col("_m") - F.col("_lo"), width)) - 1, F.lit(0)), F.lit(0))
    x = x.withColumns({"bin": F.least(b, F.lit(bins - 1)).cast("int"), "_w": width})
    return x.groupBy(key, "bin").agg(F.sum("volume").alias("volume"), F.first(F.col("_lo")).alias("_lo"), F.first("_w").alias("_w")).select(key, "bin", (F.col("_lo") + (F.col("bin") + 0.5) * F.col("_w")).alias("mid"), "volume")


def point_of_control(profile: DataFrame, key: str = E.KEY) -> DataFrame:
    """The bin of greatest volume; of equal ones the lowest."""
    return profile.groupBy(key).agg(F.max_by(F.struct("bin", "mid", "volume"), F.struct("volume", -F.col("bin"))).alias("x")).select(key, "x.*")


def high_volume_nodes(profile: DataFrame, share: float = 0.7, reach: int = 1, key: str = E.KEY) -> DataFrame:
    """Bins at or above the given quantile of volume that are no less than their neighbours within reach."""
    w = Window.partitionBy(key).orderBy("bin").rowsBetween(-reach, reach)
    q = profile.groupBy(key).agg(F.percentile("volume", share).alias("_q"))
    x = profile.withColumn("_top", F.max("volume").over(w)).join(q, key)
    return x.where((F.col("volume") == F.col("_top")) & (F.col("volume") >= F.col("_q"))).drop("_top", "_q")


def fractal_pivots(bars: DataFrame, reach: int = 2, key: str = E.KEY) -> DataFrame:
    """Bars whose high (low) is the extreme of the full centred window."""
    w = E.frame(reach, reach, key=key)
    full = F.count("*").over(w) == 2 * reach + 1
    return bars.withColumns({"pivot_high": full & (F.col("high") == F.max("high").over(w)), "pivot_low": full & (F.col("low") == F.min("low").over(w))})


def pivot_levels(bars: DataFrame, n: int = 24, key: str = E.KEY) -> DataFrame:
    """Classic pivot, S1, S2, R1, R2 of the n bars before, and how often the close touched R1 and S1 within half a percent."""
    w = E.frame(n, -1, key=key)
    x = bars.withColumns({"_h": F.max("high").over(w), "_l": F.min("low").over(w), "_c": F.last("close").over(w), "_v": F.collect_list("close").over(w)})
    x = x.withColumn("pivot", (F.col("_h") + F.col("_l") + F.col("_c")) / 3)
    x = x.withColumns({"r1": 2 * F.col("pivot") - F.col("_l"), "s1": 2 * F.col("pivot") - F.col("_h"), "r2": F.col("pivot") + F.col("_h") - F.col("_l"), "s2": F.col("pivot") - F.col("_h") + F.col("_l")})
    touches = lambda level: F.size(F.filter("_v", lambda v: F.abs(v - F.col(level)) <= 0.005 * F.abs(F.col(level))))
    return x.withColumns({"r1_touches": touches("r1"), "s1_touches": touches("s1")}).drop("_h", "_l", "_c", "_v")


def tail_levels(bars: DataFrame, n: int = 2000, key: str = E.KEY) -> DataFrame:
    """Support (5, 15, 30 %) and resistance (70, 85, 95 %) quantiles of the last n lows and highs."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts")))
    x = bars.withColumn("_n", back).where(F.col("_n") <= n)
    return x.groupBy(key).agg(F.percentile("low", [0.05, 0.15, 0.30]).alias("support"), F.percentile("high", [0.70, 0.85, 0.95]).alias("resistance"))


def sr_distance(bars: DataFrame, levels: DataFrame, scale: float = 0.01, near: float = 0.02, key: str = E.KEY) -> DataFrame:
    """Relative distance to the nearest support and resistance, proximity score and flag."""
    x = bars.join(levels, key)
    d = lambda a: F.try_divide(F.array_min(F.transform(a, lambda v: F.abs(v - F.col("close")))), F.col("close"))
    x = x.withColumns({"support_distance": d("support"), "resistance_distance": d("resistance")})
    x = x.withColumn("sr_distance", F.least("support_distance", "resistance_distance"))
    return x.withColumns({"sr_proximity": F.exp(-F.col("sr_distance") / scale), "sr_nearby": (F.col("sr_distance") <= near).cast("int")}).drop("support", "resistance")


def volume_levels(bars: DataFrame, k: int = 2, key: str = E.KEY, least_rows: int = 20) -> DataFrame:
    """The k price bins of greatest volume: price, age, touches, and strengths of each.

    Bins are a quarter of the mean true range wide, from the lowest low, and end below the highest high.  A touch is a bar whose
    high (low) reaches the level from below (above) its predecessor's; age counts bars since the close first lay in the bin.
    Strength is .5 of the share of all volume, .3 of touches (10 are full) and .2 of age (the whole series is full).
    """
    from tidewell.operators.indicators import true_range

    w = Window.partitionBy(key).orderBy("ts")
    x = bars.withColumns({"_t": true_range(), "_i": F.row_number().over(w) - 1, "_ph": F.lag("high").over(w), "_pl": F.lag("low").over(w)})
    s = x.groupBy(key).agg(F.greatest(0.25 * F.avg("_t"), F.lit(1e-6)).alias("_w"), F.min("low").alias("_lo"), F.max("high").alias("_hi"), F.count("*").alias("_n"), F.sum("volume").alias("_v"))
    x = x.join(s.where(F.col("_n") >= least_rows), key)
    binned = x.withColumn("bin", F.floor((F.col("close") - F.col("_lo")) / F.col("_w"))).where(F.col("bin") < F.ceil((F.col("_hi") - F.col("_lo")) / F.col("_w")) - 1)
    p = binned.groupBy(key, "bin").agg(F.sum("volume").alias("volume"), *[F.first(c).alias(c) for c in ("_w", "_lo")])
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("volume"), "bin"))).where(F.col("rank") <= k)
    p = p.select(key, "rank", "volume", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("_a"), F.col("_w").alias("_width"))
    level = F.col("_a") + F.col("_width") / 2
    hit = ((F.col("high") >= level) & (F.col("_ph") < level)) | ((F.col("low") <= level) & (F.col("_pl") > level))
    inside = F.col("close").between(F.col("_a"), F.col("_a") + F.col("_width"))
    y = x.drop("volume").join(p, key).groupBy(key, "rank").agg(
        F.first(level).alias("price"), F.first("volume").alias("volume"), (F.first("_n") - F.min(F.when(inside, F.col("_i")))).alias("age"),
        F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("touches"), F.first("_v").alias("_v"), F.first("_n").alias("_n"),
    )
    y = y.withColumns({"volume_strength": F.coalesce(F.least(F.try_divide("volume", "_v"), F.lit(1.0)), F.lit(0.0)), "touch_strength": F.least(F.col("touches") / 10.0, F.lit(1.0)), "age_strength": F.least(F.col("age") / F.col("_n"), F.lit(1.0))})
    return y.withColumn("strength", 0.5 * F.col("volume_strength") + 0.3 * F.col("touch_strength") + 0.2 * F.col("age_strength")).drop("_v", "_n")


def pivot_strengths(bars: DataFrame, n: int = 24, key: str = E.KEY) -> DataFrame:
    """Classic levels of the n bars before, long: level, price, touches, volume near it, age and strength.

    Near is a tenth of the closes' deviation; touches leave out the first bar; strength is .3 of touches (5 are full), .4 of the
    share of volume and .3 of age.  Levels at or below 0 have none.
    """
    w = E.frame(n, -1, key=key)
    rows = F.collect_list(F.struct("close", "volume")).over(w)
    x = bars.withColumns({"_h": F.max("high").over(w), "_l": F.min("low").over(w), "_c": F.last("close").over(w), "_tol": 0.1 * F.stddev_samp("close").over(w), "_rows": rows})
    x = x.where(F.size("_rows") == n).withColumn("_p", (F.col("_h") + F.col("_l") + F.col("_c")) / 3)
    p, h, l = F.col("_p"), F.col("_h"), F.col("_l")
    levels = {"s1": 2 * p - h, "s2": p - (h - l), "r1": 2 * p - l, "r2": p + (h - l)}
    x = x.select(key, "ts", "_rows", "_tol", F.explode(F.array(*[F.struct(F.lit(name).alias("level"), price.alias("price")) for name, price in levels.items()])).alias("v")).select(key, "ts", "_rows", "_tol", "v.*")
    near = F.filter(F.transform("_rows", lambda r, i: F.struct(i.alias("i"), r["volume"].alias("volume"), (F.abs(r["close"] - F.col("price")) <= F.col("_tol")).alias("near"))), lambda r: r["near"])
    total = F.aggregate("_rows", F.lit(0.0), lambda s, r: s + r["volume"])
    x = x.withColumns({"_near": near, "_all": total})
    x = x.withColumns({"touches": F.size(F.filter("_near", lambda r: r["i"] > 0)), "volume": F.aggregate("_near", F.lit(0.0), lambda s, r: s + r["volume"]), "age": F.coalesce(n - F.get("_near", 0)["i"], F.lit(0))})
    strength = 0.3 * F.least(F.col("touches") / 5.0, F.lit(1.0)) + 0.4 * F.least(F.coalesce(F.try_divide("volume", "_all"), F.lit(0.0)), F.lit(1.0)) + 0.3 * F.col("age") / n
    x = x.withColumn("strength", F.when(F.col("price") > 0, strength).otherwise(0.0))
    own = {c: F.when(F.col("price") > 0, F.col(c)).otherwise(0) for c in ("touches", "volume", "age")}
    return x.withColumns(own).select(key, "ts", "level", "price", "touches", "volume", "age", "strength")


def vwap_levels(bars: DataFrame, n: int = 20, share: float = 0.8, key: str = E.KEY) -> DataFrame:
    """Rolling VWAP at bars whose volume is above the given quantile."""
    from tidewell.operators.indicators import vwap

    q = bars.groupBy(key).agg(F.percentile("volume", share).alias("_q"))
    return vwap(bars, n).join(q, key).where(F.col("volume") > F.col("_q")).drop("_q")


def round_levels(df: DataFrame, price: str = "close", reach: float = 0.1, powers: int = 9) -> DataFrame:
    """Long (level, strength): for each power of ten below the price the multiples just below and above it, within reach.

    Strength falls from 1 by five times the relative distance.
    """
    v = F.col(price)
    one = lambda base, up: F.floor(v / base) * base + (base if up else 0)
    cells = [F.when(F.length(F.floor(v).cast("long").cast("string")) > i, F.struct(F.lit(i).alias("power"), F.lit(up).alias("above"), one(10.0**i, up).alias("level"))) for i in range(1, powers + 1) for up in (False, True)]
    x = df.withColumn("_x", F.explode(F.array_compact(F.array(*cells)))).select(*df.columns, "_x.*")
    d = F.abs(v - F.col("level")) / v
    return x.where(d < reach).withColumn("strength", 1 - 5 * d)


def cluster_prices(prices: DataFrame, gap: float = 0.005, least: int = 2, key: str = E.KEY) -> DataFrame:
    """Clusters of sorted prices cut where the relative gap to the price before exceeds ``gap``; mean and touches."""
    w = Window.partitionBy(key).orderBy("price")
    cut = F.coalesce((F.try_divide(F.col("price") - F.lag("price").over(w), F.lag("price").over(w)) > gap).cast("int"), F.lit(0))
    x = prices.withColumn("_c", cut).withColumn("cluster", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key, "cluster").agg(F.avg("price").alias("level"), F.count("*").alias("touches")).where(F.col("touches") >= least)


PROFILE = ("poc_distance", "is_hvn", "is_lvn", "area_position", "area_width", "bin_share", "skewness", "kurtosis")


def _linear(sorted_: F.Column, q: float, n: int) -> F.Column:
    """Quantile of n sorted values by linear interpolation."""
    at = q * (n - 1)
    low = int(at)
    a, b = F.get(sorted_, low), F.get(sorted_, min(low + 1, n - 1))
    return a + (b - a) * (at - low)


def value_area(hist: F.Column, top: F.Column, total: F.Column, bins: int, share: float = 0.7) -> F.Column:
    """(sum, low, high): the bins around the one of greatest volume that hold ``share`` of it.

    The area is contiguous, so a bin can join only after all between it and the top have: its turn is set by the least volume on
    that way, greatest first, the upper side first among equals.
    """
    way = lambda b: F.array_min(F.when(b < top, F.slice(hist, b + 1, top - b)).otherwise(F.slice(hist, top + 2, b - top)))
    turns = F.filter(F.array(*[F.lit(i) for i in range(bins)]), lambda b: b != top)
    turns = F.array_sort(F.transform(turns, lambda b: F.struct((-way(b)).alias("way"), (b < top).alias("lower"), F.abs(b - top).alias("distance"), b.alias("bin"))))
    start = F.struct(F.get(hist, top).alias("sum"), top.alias("low"), top.alias("high"))

    def join(a, x):
        more = F.struct((a["sum"] + F.get(hist, x["bin"])).alias("sum"), F.least(a["low"], x["bin"]).alias("low"), F.greatest(a["high"], x["bin"]).alias("high"))
        return F.when(a["sum"] < share * total, more).otherwise(a)

    return F.aggregate(turns, start, join)


def rolling_profile(bars: DataFrame, n: int = 50, stride: int = 5, bins: int = 20, key: str = E.KEY) -> DataFrame:
    """Volume profile of the last n closes at every ``stride``-th row, carried forward; columns ``profile_`` and one of PROFILE.

    A bar goes to the windows that hold it, and a window's histogram is one grouped aggregation, so no window is collected.
    """
    w = E.frame(n - 1, 0, key=key)
    x = bars.withColumns({"_i": F.row_number().over(E.series(key)) - 1, "_lo": F.min("close").over(w), "_hi": F.max("close").over(w)})
    flat = F.col("_lo") == F.col("_hi")
    x = x.withColumns({"_lo": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")), "_hi": F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))})
    ends = x.where((F.col("_i") >= n - 1) & ((F.col("_i") - (n - 1)) % stride == 0)).select(key, F.col("_i").alias("_e"), "_lo", "_hi", F.col("close").alias("_now"))
    first = (n - 1) + stride * F.greatest(F.ceil((F.col("_i") - (n - 1)) / stride), F.lit(0))
    parts = x.select(key, "close", F.coalesce("volume", F.lit(0.0)).alias("volume"), F.explode(F.when(first <= F.col("_i") + n - 1, F.sequence(first, F.col("_i").cast("long") + n - 1, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))).alias("_e"))
    y = parts.join(ends, [key, "_e"])
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_of = lambda c: F.least(F.floor((F.col(c) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    y = y.withColumn("_b", bin_of("close")).groupBy(key, "_e", "_lo", "_hi", "_now").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("_b") == b, F.col("volume"))), F.lit(0.0)) for b in range(bins)]).alias("_h"))
    y = y.withColumn("_total", F.aggregate("_h", F.lit(0.0), lambda s, v: s + v)).where("_total > 0")
    h, total, lo = F.col("_h"), F.col("_total"), F.col("_lo")
    y = y.withColumns({"_k": (F.array_position(h, F.array_max(h)) - 1).cast("int"), "_s": F.array_sort(h), "_b": bin_of("_now")})
    y = y.withColumn("_area", value_area(h, F.col("_k"), total, bins))
    price = F.when(F.abs("_now") > 1e-12, F.col("_now")).otherwise(F.lit(1.0))
    mid = lambda i: lo + (i + 0.5) * width
    moment = lambda m, p: F.aggregate(F.transform(h, lambda v, i: v / total * F.pow(mid(i) - m, F.lit(float(p)))), F.lit(0.0), lambda s, v: s + v)
    y = y.withColumn("_mean", F.aggregate(F.transform(h, lambda v, i: v / total * mid(i)), F.lit(0.0), lambda s, v: s + v))
    y = y.withColumns({f"_m{p}": moment(F.col("_mean"), p) for p in (2, 3, 4)})
    here, spread = F.get(h, F.col("_b")), (F.col("_area.high") + 1 - F.col("_area.low")) * width
    spreads = F.col("_m2") > 1e-12
    out = {
        "poc_distance": F.abs(F.col("_now") - mid(F.col("_k"))) / price, "is_hvn": (here >= _linear(F.col("_s"), 0.8, bins)).cast("double"), "is_lvn": (here <= _linear(F.col("_s"), 0.2, bins)).cast("double"),
        "area_position": E.clip((F.col("_now") - lo - F.col("_area.low") * width) / spread, 0, 1), "area_width": spread / price, "bin_share": here / total,
        "skewness": F.when(spreads, F.col("_m3") / F.pow("_m2", F.lit(1.5))).otherwise(0.0), "kurtosis": F.when(spreads, F.col("_m4") / F.pow("_m2", F.lit(2.0))).otherwise(3.0),
    }
    got = y.select(key, F.col("_e").alias("_i"), *[v.alias(f"profile_{c}") for c, v in out.items()])
    x = x.drop("_lo", "_hi").join(got, [key, "_i"], "left")
    x = x.withColumns({f"profile_{c}": E.ffill(f"profile_{c}", key=key) for c in PROFILE})
    return x.withColumns({f"profile_{c}": F.coalesce(f"profile_{c}", F.lit(0.0)) for c in ("is_hvn", "is_lvn")}).drop("_i")


def pocket_risk(profiled: DataFrame, n: int = 5, key: str = E.KEY) -> DataFrame:
    """1 where one of the last n bars lay in a bin of little volume."""
    return profiled.withColumn("liquidity_pocket_risk", F.coalesce(E.high("profile_is_lvn", n, 1, key=key), F.lit(0.0)))


def haar(bars: DataFrame, column: str = "close", levels: int = 3, key: str = E.KEY) -> DataFrame:
    """Causal Haar details of each level: half the difference of the means of the last and the one before last 2**(l-1) bars, scaled, and their energy over 20 bars."""
    out = {}
    for l in range(1, levels + 1):
        n = 2 ** (l - 1)
        recent, before = F.sum(column).over(E.frame(n - 1, 0, key=key)), F.sum(column).over(E.frame(2 * n - 1, -n, key=key))
        full = F.count(column).over(E.frame(2 * n - 1, 0, key=key)) == 2 * n
        out[f"haar_{l}"] = F.when(full, (recent - before) / 2 ** (l / 2))
    x = bars.withColumns(out)
    return x.withColumns({f"haar_energy_{l}": E.mean(F.col(f"haar_{l}") * F.col(f"haar_{l}"), 20, 1, key=key) for l in range(1, levels + 1)})
