"""Forward-looking labels: barriers, directions, quantile and explicit meta-labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import expr as E
from tidewell.functions.ewm import Ewm, ewm
from tidewell.operators.align import higher_timeframe
from tidewell.operators.bars import resample
from tidewell.operators.indicators import bollinger, rsi, true_range


def triple_barrier(bars: DataFrame, profit: float = 0.002, loss: float = 0.001, horizon: int = 100, minutes: int | None = 30, key: str = E.KEY) -> DataFrame:
    """1 if the profit barrier is hit first (ties too), -1 the loss barrier, 0 neither within the horizon and minutes."""
    ahead = F.collect_list(F.struct("ts", "high", "low")).over(E.frame(-1, horizon, key=key))
    x = bars.withColumn("_f", ahead)
    if minutes is not None:
        end = F.col("ts") + F.expr(f"interval {minutes} minutes")
        x = x.withColumn("_e", end).withColumn("_f", F.filter("_f", lambda v: v["ts"] <= F.col("_e"))).drop("_e")
    up, down = F.col("close") * (1 + profit), F.col("close") * (1 - loss)
    x = x.withColumns({"_u": up, "_d": down})
    hit = F.get(F.filter("_f", lambda v: (v["high"] >= F.col("_u")) | (v["low"] <= F.col("_d"))), 0)
    return x.withColumn("label", F.when(hit.isNull(), 0).when(hit["high"] >= F.col("_u"), 1).otherwise(-1)).drop("_f", "_u", "_d")


def drop_hold(labelled: DataFrame) -> DataFrame:
    return labelled.where("label <> 0")


def tactician_barrier(bars: DataFrame, signal: str = "signal", profit: float = 0.005, loss: float = 0.0025, horizon: int = 30, key: str = E.KEY) -> DataFrame:
    """For rows with a signal (1 long, -1 short): entry at the next open; 1 if the profit comes first, else -1; other rows NULL."""
    ahead = F.collect_list(F.struct("open", "high", "low")).over(E.frame(-1, horizon, key=key))
    x = bars.withColumn("_f", ahead).withColumn("_in", F.get("_f", 0)["open"])
    long = F.col(signal) == 1
    win = lambda v: F.when(long, v["high"] >= F.col("_in") * (1 + profit)).otherwise(v["low"] <= F.col("_in") * (1 - profit))
    lose = lambda v: F.when(long, v["low"] <= F.col("_in") * (1 - loss)).otherwise(v["high"] >= F.col("_in") * (1 + loss))
    first = F.get(F.filter("_f", lambda v: win(v) | lose(v)), 0)
    label = F.when(F.col(signal).isin(1, -1), F.when(first.isNull(), -1).when(win(first), 1).otherwise(-1))
    return x.withColumn("tactician_label", label).drop("_f", "_in")


def direction_target(bars: DataFrame, horizon: int = 5, key: str = E.KEY) -> DataFrame:
    """Return to the bar ``horizon`` ahead and its sign; 0 beyond the end."""
    r = F.coalesce(F.try_divide(E.lag("close", -horizon, key=key), "close") - 1, F.lit(0.0))
    return bars.withColumn("target_return", r).withColumn("target_direction", F.signum("target_return").cast("int"))


def next_bar_label(bars: DataFrame, key: str = E.KEY) -> DataFrame:
    return bars.withColumn("next_up", E.flag(E.lag("close", -1, key=key) > F.col("close")))


def three_class_target(bars: DataFrame, bars_ahead: int = 5, band: float = 0.01, key: str = E.KEY) -> DataFrame:
    r = F.try_divide(E.lag("close", -bars_ahead, key=key), "close") - 1
    return bars.withColumn("target_class", F.when(r > band, 1).when(r < -band, -1).otherwise(0))


def quantile_meta_labels(bars: DataFrame, key: str = E.KEY) -> DataFrame:
    """Quintile bins over the whole series of volatility, volume ratio and trend."""
    x = bars.withColumn("_r", E.pct("close", key=key))
    x = x.withColumns({"_v": E.std("_r", 20, 2, key=key), "_q": F.try_divide("volume", E.mean("volume", 20, 1, key=key)), "_t": E.mean("close", 10, 1, key=key) - E.mean("close", 30, 1, key=key)})
    names = {"_v": "volatility_bin", "_q": "volume_bin", "_t": "trend_bin"}
    edges = x.groupBy(key).agg(*[F.percentile(c, [0.2, 0.4, 0.6, 0.8]).alias(f"{c}e") for c in names])
    x = x.join(edges, key)
    return x.withColumns({n: E.qcut(c, F.col(f"{c}e")) for c, n in names.items()}).drop("_r", *names, *[f"{c}e" for c in names])


META_LABELS = (
    "strong_trend_continuation", "exhaustion_reversal", "range_mean_reversion", "breakout_success", "breakout_failure", "volatility_compression", "volatility_expansion", "flag_formation", "triangle_formation", "rectangle_formation", "momentum_ignition",
    "failed_retest", "ice_berg_orders", "momentum_acceleration", "momentum_deceleration", "capitulation_selling", "euphoric_buying", "dull_market", "flash_crash_pattern", "chop_warning", "fake_out_risk_high", "low_conviction_setup", "high_conviction_setup",
)


def meta_labels(bars: DataFrame, key: str = E.KEY) -> DataFrame:
    """The 23 explicit labels (0 or 1) on bars of one timeframe.

    Three thresholds are the last value of a rolling 60 % quantile over 30 bars, one per series, so they look
    ahead over the whole series as in the model they come from; failed retests and flash crashes see one bar ahead.
    """
    z = lambda c: F.coalesce(c, F.lit(0.0))
    c, h, l, o, v = (F.col(n) for n in ("close", "high", "low", "open", "volume"))
    x = bollinger(rsi(bars), least_rows=1)
    x = x.withColumns({"_r": E.pct("close"), "_sma": E.mean("close", 20, 1), "_rh": E.high("close", 20, 1), "_rl": E.low("close", 20, 1), "_tr": z(true_range()), "_d": E.diff("close"), "_hl": h - l})
    width = F.try_divide(F.col("bb_upper") - F.col("bb_lower"), "_sma")
    x = x.withColumns({
        "_bp": F.coalesce(E.clip("bb_position", 0, 1), F.lit(0.5)), "_bw": F.when(width != 0, width), "_m5": z(E.total("_r", 5, 1)), "_m10": z(E.total("_r", 10, 1)), "_v20": z(E.std("_r", 20, 2)), "_v10": z(E.std("_r", 10, 2)), "_vr": F.coalesce(F.try_divide("volume", E.mean("volume", 10, 1)), F.lit(1.0)),
        "_c5": E.pct("close", 5), "_c1": E.pct("close", 1), "_c3": E.pct("close", 3), "_sg": F.signum("_d"), "_ph": E.lag("_rh"), "_pl": E.lag("_rl"), "_v50": E.high("volume", 50, 5), "_h50": E.high("high", 50, 5), "_l50": E.low("low", 50, 5),
        "_nx": E.lag("close", -1), "_oc": F.try_divide(F.abs(c - o), "open"), "_hc": F.try_divide(h - l, "close"), "_um": E.diff("high"), "_dm": -E.diff("low"),
    })
    x = ewm(x, [Ewm("_e12", "close", span=12), Ewm("_e26", "close", span=26)]).withColumn("_mc", F.col("_e12") - F.col("_e26"))
    x = ewm(x, [Ewm("_ms", "_mc", span=9)])
    near = lambda p, w: F.coalesce(F.try_divide(F.abs(c - F.col(p)), p) <= w, F.lit(False))
    x = x.withColumns({
        "_ratio": F.coalesce(F.try_divide("_v10", "_v20"), F.lit(1.0)), "_bw0": z(F.col("_bw")), "_n1": near("_ph", 0.0005).cast("int"), "_n2": near("_pl", 0.0005).cast("int"), "_dm5": E.diff("_m5"), "_p5": E.lag("_c5"), "_dr": E.diff("_c5"), "_ph50": E.lag("_h50"), "_pl50": E.lag("_l50"), "_pv50": E.lag("_v50"),
        "_lo5": F.min("_nx").over(E.frame(4)), "_hi5": F.max("_nx").over(E.frame(4)), "_dn": E.flag(F.col("_d") < 0), "_up": E.flag(F.col("_d") > 0), "_vm50": E.mean("volume", 50, 10), "_a20": E.mean("_tr", 20, 5), "_a100": E.mean("_tr", 100, 10), "_turn": E.flag(F.abs(E.diff("_sg")) > 0),
        "_pdm": F.when((F.col("_um") > F.col("_dm")) & (F.col("_um") > 0), F.col("_um")).otherwise(0.0), "_mdm": F.when((F.col("_dm") > F.col("_um")) & (F.col("_dm") > 0), F.col("_dm")).otherwise(0.0), "_a14": E.mean("_tr", 14, 5),
        "_t1": E.quantile("_v20", 0.6, 30, 10), "_t2": E.quantile(F.abs("_m5"), 0.6, 30, 10), "_t3": E.quantile("_vr", 0.6, 30, 10), "_bf": (((F.col("_bp") > 0.8) | (F.col("_bp") < 0.2)) & (F.abs("_m5") < 0.005)).cast("int"), "_hla": E.mean("_hl", 20, 5),
    })
    x = x.withColumn("_a20", z(E.ffill("_a20")))
    last = x.groupBy(key).agg(*[F.max_by(t, "ts").alias(f"{t}x") for t in ("_t1", "_t2", "_t3")])
    x = x.join(last, key).withColumns({"_tv": F.coalesce("_t1x", F.lit(0.02)), "_tm": F.coalesce("_t2x", F.lit(0.01)), "_tq": F.coalesce("_t3x", F.lit(1.5))})
    pdi, mdi = 100 * F.try_divide(E.mean("_pdm", 14, 5), "_a14"), 100 * F.try_divide(E.mean("_mdm", 14, 5), "_a14")
    x = x.withColumns({"_dx": 100 * F.try_divide(F.abs(pdi - mdi), pdi + mdi), "_a100": F.coalesce(E.ffill("_a100"), "_a20"), "_low5": E.flag(v < 0.8 * F.col("_vm50")), "_bwm": E.mean("_bw0", 100, 20), "_drp": E.lag("_dr"), "_bw5": E.lag("_bw0", 5), "_pc": E.lag("close"), "_pvol": E.lag("volume")})
    x = x.withColumns({"_adx": F.coalesce(E.mean("_dx", 14, 5), F.lit(20.0)), "_bwm": F.coalesce(E.ffill("_bwm"), "_bw0")})
    K = F.col
    prior = lambda p: F.try_divide(F.abs(c - K(p)), p) <= 0.0015
    quiet = v < 0.6 * K("_pv50")
    drop = F.greatest(K("_pc") - c, F.lit(0.0))
    place = F.coalesce(E.clip(F.try_divide(c - K("_rl"), K("_rh") - K("_rl")), 0, 1), F.lit(0.5))
    sr = lambda p: F.coalesce(F.try_divide(F.abs(c - K(p)), p) < 0.005, F.lit(False))
    rules = {
        "strong_trend_continuation": (K("_m10") > F.greatest(F.lit(0.005), K("_tm"))) & (K("rsi") > 40) & (K("rsi") < 70) & (K("_bp") > 0.3) & (K("_bp") < 0.7),
        "exhaustion_reversal": ((K("rsi") > 70) | (K("_bp") > 0.8)) & (K("_m5") < 0) & (K("_vr") > F.greatest(F.lit(1.1), K("_tq"))),
        "range_mean_reversion": ((K("_bp") < 0.2) | (K("_bp") > 0.8)) & (K("_v20") < K("_tv")) & (F.abs("_m10") < 0.01),
        "breakout_success": (((c > K("_ph")) & (K("_m5") > 0)) | ((c < K("_pl")) & (K("_m5") < 0))) & (K("_vr") > K("_tq")),
        "breakout_failure": K("_bf") == 1,
        "volatility_compression": (K("_bw") < 0.05) & (K("_ratio") < 0.8),
        "volatility_expansion": (K("_ratio") > 1.5) & (K("_vr") > K("_tq")),
        "flag_formation": (F.abs("_m5") > 0.02) & (K("_v10") < K("_tv")),
        "triangle_formation": K("_bw") < 0.03,
        "rectangle_formation": (place >= 0.3) & (place <= 0.7) & (K("_bw") < 0.05),
        "momentum_ignition": ((K("rsi") > 60) | (K("rsi") < 40)) & (F.abs(K("_mc") - K("_ms")) > 0.001) & (F.abs("_m5") > K("_tm")),
        "failed_retest": (prior("_ph50") & quiet & (F.try_divide(K("_ph50") - K("_lo5"), "_ph50") > 0.0025)) | (prior("_pl50") & quiet & (F.try_divide(K("_hi5") - K("_pl50"), "_pl50") > 0.0025)),
        "ice_berg_orders": (E.total("_dm5", 3, 2) < 0) & (K("_vr") > F.greatest(F.lit(1.5), K("_tq"))) & (((E.total("_n1", 20, 5) >= 3) & (c <= K("_rh"))) | ((E.total("_n2", 20, 5) >= 3) & (c >= K("_rl")))),
        "momentum_acceleration": (K("_c5") > K("_p5")) & (K("_dr") > 0) & (((c > K("_sma")) & (K("_c5") > 0)) | ((c < K("_sma")) & (K("_c5") < 0))) & (v > 1.1 * K("_pvol")),
        "momentum_deceleration": ((K("_c5") > 0) & (K("_p5") > 0) & (K("_dr") < 0) & (K("_drp") < 0) & (c > K("_sma"))) | ((K("_c5") < 0) & (K("_p5") < 0) & (K("_dr") > 0) & (K("_drp") > 0) & (c < K("_sma"))),
        "capitulation_selling": ((K("_c1") <= -0.015) | (K("_c3") <= -0.025)) & (K("_vr") > 2) & (K("rsi") < 25) & (E.total("_dn", 7, 3) >= 5),
        "euphoric_buying": ((K("_c1") >= 0.015) | (K("_c3") >= 0.025)) & (K("_vr") > 2) & (K("rsi") > 75) & (E.total("_up", 7, 3) >= 5),
        "dull_market": (K("_a20") < 0.6 * K("_a100")) & (E.total("_low5", 5) == 5) & (K("_hl") < 0.4 * K("_hla")) & (E.high("_oc", 10, 5) < 0.003),
        "flash_crash_pattern": (K("_c1") <= -0.01) & (K("_vr") >= 5) & ((K("_hi5") - c) >= 0.5 * drop),
        "chop_warning": (K("_adx") < 20) & (K("_bw0") < 0.8 * K("_bwm")) & (E.total("_turn", 10, 5) >= 5) & (E.high("_hc", 8, 5) < 0.004),
        "fake_out_risk_high": (E.total("_bf", 20, 5) >= 2) & (K("_ratio") > 1.5) & (K("_bw5") < 0.05) & (sr("_ph") | sr("_pl")) & (K("_vr") > 0.8) & (K("_vr") < 1.2),
    }
    x = x.withColumns({n: E.flag(r) for n, r in rules.items()})
    base = [K(n) for n in ("strong_trend_continuation", "exhaustion_reversal", "range_mean_reversion", "breakout_success")] + [E.flag(K("_ratio") > 1.5), E.flag(K("_bw") < 0.05)]
    base += [K(n) for n in ("flag_formation", "triangle_formation", "rectangle_formation", "momentum_ignition", "failed_retest", "capitulation_selling", "euphoric_buying")]
    n = sum(base, F.lit(0))
    low = (n <= 1) & ((K("_vr") < 1) | (K("_adx") < 25) | (F.signum("_m5") != F.signum("_m10")))
    high = (n >= 3) & (K("_vr") > 1.2) & ((K("_adx") > 30) | (F.abs(F.try_divide("close", "_sma") - 1) > 0.02))
    x = x.withColumns({"low_conviction_setup": E.flag(low), "high_conviction_setup": E.flag(high)})
    return x.select(*bars.columns, *META_LABELS)


def meta_labels_on_base(bars: DataFrame, interval: str, spark_interval: str, causal: bool = True) -> DataFrame:
    """Meta-labels of a longer timeframe on base bars: known when the longer bar ends (causal), else one base bar late."""
    coarse = meta_labels(resample(bars, interval))
    out = higher_timeframe(bars, coarse, list(META_LABELS), spark_interval, causal=causal)
    if not causal:
        out = out.withColumns({n: E.lag(n) for n in META_LABELS})
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in META_LABELS})
