"""Queries over hourly bars: regimes, labels, events, levels, selection, metrics, backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import expr as E
from tidewell.operators import backtest, clean, events as V, indicators as I, labels as L, metrics, profile, regimes, select
from tidewell.plans.base import BARS, R, W, div, hourly, lag, over, pick, query, recursive, rounded, steps
from tidewell.plans.series import ADX, K, TR, _a, out

# regimes

_f21, _s55 = _a(21), _a(55)
_EMAS = recursive("bars", {"f": "x.close", "s": "x.close"}, {"f": f"(1 - {_f21}) * r.f + {_f21} * x.close", "s": f"(1 - {_s55}) * r.s + {_s55} * x.close"}).replace("n AS (", "n2 AS (").replace("r AS (", "e2 AS (").replace("FROM n x", "FROM n2 x").replace("FROM r JOIN n x", "FROM e2 r JOIN n2 x")
REGIME = f"""{ADX}, {_EMAS}, j AS (SELECT b.symbol, b.ts, b.close, e.f, e.s, a.adx, coalesce(abs(e.f - e.s) / nullif(CASE WHEN count(b.close) OVER w >= 55 THEN avg(b.close) OVER w END, 0), 0) AS sep FROM bars b JOIN e2 e ON b.symbol = e.symbol AND b.ts = e.ts JOIN adx a ON a.symbol = b.symbol AND a.ts = b.ts WINDOW w AS (PARTITION BY b.symbol ORDER BY b.ts ROWS BETWEEN 54 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, CASE WHEN adx <= 20 THEN 'SIDEWAYS' WHEN adx >= 25 AND sep >= 0 AND f > s THEN 'BULL' WHEN adx >= 25 AND sep >= 0 AND f < s THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime FROM j),
regimes AS (SELECT *, CASE WHEN regime = 'SIDEWAYS' THEN least(greatest((20 - adx) / 20, 0.2), 1) ELSE least(greatest(0.5 * least(greatest((adx - 20) / 5, 0), 1) + 0.5 * least(greatest(sep * 10, 0), 1), 0.2), 1) END AS confidence FROM g)"""


def _regimes(spark, sf):
    return regimes.regime_ema_adx(hourly(spark, sf))


@query(f"WITH RECURSIVE {REGIME} SELECT symbol, ts, regime, round(confidence, 6) AS confidence, round(adx, 6) AS adx FROM regimes")
def regime_ema_adx(spark, sf):
    return out(_regimes(spark, sf), "regime", "confidence", "adx")


@query(f"WITH RECURSIVE {REGIME} SELECT symbol, regime, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) AS share FROM regimes GROUP BY symbol, regime")
def regime_distribution(spark, sf):
    return rounded(regimes.distribution(_regimes(spark, sf), keys=["symbol"]))


@query(f"WITH RECURSIVE {REGIME}, tr2 AS (SELECT symbol, ts, (row_number() {W})::INT - 1 AS row_index, {lag('regime')} AS from_value, regime AS to_value FROM regimes) SELECT * FROM tr2 WHERE from_value <> to_value")
def regime_transitions(spark, sf):
    return regimes.transitions(_regimes(spark, sf))


@query(f"WITH RECURSIVE {REGIME}, tr2 AS (SELECT regime AS from_value, {lag('regime', -1)} AS to_value FROM regimes), c AS (SELECT from_value, to_value, count(*) AS n FROM tr2 WHERE to_value IS NOT NULL GROUP BY 1, 2) SELECT *, round(n / (sum(n) OVER (PARTITION BY from_value) + 1e-9::DOUBLE), 6) AS p FROM c")
def transition_matrix(spark, sf):
    return rounded(regimes.transition_matrix(_regimes(spark, sf)))


@query(f"WITH {BARS}, c AS (SELECT *, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0 END AS p FROM bars) SELECT symbol, ts, (" + " OR ".join("(" + " AND ".join(f"coalesce({lag('p', -k)} >= 0.6, false)" for k in range(s, s + 3)) + ")" for s in (1, 2, 3)) + ")::INT AS emergence FROM c")
def emergence_label(spark, sf):
    x = hourly(spark, sf).withColumn("p", F.coalesce(E.div(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)))
    return regimes.emergence(x, "p").select(*K, "emergence")


@query(f"WITH {BARS}, c AS (SELECT *, CASE WHEN close > open THEN 'UP' ELSE 'DOWN' END AS s FROM bars) SELECT symbol, ts, coalesce((s = 'UP' AND {lag('s', -1)} <> 'UP')::INT, 0) AS exit_hazard FROM c")
def exit_hazard(spark, sf):
    x = hourly(spark, sf).withColumn("s", F.when(F.col("close") > F.col("open"), "UP").otherwise("DOWN"))
    return regimes.exit_hazard(x, "UP", "s").select(*K, "exit_hazard")


_P3 = _a(3)
_SP = recursive("u", {"a": "x.up", "b": "1 - x.up"}, {"a": f"(1 - {_P3}) * r.a + {_P3} * x.up", "b": f"(1 - {_P3}) * r.b + {_P3} * (1 - x.up)"})


@query(f"WITH RECURSIVE {BARS}, u AS (SELECT *, (close > open)::INT::DOUBLE AS up FROM bars), {_SP}, p AS (SELECT symbol, ts, a / (a + b) AS p_up, b / (a + b) AS p_down FROM r), q AS (SELECT *, coalesce(p_up - {lag('p_up')}, 0) AS d FROM p) " + pick({"p_UP": "p_up", "dp_UP": "d", "d2p_UP": f"coalesce(d - {lag('d')}, 0)", "entropy": "-(p_up * ln(greatest(p_up, 1e-12::DOUBLE)) + p_down * ln(greatest(p_down, 1e-12::DOUBLE)))"}, "q"))
def regime_probabilities(spark, sf):
    x = hourly(spark, sf).withColumn("regime", F.when(F.col("close") > F.col("open"), "UP").otherwise("DOWN"))
    return out(regimes.smoothed_probabilities(x, ["UP", "DOWN"]), "p_UP", "dp_UP", "d2p_UP", "entropy")


@query("WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT label, i, avg(e[i]) AS m FROM v, range(1, 17) t(i) GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM x GROUP BY 1) SELECT vec_id, v.label, round(list_dot_product(e[1:16], c) / (sqrt(list_dot_product(e[1:16], e[1:16])) * sqrt(list_dot_product(c, c))), 6) AS cosine FROM v JOIN c USING (label)")
def cosine_to_centroid(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("embedding", F.slice("embedding", 1, 16))
    return rounded(regimes.cosine_to_centroid(v, "embedding", "label", 16).select("vec_id", "label", "cosine"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings), t AS (SELECT vec_id, a, list_sum(a) AS s FROM v) SELECT vec_id, round(-list_sum(list_transform(a, lambda x: CASE WHEN x > 0 THEN x / s * ln(x / s) ELSE 0 END)), 6) AS entropy FROM t")
def entropy_rows(spark, sf):
    return rounded(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", regimes.entropy_of(F.col("embedding")).alias("entropy")))


# labels


def _barrier(up: str, down: str, minutes: bool) -> str:
    time = "AND f.ts <= x.ts + INTERVAL 300 minutes" if minutes else ""
    return f"WITH {BARS}, x AS (SELECT *, row_number() {W} AS i FROM bars), h AS (SELECT x.symbol, x.ts, arg_min(CASE WHEN f.high >= {up} THEN 1 ELSE -1 END, f.i) AS label FROM x JOIN x f ON f.symbol = x.symbol AND f.i > x.i AND f.i <= x.i + 100 {time} WHERE f.high >= {up} OR f.low <= {down} GROUP BY 1, 2) SELECT x.symbol, x.ts, coalesce(label, 0)::INT AS label FROM x LEFT JOIN h ON h.symbol = x.symbol AND h.ts = x.ts"


@query(_barrier("x.close * (1 + 0.2::DOUBLE)", "x.close * (1 - 0.1::DOUBLE)", True))
def triple_barrier(spark, sf):
    return L.triple_barrier(hourly(spark, sf), 0.2, 0.1, 100, 300).select(*K, "label")


_TAC = f"""WITH {BARS}, x AS (SELECT *, row_number() {W} AS i, CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END AS signal, {lag('open', -1)} AS e FROM bars),
h AS (SELECT x.symbol, x.ts, arg_min(CASE WHEN (x.signal = 1 AND f.high >= x.e * (1 + 0.005::DOUBLE)) OR (x.signal = -1 AND f.low <= x.e * (1 - 0.005::DOUBLE)) THEN 1 ELSE -1 END, f.i) AS label FROM x JOIN x f ON f.symbol = x.symbol AND f.i > x.i AND f.i <= x.i + 30 WHERE (x.signal = 1 AND (f.high >= x.e * (1 + 0.005::DOUBLE) OR f.low <= x.e * (1 - 0.0025::DOUBLE))) OR (x.signal = -1 AND (f.low <= x.e * (1 - 0.005::DOUBLE) OR f.high >= x.e * (1 + 0.0025::DOUBLE))) GROUP BY 1, 2)
SELECT x.symbol, x.ts, CASE WHEN signal <> 0 THEN coalesce(label, -1) END::DOUBLE AS tactician_label FROM x LEFT JOIN h ON h.symbol = x.symbol AND h.ts = x.ts"""


def _signal(df):
    return df.withColumn("signal", F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), -1).otherwise(0))


@query(_TAC)
def tactician_barrier(spark, sf):
    return L.tactician_barrier(_signal(hourly(spark, sf))).select(*K, F.col("tactician_label").cast("double").alias("tactician_label"))


@query(f"WITH {BARS}, t AS (SELECT *, coalesce({div(lag('close', -5), 'close')} - 1, 0) AS r FROM bars) SELECT symbol, ts, round(r, 6) AS target_return, sign(r)::INT AS target_direction, coalesce(({lag('close', -1)} > close)::INT, 0) AS next_up, CASE WHEN {lag('close', -5)} / close - 1 > 0.01 THEN 1 WHEN {lag('close', -5)} / close - 1 < -0.01 THEN -1 ELSE 0 END AS target_class FROM t")
def direction_target(spark, sf):
    return out(L.three_class_target(L.next_bar_label(L.direction_target(hourly(spark, sf)))), "target_return", "target_direction", "next_up", "target_class")


_QC = steps(BARS, {"r": f"{div('close', lag('close'))} - 1"}, {"v": R("stddev_samp", "r", 20, 2), "q": div("volume", R("avg", "volume", 20, 1)), "t": f"{R('avg', 'close', 10, 1)} - {R('avg', 'close', 30, 1)}"})
_qb = lambda c: f"CASE WHEN {c} IS NOT NULL THEN len(list_filter(list_distinct(e{c}), lambda z: z < {c}))::DOUBLE END"


@query(f"WITH {_QC}, e AS (SELECT symbol, {', '.join(f'quantile_cont({c}, [0.2, 0.4, 0.6, 0.8]) AS e{c}' for c in 'vqt')} FROM s2 GROUP BY 1) SELECT symbol, ts, {_qb('v')} AS volatility_bin, {_qb('q')} AS volume_bin, {_qb('t')} AS trend_bin FROM s2 JOIN e USING (symbol)")
def qcut_regimes(spark, sf):
    return L.quantile_meta_labels(hourly(spark, sf)).select(*K, *[F.col(c).cast("double").alias(c) for c in ("volatility_bin", "volume_bin", "trend_bin")])


_ML = "(%s)"
_f12, _s26, _g9 = _a(12), _a(26), _a(9)
_MC = recursive("bars", {"f": "x.close", "s": "x.close", "g": "0.0::DOUBLE"}, {"f": f"(1 - {_f12}) * r.f + {_f12} * x.close", "s": f"(1 - {_s26}) * r.s + {_s26} * x.close", "g": f"(1 - {_g9}) * r.g + {_g9} * ((1 - {_f12}) * r.f + {_f12} * x.close - (1 - {_s26}) * r.s - {_s26} * x.close)"})
_near = lambda p, w, strict=False: f"coalesce(abs(close - {p}) / nullif({p}, 0) {'<' if strict else '<='} {w}, false)"
_META = f"{BARS}, {_MC}, m0 AS (SELECT b.*, r.f - r.s - r.g AS mh FROM bars b JOIN r ON r.symbol = b.symbol AND r.ts = b.ts), " + steps(
    "z0 AS (SELECT 1)",
    {"d": f"close - {lag('close')}", "r1": f"{div('close', lag('close'))} - 1", "tr": TR, "sma": R("avg", "close", 20, 1), "sd": R("stddev_samp", "close", 20, 2), "rh": R("max", "close", 20, 1), "rl": R("min", "close", 20, 1), "hl": "high - low", "c5": f"{div('close', lag('close', 5))} - 1", "c3": f"{div('close', lag('close', 3))} - 1", "nx": lag("close", -1), "oc": "abs(close - open) / open", "hc": "(high - low) / close", "um": f"high - {lag('high')}", "dm": f"{lag('low')} - low", "h50": R("max", "high", 50, 5), "l50": R("min", "low", 50, 5), "v50": R("max", "volume", 50, 5), "vm50": R("avg", "volume", 50, 10), "vr": f"coalesce({div('volume', R('avg', 'volume', 10, 1))}, 1)"},
    {"gg": "CASE WHEN d > 0 THEN d ELSE 0 END", "ll": "CASE WHEN d < 0 THEN -d ELSE 0 END", "bp": "CASE WHEN sd <> 0 THEN least(greatest((close - (sma - 2 * sd)) / (4 * sd), 0), 1) ELSE 0.5 END", "bw": "CASE WHEN sd <> 0 THEN 4 * sd / nullif(sma, 0) END", "m5": f"coalesce({R('sum', 'r1', 5, 1)}, 0)", "m10": f"coalesce({R('sum', 'r1', 10, 1)}, 0)", "v20": f"coalesce({R('stddev_samp', 'r1', 20, 2)}, 0)", "v10": f"coalesce({R('stddev_samp', 'r1', 10, 2)}, 0)", "sg": "sign(d)", "ph": lag("rh"), "pl": lag("rl"), "pdm": "CASE WHEN um > dm AND um > 0 THEN um ELSE 0 END", "mdm": "CASE WHEN dm > um AND dm > 0 THEN dm ELSE 0 END", "p5": lag("c5"), "dr": f"c5 - {lag('c5')}", "dn": "coalesce((d < 0)::INT, 0)", "upn": "coalesce((d > 0)::INT, 0)", "low5": "coalesce((volume < 0.8 * vm50)::INT, 0)", "ph50": lag("h50"), "pl50": lag("l50"), "pv50": lag("v50"), "lo5": f"min(nx) {over(4)}", "hi5": f"max(nx) {over(4)}"},
    {"rsi": f"coalesce(100 - 100 / (1 + {R('avg', 'gg', 14, 1)} / nullif({R('avg', 'll', 14, 1)}, 0)), 50)", "ratio": "coalesce(v10 / nullif(v20, 0), 1)", "bw0": "coalesce(bw, 0)", "am5": "abs(m5)", "n1": _near("ph", 0.0005) + "::INT", "n2": _near("pl", 0.0005) + "::INT", "dm5": f"m5 - {lag('m5')}", "turn": f"coalesce((abs(sg - {lag('sg')}) > 0)::INT, 0)", "a20": R("avg", "tr", 20, 5), "a100": R("avg", "tr", 100, 10), "a14": R("avg", "tr", 14, 5), "bf": "((bp > 0.8 OR bp < 0.2) AND abs(m5) < 0.005)::INT", "drp": lag("dr")},
    {"t1": R("quantile_cont({x}, 0.6)", "v20", 30, 10), "t2": R("quantile_cont({x}, 0.6)", "am5", 30, 10), "t3": R("quantile_cont({x}, 0.6)", "vr", 30, 10), "pdi": f"100 * {R('avg', 'pdm', 14, 5)} / nullif(a14, 0)", "mdi": f"100 * {R('avg', 'mdm', 14, 5)} / nullif(a14, 0)", "fa20": f"coalesce(last_value(a20 IGNORE NULLS) {over(None)}, 0)", "bwm": R("avg", "bw0", 100, 20), "bw5": lag("bw0", 5)},
    {"dx": "100 * abs(pdi - mdi) / nullif(pdi + mdi, 0)", "tv": "coalesce(last_value(t1) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.02)", "tm": "coalesce(last_value(t2) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.01)", "tq": "coalesce(last_value(t3) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 1.5)", "fa100": f"coalesce(last_value(a100 IGNORE NULLS) {over(None)}, fa20)", "fbwm": f"coalesce(last_value(bwm IGNORE NULLS) {over(None)}, bw0)"},
    {"adx": f"coalesce({R('avg', 'dx', 14, 5)}, 20)", "place": "coalesce(least(greatest((close - rl) / nullif(rh - rl, 0), 0), 1), 0.5)"},
    source="m0",
)
_MR = {
    "strong_trend_continuation": "m10 > greatest(0.005, tm) AND rsi > 40 AND rsi < 70 AND bp > 0.3 AND bp < 0.7", "exhaustion_reversal": "(rsi > 70 OR bp > 0.8) AND m5 < 0 AND vr > greatest(1.1, tq)", "range_mean_reversion": "(bp < 0.2 OR bp > 0.8) AND v20 < tv AND abs(m10) < 0.01", "breakout_success": "((close > ph AND m5 > 0) OR (close < pl AND m5 < 0)) AND vr > tq", "breakout_failure": "bf = 1",
    "volatility_compression": "bw < 0.05 AND ratio < 0.8", "volatility_expansion": "ratio > 1.5 AND vr > tq", "flag_formation": "abs(m5) > 0.02 AND v10 < tv", "triangle_formation": "bw < 0.03", "rectangle_formation": "place >= 0.3 AND place <= 0.7 AND bw < 0.05", "momentum_ignition": "(rsi > 60 OR rsi < 40) AND abs(mh) > 0.001 AND abs(m5) > tm",
    "failed_retest": "(abs(close - ph50) / nullif(ph50, 0) <= 0.0015 AND volume < 0.6 * pv50 AND (ph50 - lo5) / nullif(ph50, 0) > 0.0025) OR (abs(close - pl50) / nullif(pl50, 0) <= 0.0015 AND volume < 0.6 * pv50 AND (hi5 - pl50) / nullif(pl50, 0) > 0.0025)",
    "ice_berg_orders": f"{R('sum', 'dm5', 3, 2)} < 0 AND vr > greatest(1.5, tq) AND (({R('sum', 'n1', 20, 5)} >= 3 AND close <= rh) OR ({R('sum', 'n2', 20, 5)} >= 3 AND close >= rl))",
    "momentum_acceleration": f"c5 > p5 AND dr > 0 AND ((close > sma AND c5 > 0) OR (close < sma AND c5 < 0)) AND volume > 1.1 * {lag('volume')}", "momentum_deceleration": "(c5 > 0 AND p5 > 0 AND dr < 0 AND drp < 0 AND close > sma) OR (c5 < 0 AND p5 < 0 AND dr > 0 AND drp > 0 AND close < sma)",
    "capitulation_selling": f"(r1 <= -0.015 OR c3 <= -0.025) AND vr > 2 AND rsi < 25 AND {R('sum', 'dn', 7, 3)} >= 5", "euphoric_buying": f"(r1 >= 0.015 OR c3 >= 0.025) AND vr > 2 AND rsi > 75 AND {R('sum', 'upn', 7, 3)} >= 5",
    "dull_market": f"fa20 < 0.6 * fa100 AND {R('sum', 'low5', 5)} = 5 AND hl < 0.4 * {R('avg', 'hl', 20, 5)} AND {R('max', 'oc', 10, 5)} < 0.003", "flash_crash_pattern": f"r1 <= -0.01 AND vr >= 5 AND hi5 - close >= 0.5 * greatest({lag('close')} - close, 0)", "chop_warning": f"adx < 20 AND bw0 < 0.8 * fbwm AND {R('sum', 'turn', 10, 5)} >= 5 AND {R('max', 'hc', 8, 5)} < 0.004",
    "fake_out_risk_high": f"{R('sum', 'bf', 20, 5)} >= 2 AND ratio > 1.5 AND bw5 < 0.05 AND ({_near('ph', 0.005, True)} OR {_near('pl', 0.005, True)}) AND vr > 0.8 AND vr < 1.2",
}
_BASE = ["strong_trend_continuation", "exhaustion_reversal", "range_mean_reversion", "breakout_success", "flag_formation", "triangle_formation", "rectangle_formation", "momentum_ignition", "failed_retest", "capitulation_selling", "euphoric_buying"]
_ML = f"{_META}, lab AS (SELECT *, {', '.join(f'coalesce(({r})::INT, 0) AS {n}' for n, r in _MR.items())} FROM s6), cnt AS (SELECT *, {' + '.join(_BASE)} + coalesce((ratio > 1.5)::INT, 0) + coalesce((bw < 0.05)::INT, 0) AS cc FROM lab), meta AS (SELECT *, coalesce((cc <= 1 AND (vr < 1 OR adx < 25 OR sign(m5) <> sign(m10)))::INT, 0) AS low_conviction_setup, coalesce((cc >= 3 AND vr > 1.2 AND (adx > 30 OR abs(close / nullif(sma, 0) - 1) > 0.02))::INT, 0) AS high_conviction_setup FROM cnt)"


@query(f"WITH RECURSIVE {_ML} SELECT symbol, ts, {', '.join(L.META_LABELS)} FROM meta")
def meta_labels(spark, sf):
    return L.meta_labels(hourly(spark, sf)).select(*K, *L.META_LABELS)


# events

_SC = f"{BARS}, sc AS (SELECT symbol, ts, close, (row_number() {W})::INT - 1 AS row_index, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0 END AS strength, least(trades / 5.0, 1)::DOUBLE AS activity FROM bars)"
_TH = {"strength": 0.8, "activity": 0.6}
_EDGE = f"{_SC}, ed AS (" + " UNION ALL ".join(f"SELECT symbol, ts, row_index, '{c}' AS event_label, {c} AS intensity, CASE WHEN {o} >= {_TH[o]} THEN ['{o}'] ELSE []::VARCHAR[] END AS secondary_labels FROM (SELECT *, coalesce({lag(c)}, 0) AS p FROM sc) WHERE {c} >= {_TH[c]} AND p < {_TH[c]}" for c, o in (("strength", "activity"), ("activity", "strength"))) + ")"


def _scores(spark, sf):
    return hourly(spark, sf).withColumns({"strength": F.coalesce(E.div(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)), "activity": F.least(F.col("trades") / 5.0, F.lit(1.0))})


@query(f"WITH {_EDGE} SELECT symbol, ts, row_index, event_label, round(intensity, 6) AS intensity, array_to_string(secondary_labels, ',') AS secondary FROM ed")
def event_rising_edge(spark, sf):
    x = V.triggers(_scores(spark, sf), _TH)
    return rounded(x.withColumn("secondary", F.array_join("secondary_labels", ",")).drop("secondary_labels"))


@query(f"""WITH RECURSIVE {_EDGE}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol, event_label ORDER BY row_index) AS k FROM ed),
c AS (SELECT symbol, event_label, k, row_index, row_index AS last, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.symbol, o.event_label, o.k, o.row_index, CASE WHEN o.row_index - c.last >= 45 THEN o.row_index ELSE c.last END, o.row_index - c.last >= 45 FROM c JOIN o ON o.symbol = c.symbol AND o.event_label = c.event_label AND o.k = c.k + 1) SELECT symbol, event_label, row_index FROM c WHERE kept""")
def event_cooldown(spark, sf):
    return V.cooldown(V.triggers(_scores(spark, sf), _TH)).select("symbol", "event_label", "row_index")


@query(f"""WITH {_EDGE}, w AS (SELECT *, list(close) {over(60, -1)} AS pre, list(close) {over(-1, 20)} AS post FROM sc), x AS (SELECT ed.symbol, ed.row_index, ed.event_label, close, pre, post FROM ed JOIN w ON w.symbol = ed.symbol AND w.row_index = ed.row_index WHERE len(pre) = 60 AND len(post) = 20)
SELECT symbol, row_index, event_label, round(list_avg(pre), 6) AS pre_mean, round(post[20] / close - 1, 6) AS end_return, list_min(list_transform(range(1, 21), lambda i: CASE WHEN post[i] / close - 1 >= 0.1 THEN i END))::DOUBLE AS bars_to_profit FROM x""")
def event_windows(spark, sf):
    x = V.windows(_scores(spark, sf), V.triggers(_scores(spark, sf), _TH), ["close"], profit=0.1)
    return rounded(x.select("symbol", "row_index", "event_label", F.col("pooled")["close_mean"].alias("pre_mean"), F.element_at("path_returns", 20).alias("end_return"), F.col("bars_to_profit").cast("double").alias("bars_to_profit")))


@query(f"WITH {_EDGE} SELECT symbol, event_label, row_index FROM ed QUALIFY row_number() OVER (PARTITION BY symbol, event_label ORDER BY row_index) <= 5")
def event_top_per_label(spark, sf):
    return V.per_label(V.triggers(_scores(spark, sf), _TH), 5).select("symbol", "event_label", "row_index")


# levels

_VP = f"{BARS}, q AS (SELECT *, (high + low) / 2 AS m FROM bars), g AS (SELECT symbol, min(m) AS lo, (max(m) - min(m)) / 100 AS w FROM q GROUP BY 1), v AS (SELECT symbol, least(greatest(ceil((m - lo) / w) - 1, 0), 99)::INT AS bin, sum(volume) AS volume, first(lo) AS lo, first(w) AS w FROM q JOIN g USING (symbol) GROUP BY 1, 2), vp AS (SELECT symbol, bin, lo + (bin + 0.5) * w AS mid, volume FROM v)"


@query(f"WITH {_VP} SELECT symbol, bin, round(mid, 6) AS mid, volume FROM vp QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, bin) = 1")
def volume_profile_poc(spark, sf):
    return rounded(profile.point_of_control(profile.volume_profile(hourly(spark, sf))))


@query(f"WITH {_VP}, t AS (SELECT *, max(volume) OVER (PARTITION BY symbol ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS top FROM vp), c AS (SELECT symbol, quantile_cont(volume, 0.7) AS q FROM vp GROUP BY 1) SELECT symbol, bin, round(mid, 6) AS mid, volume FROM t JOIN c USING (symbol) WHERE volume = top AND volume >= q")
def high_volume_nodes(spark, sf):
    return rounded(profile.high_volume_nodes(profile.volume_profile(hourly(spark, sf))))


@query(f"WITH {BARS} SELECT symbol, ts, count(*) {over(2, 2)} = 5 AND high = max(high) {over(2, 2)} AS pivot_high, count(*) {over(2, 2)} = 5 AND low = min(low) {over(2, 2)} AS pivot_low FROM bars")
def fractal_pivots(spark, sf):
    return profile.fractal_pivots(hourly(spark, sf)).select(*K, "pivot_high", "pivot_low")


_PV = steps(BARS, {"h": f"max(high) {over(24, -1)}", "l": f"min(low) {over(24, -1)}", "c": f"last_value(close) {over(24, -1)}", "v": f"list(close) {over(24, -1)}"}, {"p": "(h + l + c) / 3"}, {"r1": "2 * p - l", "s1": "2 * p - h"})


@query(f"WITH {_PV} SELECT symbol, ts, round(p, 6) AS pivot, round(r1, 6) AS r1, round(s1, 6) AS s1, round(p + h - l, 6) AS r2, round(p - h + l, 6) AS s2, coalesce(len(list_filter(v, lambda x: abs(x - r1) <= 0.005 * abs(r1))), 0)::INT AS r1_touches, coalesce(len(list_filter(v, lambda x: abs(x - s1) <= 0.005 * abs(s1))), 0)::INT AS s1_touches FROM s3")
def pivot_levels(spark, sf):
    return out(profile.pivot_levels(hourly(spark, sf)), "pivot", "r1", "s1", "r2", "s2", "r1_touches", "s1_touches")


_TL = f"{BARS}, b2 AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 2000), lv AS (SELECT symbol, quantile_cont(low, [0.05, 0.15, 0.30]) AS sup, quantile_cont(high, [0.70, 0.85, 0.95]) AS res FROM b2 GROUP BY 1)"


@query(f"WITH {_TL}, d AS (SELECT b.symbol, b.ts, list_min(list_transform(sup, lambda x: abs(x - close))) / close AS s, list_min(list_transform(res, lambda x: abs(x - close))) / close AS r FROM bars b JOIN lv USING (symbol)) SELECT symbol, ts, round(s, 6) AS support_distance, round(r, 6) AS resistance_distance, round(least(s, r), 6) AS sr_distance, round(exp(-least(s, r) / 0.01::DOUBLE), 6) AS sr_proximity, (least(s, r) <= 0.02)::INT AS sr_nearby FROM d")
def sr_distance(spark, sf):
    x = hourly(spark, sf)
    return out(profile.sr_distance(x, profile.tail_levels(x)), "support_distance", "resistance_distance", "sr_distance", "sr_proximity", "sr_nearby")


@query(f"WITH {steps(BARS, {'pv': 'close * volume'}, {'vw': div(R('sum', 'pv', 20), R('sum', 'volume', 20))})}, q AS (SELECT symbol, quantile_cont(volume, 0.8) AS q FROM bars GROUP BY 1) SELECT symbol, ts, round(vw, 6) AS vwap FROM s2 JOIN q USING (symbol) WHERE volume > q")
def vwap_levels(spark, sf):
    return out(profile.vwap_levels(hourly(spark, sf)), "vwap")


@query(f"WITH {BARS}, p AS (SELECT symbol, close AS price, CASE WHEN (close - {lag('close').replace('ORDER BY ts', 'ORDER BY close')}) / {lag('close').replace('ORDER BY ts', 'ORDER BY close')} > 0.005 THEN 1 ELSE 0 END AS c FROM bars), g AS (SELECT symbol, price, sum(c) OVER (PARTITION BY symbol ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cluster FROM p) SELECT symbol, cluster, round(avg(price), 6) AS level, count(*) AS touches FROM g GROUP BY 1, 2 HAVING count(*) >= 2")
def price_clusters(spark, sf):
    return rounded(profile.cluster_prices(hourly(spark, sf).select("symbol", F.col("close").alias("price"))))


@query(f"WITH {steps(BARS, *[{f'h{l}': f'CASE WHEN count(close) {over(2 ** l - 1)} = {2 ** l} THEN (sum(close) {over(2 ** (l - 1) - 1)} - sum(close) {over(2 ** l - 1, -(2 ** (l - 1)))}) / pow(2, {l} / 2.0) END' for l in (1, 2, 3)}])} SELECT symbol, ts, {', '.join(f'round(h{l}, 6) AS haar_{l}' for l in (1, 2, 3))} FROM s1")
def wavelet_haar(spark, sf):
    return out(profile.haar(hourly(spark, sf)), "haar_1", "haar_2", "haar_3")


# selection and scaling on bars

_COLS = ["open", "high", "low", "close", "volume"]


@query(f"WITH {BARS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM bars" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]))
def corr_matrix(spark, sf):
    return rounded(select.correlations(hourly(spark, sf), _COLS))


@query(f"WITH {BARS} SELECT round(1 / (1 - regr_r2(close, volume)), 6) AS vif FROM bars")
def vif_two_columns(spark, sf):
    v = select.vif(hourly(spark, sf), ["close", "volume"])["close"]
    return spark.createDataFrame([(round(v, 6),)], "vif double")


@query(f"WITH {BARS}, l AS (SELECT volume AS x, coalesce(({lag('close', -1)} > close)::INT, 0) AS y FROM bars), e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 10 AS w FROM l), c AS (SELECT least(floor((x - lo) / w), 9) AS b, y, count(*) AS n FROM l, e GROUP BY 1, 2), p AS (SELECT n, n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS py FROM c) SELECT round(sum(p * ln(p / (pb * py))), 6) AS mutual_information FROM p")
def mutual_information(spark, sf):
    return rounded(select.mutual_information(L.next_bar_label(hourly(spark, sf)), "volume", "next_up"))


@query(f"WITH {BARS}, n AS (SELECT symbol, ts, row_number() {W} AS i, count(*) OVER (PARTITION BY symbol) AS t FROM bars) SELECT symbol, ts, CASE WHEN i <= floor(t * 0.7::DOUBLE) THEN 'train' WHEN i <= floor(t * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM n")
def split_by_time(spark, sf):
    return select.split_by_time(hourly(spark, sf)).select(*K, "split")


@query(f"WITH {BARS}, n AS (SELECT symbol, ts, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS t FROM bars) SELECT symbol, ts, greatest(least(floor((i - (t - (t // 6) * 5)) / (t // 6)::DOUBLE), 4), -1)::INT AS fold FROM n")
def time_series_folds(spark, sf):
    return select.time_series_folds(hourly(spark, sf)).select(*K, "fold")


_SCALE = ["close", "volume"]
_quart = "quantile_cont({c}, 0.25) AS {c}1, quantile_cont({c}, 0.5) AS {c}2, quantile_cont({c}, 0.75) AS {c}3, quantile_cont({c}, 0.01) AS {c}a, quantile_cont({c}, 0.99) AS {c}b, avg({c}) AS {c}m, stddev_pop({c}) AS {c}s, min({c}) AS {c}lo, max({c}) AS {c}hi"
_ST = f"{BARS}, st AS (SELECT {', '.join(_quart.format(c=c) for c in _SCALE)} FROM bars), z AS (SELECT * FROM bars, st)"


def _scaled(f: str) -> str:
    return f"WITH {_ST} " + pick({c: f.format(c=c) for c in _SCALE}, "z")


@query(_scaled("least(greatest({c}, {c}1 - 1.5 * ({c}3 - {c}1)), {c}3 + 1.5 * ({c}3 - {c}1))"))
def iqr_clip(spark, sf):
    return out(clean.iqr_clip(hourly(spark, sf), _SCALE), *_SCALE)


@query(f"WITH {_ST}, y AS (SELECT symbol, ts, close, volume FROM z WHERE close >= close1 - 1.5 * (close3 - close1) AND close <= close3 + 1.5 * (close3 - close1)), q AS (SELECT quantile_cont(volume, 0.25) AS a, quantile_cont(volume, 0.75) AS b FROM y) SELECT symbol, ts, close, volume FROM y, q WHERE volume >= a - 1.5 * (b - a) AND volume <= b + 1.5 * (b - a)")
def iqr_filter(spark, sf):
    return clean.iqr_filter(hourly(spark, sf), _SCALE).select(*K, *_SCALE)


@query(_scaled("least(greatest({c}, {c}a), {c}b)"))
def winsorise(spark, sf):
    return out(clean.winsorise(hourly(spark, sf), _SCALE), *_SCALE)


@query(_scaled("({c} - {c}2) / ({c}3 - {c}1)"))
def robust_scale(spark, sf):
    return out(clean.robust_scale(hourly(spark, sf), _SCALE), *_SCALE)


@query(_scaled("({c} - {c}m) / {c}s"))
def standard_scale(spark, sf):
    return out(clean.standard_scale(hourly(spark, sf), _SCALE), *_SCALE)


@query(_scaled("({c} - {c}lo) / ({c}hi - {c}lo)"))
def minmax_scale(spark, sf):
    return out(clean.minmax_scale(hourly(spark, sf), _SCALE), *_SCALE)


@query(f"WITH {BARS} " + pick({c: f"abs({c}) / (abs(open) + abs(close) + abs(volume))" for c in ("open", "close", "volume")}, "bars"))
def row_normalise(spark, sf):
    return out(clean.row_normalise(hourly(spark, sf), ["open", "close", "volume"]), "open", "close", "volume")


# metrics: small returns from the tiny moves of the score

_RET = f"{BARS}, rt AS (SELECT symbol, ts, ({div('close', lag('close'))} - 1) / 100 AS r, CASE WHEN trades >= 3 THEN 1 ELSE 0 END AS gate, least(trades / 5.0, 1)::DOUBLE AS intensity, (close > open)::INT AS up, coalesce(({lag('close', -1)} > close)::INT, 0) AS next_up FROM bars)"


def _returns(spark, sf):
    x = L.next_bar_label(hourly(spark, sf)).withColumn("r", E.pct("close") / 100)
    return x.withColumns({"gate": F.when(F.col("trades") >= 3, 1).otherwise(0), "intensity": F.least(F.col("trades") / 5.0, F.lit(1.0)), "up": (F.col("close") > F.col("open")).cast("int")})


@query(f"WITH {_RET}, q AS (SELECT symbol, quantile_cont(r, 0.05) AS q FROM rt GROUP BY 1) SELECT symbol, count(r) AS n, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe, round(avg(r) / stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252), 6) AS sortino, round(abs(first(q)), 6) AS var_95, round(abs(avg(CASE WHEN r <= q THEN r END)), 6) AS cvar_95, round(sum(CASE WHEN r > 0 THEN r END) / -sum(CASE WHEN r < 0 THEN r END), 6) AS profit_factor, round(avg((r > 0)::INT), 6) AS win_rate FROM rt JOIN q USING (symbol) GROUP BY symbol")
def sharpe_sortino_var_cvar(spark, sf):
    return rounded(metrics.returns_summary(_returns(spark, sf)))


@query(f"WITH {_RET}, e AS (SELECT symbol, ts, exp(sum(ln(1 + coalesce(r, 0))) {over(None)}) AS e FROM rt), d AS (SELECT symbol, e / max(e) {over(None)} - 1 AS d FROM e) SELECT symbol, round(min(d), 6) AS max_drawdown FROM d GROUP BY 1")
def max_drawdown(spark, sf):
    return rounded(metrics.max_drawdown(_returns(spark, sf)))


@query(f"WITH {_RET}, g AS (SELECT symbol, avg(CASE WHEN gate = 1 THEN r END) / stddev_samp(CASE WHEN gate = 1 THEN r END) * sqrt(252) AS a, avg(r) / stddev_samp(r) * sqrt(252) AS b, avg(gate) AS c FROM rt GROUP BY 1) SELECT symbol, round(a, 6) AS gated_sharpe, round(b, 6) AS sharpe, round(a - b, 6) AS lift, round(c, 6) AS coverage FROM g")
def gated_sharpe(spark, sf):
    return rounded(metrics.gated_sharpe(_returns(spark, sf), "gate"))


@query(f"WITH {_RET} SELECT symbol, sum((intensity >= 0.6)::INT)::BIGINT AS trades, round(sum(CASE WHEN intensity >= 0.6 AND up = next_up THEN 0.01::DOUBLE WHEN intensity >= 0.6 THEN -0.01::DOUBLE ELSE 0 END), 6) AS pnl, round(avg(CASE WHEN intensity >= 0.6 THEN (up = next_up)::INT END), 6) AS win_rate FROM rt GROUP BY 1")
def prediction_scores(spark, sf):
    return rounded(metrics.prediction_scores(_returns(spark, sf), "intensity", "up", "next_up"))
