"""Queries of single-bar setups, weights of experts and summaries at the last bar."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import expr as E
from tidewell.operators import detectors as D
from tidewell.operators import features as X
from tidewell.operators import metrics, regimes
from tidewell.plans.analysis import _RET, REGIME, _regimes, _returns
from tidewell.plans.base import BARS, R, div, hourly, lag, over, query, recursive, rounded, steps
from tidewell.plans.series import K, out


def _mean(name: str, span: int) -> tuple[str, str]:
    """Next sums of weighted values and of weights."""
    keep = f"(1 - 2 / {span + 1}.0::DOUBLE)"
    return f"({keep} * r.{name}n + x.close)", f"({keep} * r.{name}d + 1)"


_FN, _FD = _mean("f", 12)
_SN, _SD = _mean("s", 26)
_SIGNAL = "(1 - 2 / 10.0::DOUBLE)"
_MEANS = recursive(
    "bars",
    {"fn": "x.close", "fd": "1.0::DOUBLE", "sn": "x.close", "sd": "1.0::DOUBLE", "gn": "0.0::DOUBLE", "gd": "1.0::DOUBLE"},
    {"fn": _FN, "fd": _FD, "sn": _SN, "sd": _SD, "gn": f"{_SIGNAL} * r.gn + {_FN} / {_FD} - {_SN} / {_SD}", "gd": f"{_SIGNAL} * r.gd + 1"},
)
_SETUP = f"""WITH RECURSIVE {BARS}, {_MEANS}, x0 AS (SELECT bars.*, fn / fd - sn / sd - gn / gd AS macd_hist FROM r JOIN bars USING (symbol, ts)), {steps(
    "x1 AS (SELECT * FROM x0)",
    {"ret": f"{div('close', lag('close'))} - 1", "d": f"close - {lag('close')}"},
    {"g": "CASE WHEN d > 0 THEN d ELSE 0 END", "l": "CASE WHEN d < 0 THEN -d ELSE 0 END", "m": R("avg", "close", 20), "s": R("stddev_samp", "close", 20), "hi": f"coalesce({R('max', 'high', 20)}, high)", "lo": f"coalesce({R('min', 'low', 20)}, low)",
     "rm": R("avg", "ret", 20), "rs": R("stddev_samp", "ret", 20), "n_ret": f"count(ret) {over(19)}", "sz": "high - low"},
    {"momentum_5": f"{div('close', lag('close', 5))} - 1", "momentum_10": f"{div('close', lag('close', 10))} - 1", "rsi": f"coalesce(100 - 100 / (1 + {div(R('avg', 'g', 14), R('avg', 'l', 14))}), 100)",
     "short_rsi": f"coalesce(100 - 100 / (1 + {div(R('avg', 'g', 5, 1), R('avg', 'l', 5, 1))}), 50)", "bb_position": "CASE WHEN s = 0 THEN 0.5 ELSE (close - m + 2 * s) / (4 * s) END::DOUBLE",
     "volume_ratio": f"coalesce({div('volume', R('avg', 'volume', 20))}, 1)::DOUBLE", "volatility_10": f"coalesce({R('stddev_samp', 'ret', 10)}, 0)", "volatility_20": f"coalesce({R('stddev_samp', 'ret', 20, 10)}, 0)",
     "price_position": f"coalesce({div('close - lo', 'hi - lo')}, 0.5)::DOUBLE", "bb_width": "CASE WHEN n_ret < 10 THEN 0.1 WHEN rm > 0 THEN 4 * rs / rm ELSE 0 END::DOUBLE"},
    {"ratio": "CASE WHEN volatility_20 > 0 THEN volatility_10 / volatility_20 ELSE 1 END::DOUBLE", "top": f"max(high) {over(20, -1)}", "bottom": f"min(low) {over(20, -1)}", "htop": f"max(high) {over(15, -1)}", "hbottom": f"min(low) {over(15, -1)}",
     "progress": f"abs({div('close', lag('close', 4))} - 1)", "wide": f"({R('max', 'high', 10)} - {R('min', 'low', 10)}) / close", "before": f"CASE WHEN count(high) {over(9, -1)} = 9 THEN max(high) {over(9, -1)} END",
     "rbefore": f"CASE WHEN count(short_rsi) {over(10, -1)} >= 2 THEN max(short_rsi) {over(10, -1)} END", "msz": R("avg", "sz", 20)},
    source="x1",
)}"""  # fmt: skip
_EDGE = "(bb_position < 0.2::DOUBLE OR bb_position > 0.8::DOUBLE)"
_BUSY = "volume_ratio > 1.5::DOUBLE"
_RULES = dict(zip(D.SETUPS, (
    "momentum_10 > 0.02::DOUBLE AND bb_position > 0.3::DOUBLE AND bb_position < 0.7::DOUBLE AND rsi > 40 AND rsi < 70",
    f"(rsi > 70 OR bb_position > 0.8::DOUBLE) AND momentum_5 < 0 AND {_BUSY}",
    f"{_EDGE} AND volatility_20 < 0.02::DOUBLE AND abs(momentum_10) < 0.01::DOUBLE",
    f"((close > top AND momentum_5 > 0.01::DOUBLE) OR (close < bottom AND momentum_5 < -0.01::DOUBLE)) AND {_BUSY}",
    f"{_EDGE} AND abs(momentum_5) < 0.005::DOUBLE",
    "bb_width < 0.05::DOUBLE AND ratio < 0.8::DOUBLE",
    f"ratio > 1.5::DOUBLE AND {_BUSY}",
    "abs(momentum_5) > 0.02::DOUBLE AND volatility_10 < 0.02::DOUBLE",
    "bb_width < 0.03::DOUBLE",
    "price_position > 0.3::DOUBLE AND price_position < 0.7::DOUBLE AND bb_width < 0.05::DOUBLE",
    "(rsi > 60 OR rsi < 40) AND abs(macd_hist) > 0.001::DOUBLE AND abs(momentum_5) > 0.01::DOUBLE",
    f"{_BUSY} AND progress < 0.001::DOUBLE AND momentum_5 > 0",
    f"{_BUSY} AND progress < 0.001::DOUBLE AND momentum_5 < 0",
    "low < hbottom AND close > hbottom AND volume_ratio > 2",
    "high > htop AND close < htop AND volume_ratio > 2",
    "volume_ratio > 3 AND sz > 2 * msz AND wide < 0.02::DOUBLE",
    "high > before AND short_rsi < rbefore",
), strict=True))
_FLAGS = {k: f"coalesce(({v})::INT, 0)" for k, v in _RULES.items()}
_SURE = dict(zip(D.CONFIDENCES, (
    "CASE WHEN strong_trend_continuation = 1 THEN least(10 * abs(momentum_10), 1) ELSE 0 END", "CASE WHEN exhaustion_reversal = 1 THEN least((rsi - 70) / 30, 1) ELSE 0 END",
    "CASE WHEN range_mean_reversion = 1 THEN least(2 * abs(bb_position - 0.5), 1) ELSE 0 END", "CASE WHEN breakout_success = 1 THEN least(volume_ratio / 2, 1) ELSE 0 END", "least(ratio, 1)",
), strict=True))
_LABELLED = f"{_SETUP}, fl AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _FLAGS.items())} FROM s4), z AS (SELECT symbol, ts, {', '.join(D.SETUPS)}, {', '.join(f'round({v}, 6) AS {k}' for k, v in _SURE.items())} FROM fl)"
_FEATURES = ("momentum_5", "momentum_10", "rsi", "bb_position", "bb_width", "volume_ratio", "volatility_10", "volatility_20", "price_position", "macd_hist")


@query(f"{_SETUP} SELECT symbol, ts, {', '.join(f'round({c}, 5) AS {c}' for c in _FEATURES)}, round(ratio, 5) AS volatility_ratio FROM s4")
def setup_features(spark, sf):
    return out(D.setup_features(hourly(spark, sf)), *_FEATURES, "volatility_ratio", digits=5)


@query(f"{_LABELLED} SELECT * FROM z")
def setups(spark, sf):
    return out(D.setups(D.setup_features(hourly(spark, sf))), *D.SETUPS, *D.CONFIDENCES)


@query(f"{_LABELLED} SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
def setups_at_last_bar(spark, sf):
    return rounded(D.at_last_bar(D.setups(D.setup_features(hourly(spark, sf))), [*D.SETUPS, *D.CONFIDENCES]))


@query(f"""WITH {steps(BARS, {"f": f"volume * ({div('close', lag('close'))} - 1)"}, {"vwap": div(R("sum", "close * volume", 20), R("sum", "volume", 20)), "vpt": f"sum(f) {over(None)}", "volume_roc": f"{div('volume', lag('volume', 5))} - 1", "volume_ma_ratio": div("volume", R("avg", "volume", 20))})}
SELECT symbol, ts, {", ".join(f"round({c}, 6) AS {c}" for c in ("vwap", "vpt", "volume_roc", "volume_ma_ratio"))} FROM s2 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""")
def volume_summary(spark, sf):
    return rounded(X.volume_summary(hourly(spark, sf)))


@query(f"""WITH {steps(BARS, {"ret": f"{div('close', lag('close'))} - 1"})}, v AS (SELECT symbol, ts, {R("stddev_samp", "ret", 20)} AS v FROM (SELECT * FROM s1 WHERE ret IS NOT NULL)), l AS (SELECT symbol, arg_max(coalesce(v, 'nan'::DOUBLE), ts) AS now, count(*) AS n FROM v GROUP BY 1)
SELECT symbol, round(CASE WHEN any_value(n) >= 20 THEN avg(coalesce((v < now AND NOT isnan(now))::INT, 0)) ELSE 0.5 END, 6) AS volatility_percentile FROM v JOIN l USING (symbol) GROUP BY symbol""")
def volatility_percentile(spark, sf):
    return rounded(metrics.volatility_percentile(hourly(spark, sf).withColumn("r", E.pct("close"))))


@query(f"""WITH {BARS}, e AS (SELECT ts, symbol AS expert, least(trades / 5.0, 1)::DOUBLE AS intensity, coalesce({div('close - low', 'high - low')}, 0) AS emergence, (CASE WHEN close > open THEN 0.8 ELSE 0.4 END)::DOUBLE AS confidence, symbol = 'click' AS cur, extract(hour FROM ts) / 24.0::DOUBLE AS hazard FROM bars),
k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY intensity DESC, expert) AS n FROM e WHERE intensity >= 0.3::DOUBLE QUALIFY n <= 3),
g AS (SELECT ts, expert, least(0.7::DOUBLE * intensity + 0.3::DOUBLE * emergence, 1) * CASE WHEN cur THEN 1 - hazard ELSE 1 END AS gate, confidence * 0.5 AS q FROM k UNION ALL SELECT DISTINCT ts, 'generalist', 1 - hazard, 0.3::DOUBLE FROM e)
SELECT ts, expert, round(gate, 6) AS gate, round(coalesce(gate * q / nullif(sum(gate * q) OVER (PARTITION BY ts), 0), 0), 6) AS weight FROM g""")
def expert_weights(spark, sf):
    x = hourly(spark, sf).withColumns({
        "intensity": F.least(F.col("trades") / 5.0, F.lit(1.0)), "emergence": F.coalesce(E.div(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)), "confidence": F.when(F.col("close") > F.col("open"), 0.8).otherwise(0.4),
        "reliability": F.lit(0.5), "current": F.col("symbol") == "click", "exit_hazard": F.hour("ts") / 24.0, "generalist": F.lit(0.3),
    })
    return rounded(metrics.expert_weights(x, ["ts"], "symbol", least=0.3))


@query(f"""WITH {_RET}, p AS (SELECT symbol, ts, CASE WHEN up = next_up THEN 0.01::DOUBLE ELSE -0.01::DOUBLE END AS pnl FROM rt WHERE intensity >= 0.6), c AS (SELECT *, sum(pnl) {over(None)} AS cumulative FROM p)
SELECT symbol, ts, pnl, round(cumulative, 6) AS cumulative, round(greatest(max(cumulative) {over(None)}, 0) - cumulative, 6) AS drawdown FROM c""")
def prediction_curve(spark, sf):
    return rounded(metrics.prediction_curve(_returns(spark, sf), "intensity", "up", "next_up").select(*K, "pnl", "cumulative", "drawdown"))


_STATES = ("BULL", "BEAR", "SIDEWAYS")


@query(f"""WITH RECURSIVE {REGIME}, sq AS (SELECT regime AS a, {lag('regime', -1)} AS b FROM regimes), sc AS (SELECT a, {", ".join(f"count(*) FILTER (b = '{v}') / (count(*) + 1e-9::DOUBLE) AS p_next_{v}" for v in _STATES)} FROM sq WHERE b IS NOT NULL GROUP BY 1)
SELECT symbol, ts, regime, {", ".join(f"round(coalesce(p_next_{v}, 0), 6) AS p_next_{v}" for v in _STATES)} FROM regimes LEFT JOIN sc ON a = regime""")
def regime_next_probabilities(spark, sf):
    return rounded(regimes.next_probabilities(_regimes(spark, sf), list(_STATES)).select(*K, "regime", *[f"p_next_{v}" for v in _STATES]))
