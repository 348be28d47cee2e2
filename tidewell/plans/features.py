"""Queries of derived features, joins by hour, timeframe scans, weights and model stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import expr as E
from tidewell.operators import align, bars as B, clean, events as V, features as X, indicators as I, labels as L, profile, regimes, select
from tidewell.plans.analysis import _ML, _returns, _scores
from tidewell.plans.base import BARS, OHLC, R, TRADES, W, div, hourly, lag, over, pick, query, rounded, steps
from tidewell.plans.series import K, out
from tidewell.sources.schemas import trades


@query(f"WITH {TRADES} " + " UNION ALL ".join(f"SELECT '{n}' AS timeframe, symbol, count(*) AS bars, round(avg(high - low), 6) AS mean_range, round(max(volume), 6) AS top_volume FROM (SELECT symbol, time_bucket(INTERVAL {i}, ts) AS ts, {OHLC} FROM trades GROUP BY symbol, time_bucket(INTERVAL {i}, ts)) GROUP BY symbol" for n, i in (("5m", "5 minutes"), ("15m", "15 minutes"), ("1h", "1 hour"))))
def timeframe_scan(spark, sf):
    parts = [B.trades_to_bars(trades(spark, sf), n).groupBy("symbol").agg(F.count("*").alias("bars"), F.avg(F.col("high") - F.col("low")).alias("mean_range"), F.max("volume").alias("top_volume")).withColumn("timeframe", F.lit(n)) for n in ("5m", "15m", "1h")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(f"WITH {BARS}, h AS (SELECT symbol, ts, CASE WHEN close > open THEN 'UP' ELSE 'DOWN' END AS regime FROM bars WHERE extract(hour FROM ts) % 2 = 0) SELECT t.trade_id, t.symbol, coalesce(h.regime, 'SIDEWAYS') AS regime FROM trades t LEFT JOIN h ON h.symbol = t.symbol AND h.ts = date_trunc('hour', t.ts)")
def hour_regime_left_join(spark, sf):
    t = trades(spark, sf)
    h = B.trades_to_bars(t, "1h").where(F.hour("ts") % 2 == 0).select("symbol", F.col("ts").alias("hour"), F.when(F.col("close") > F.col("open"), "UP").otherwise("DOWN").alias("regime"))
    return t.withColumn("hour", B.bucket("ts", "1h")).join(h, ["symbol", "hour"], "left").select("trade_id", "symbol", F.coalesce("regime", F.lit("SIDEWAYS")).alias("regime"))


@query(f"WITH {BARS} " + pick({"distance": "least(abs(close - 50), abs(close - 100), abs(close - 250)) / close"}, "bars"))
def nearest_level_distance(spark, sf):
    return rounded(hourly(spark, sf).select(*K, align.nearest_level(None, [50, 100, 250]).alias("distance")))


@query(f"WITH {steps(BARS, {'r': f'{div("close", lag("close"))} - 1'})} " + pick({"pct_change": "coalesce(r, 0)", "log_return": "coalesce(ln(r + 1), 0)"}, "s1"))
def safe_returns(spark, sf):
    return out(X.safe_returns(hourly(spark, sf)), "pct_change", "log_return")


@query(f"WITH {steps(BARS, {'i': f'(row_number() {W} - 1)::DOUBLE', 'l': lag('close'), 's': R('stddev_samp', 'close', 20)})} SELECT symbol, round(regr_slope(close, i), 6) AS slope, round(corr(close, l), 6) AS autocorrelation, round(arg_max(s, i) FILTER (s IS NOT NULL) / arg_min(s, i) FILTER (s IS NOT NULL), 6) AS deviation_ratio FROM s1 GROUP BY 1")
def stationarity_test(spark, sf):
    return rounded(X.stationarity(hourly(spark, sf), "close"))


_IX = {f"{p}_x_{t}": f"{p} * {t}" for p in ("r", "body") for t in ("volume",)} | {f"{p}_over_volume": div(p, "volume") for p in ("r", "body")} | {f"{p}_if_volume": f"CASE WHEN {p} > 0 AND volume > 0 THEN 2.0 * {p} ELSE {p} END" for p in ("r", "body")}


@query(f"WITH {steps(BARS, {'r': f'{div("close", lag("close"))} - 1', 'body': 'close - open'})} " + pick(_IX, "s1"))
def feature_interactions(spark, sf):
    x = hourly(spark, sf).withColumns({"r": E.pct("close"), "body": F.col("close") - F.col("open")})
    return out(X.interactions(x, ["r", "body"], ["volume"]), *_IX)


@query(f"WITH {BARS}, l AS (SELECT symbol, arg_max(open, ts) AS open, arg_max(close, ts) AS close, arg_max(volume, ts) AS volume FROM bars GROUP BY 1), u AS (UNPIVOT l ON open, close, volume INTO NAME feature VALUE value) SELECT symbol, feature, value FROM u QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY abs(value) DESC, feature) <= 2")
def strongest_features(spark, sf):
    return X.strongest(hourly(spark, sf), ["open", "close", "volume"], 2)


@query(f"WITH {steps(BARS, {'p': f'({lag("high")} + {lag("low")} + {lag("close")}) / 3'})} " + pick({"support": R("min", "low", 20, 1), "resistance": R("max", "high", 20, 1), "pivot_r1": f"2 * p - {lag('low')}", "pivot_s1": f"2 * p - {lag('high')}", "momentum_n": f"close - {lag('close', 20)}"}, "s1"))
def supports_and_pivots(spark, sf):
    return out(X.supports(hourly(spark, sf)), "support", "resistance", "pivot_r1", "pivot_s1", "momentum_n")


_4H = f"f AS (SELECT symbol, time_bucket(INTERVAL 4 hours, ts) AS ts, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, time_bucket(INTERVAL 4 hours, ts)), f1 AS (SELECT *, {div('close', lag('close'))} - 1 AS r FROM f), f2 AS (SELECT symbol, ts + INTERVAL 4 hours AS ts, r, {R('stddev_samp', 'r', 20, 2)} AS v, {div('volume', R('avg', 'volume', 20, 1))} AS q FROM f1)"


@query(f"WITH {BARS}, {_4H} SELECT b.symbol, b.ts, round(r, 6) AS \"4h_change\", round(v, 6) AS \"4h_volatility\", round(q, 6) AS \"4h_volume_ratio\" FROM bars b ASOF LEFT JOIN f2 ON f2.symbol = b.symbol AND b.ts >= f2.ts")
def multi_timeframe_features(spark, sf):
    return out(X.multi_timeframe(hourly(spark, sf), {"4h": "4 hours"}), "4h_change", "4h_volatility", "4h_volume_ratio")


@query(f"WITH {steps(BARS, {'a': f'list(volume) {over(None)}'})} SELECT symbol, ts, round(len(list_filter(a, lambda v: v <= volume))::DOUBLE / len(a), 6) AS volume_rank, round((least(greatest((trades - 1) / 4.0, 0), 1) + len(list_filter(a, lambda v: v <= volume))::DOUBLE / len(a)) / 2, 6) AS intensity FROM s1")
def label_intensity(spark, sf):
    return out(X.intensity(X.expanding_rank(hourly(spark, sf), "volume"), {"trades": (1, 5)}, ["volume_rank"]), "volume_rank", "intensity")


@query(f"WITH {BARS}, w AS (SELECT symbol, ts, least(trades / 5.0, 1)::DOUBLE * (CASE WHEN close > open THEN 0.8 ELSE 0.4 END)::DOUBLE * 0.5 AS w FROM bars) SELECT symbol, ts, round(coalesce(w / nullif(sum(w) OVER (PARTITION BY ts), 0), 0), 6) AS weight FROM w")
def label_weights(spark, sf):
    x = hourly(spark, sf).withColumns({"intensity": F.least(F.col("trades") / 5.0, F.lit(1.0)), "confidence": F.when(F.col("close") > F.col("open"), 0.8).otherwise(0.4), "reliability": F.lit(0.5)})
    return out(X.label_weights(x, ["ts"]), "weight")


@query(f"WITH {BARS}, s AS (SELECT *, CASE WHEN close > open THEN 'UP' ELSE 'DOWN' END AS state FROM bars) SELECT state, round(median(volume), 6) AS volume_median, round(median(high - low), 6) AS spread_median FROM s GROUP BY 1")
def state_medians(spark, sf):
    x = hourly(spark, sf).withColumns({"state": F.when(F.col("close") > F.col("open"), "UP").otherwise("DOWN"), "spread": F.col("high") - F.col("low")})
    return rounded(X.state_medians(x, "state", ["volume", "spread"]))


@query(f"WITH {BARS}, c AS (SELECT symbol, ts, 'dir:' || CASE WHEN close > open THEN 'UP' ELSE 'DOWN' END || '|act:' || least(trades, 6)::VARCHAR AS combination FROM bars), f AS (SELECT combination FROM c GROUP BY 1 HAVING count(*) >= 0.05::DOUBLE * (SELECT count(*) FROM c)) SELECT symbol, ts, combination FROM c SEMI JOIN f USING (combination)")
def frequent_combinations(spark, sf):
    x = hourly(spark, sf).withColumns({"dir": F.when(F.col("close") > F.col("open"), "UP").otherwise("DOWN"), "act": F.least(F.col("trades"), F.lit(6))})
    return regimes.combination_key(x, ["dir", "act"], 0.05).select(*K, "combination")


@query(f"WITH {BARS}, s AS (SELECT symbol, avg(volume) AS v FROM bars GROUP BY 1), p AS (SELECT symbol, percent_rank() OVER (ORDER BY v) AS r FROM s) SELECT symbol, CASE WHEN r < 1 / 3.0::DOUBLE THEN 'low' WHEN r < 2 / 3.0::DOUBLE THEN 'mid' ELSE 'high' END AS state_name FROM p")
def state_names(spark, sf):
    return regimes.state_names(hourly(spark, sf).groupBy("symbol").agg(F.avg("volume").alias("v")), "v").select("symbol", "state_name")


@query(f"WITH {BARS} SELECT symbol, count(*) AS n_rows, sum(CASE WHEN volume > 20 THEN 1 ELSE 0 END)::BIGINT AS n_null, count(*) - count(DISTINCT ts) AS n_repeated, round(count(DISTINCT ts) / (date_diff('hour', min(ts), max(ts)) + 1), 6) AS coverage FROM bars GROUP BY 1")
def data_quality(spark, sf):
    return rounded(X.data_quality(hourly(spark, sf).withColumn("volume", F.when(F.col("volume") <= 20, F.col("volume")))))


@query(f"WITH RECURSIVE {_ML}, k AS (SELECT symbol, ts, breakout_success, momentum_ignition FROM meta) SELECT symbol, sum(breakout_success)::BIGINT AS breakouts, sum(momentum_ignition)::BIGINT AS ignitions FROM k GROUP BY 1")
def meta_label_counts(spark, sf):
    return L.meta_labels(hourly(spark, sf)).groupBy("symbol").agg(F.sum("breakout_success").alias("breakouts"), F.sum("momentum_ignition").alias("ignitions"))


@query()
def meta_labels_on_base_bars(spark, sf):
    return L.meta_labels_on_base(hourly(spark, sf), "4h", "4 hours").select(*K, *L.META_LABELS)


@query()
def gaussian_states(spark, sf):
    x = hourly(spark, sf).withColumn("spread", F.col("high") - F.col("low"))
    return X.gaussian_states(x, ["volume", "spread"], 3).select(*K, "state")


@query()
def feature_importance(spark, sf):
    x = _returns(spark, sf)
    got = X.importance(x.na.fill(0.0, ["r"]).withColumn("y", F.col("next_up").cast("double")), ["r", "volume", "intensity"], "y")
    return spark.createDataFrame([(c, round(v, 6)) for c, v in got], "feature string, importance double")


@query(f"WITH {BARS}, s AS (SELECT symbol, ts, strength, activity FROM (SELECT symbol, ts, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0 END AS strength, least(trades / 5.0, 1)::DOUBLE AS activity FROM bars)) SELECT symbol, ts, (strength >= 0.8)::INT AS a, (activity >= 0.6)::INT AS b FROM s")
def multi_hot_labels(spark, sf):
    x = _scores(spark, sf)
    on = F.array_compact(F.array(F.when(F.col("strength") >= 0.8, F.lit("strength")), F.when(F.col("activity") >= 0.6, F.lit("activity"))))
    hot = V.multi_hot(F.lit(""), on, ["strength", "activity"])
    return x.withColumn("h", hot).select(*K, F.get("h", 0).alias("a"), F.get("h", 1).alias("b"))
