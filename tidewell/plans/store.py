"""Round trips through sources and sinks, and cleaning, joins and splits on whole tables.

What a query writes lies in a folder of its own under the shared one; results are read back from there.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewell.functions import expr as E
from tidewell.operators import align, clean, events as V, features as X, indicators as I, labels as L, select
from tidewell.plans.base import BARS, R, TRADES, W, div, hourly, lag, over, pick, query, rounded, steps
from tidewell.plans.series import K, out
from tidewell.session import fresh_folder
from tidewell.sources import datasets, history, schemas
from tidewell.sources.schemas import trades

_KL = f"{BARS}, kl AS (SELECT symbol, epoch_ms(ts) AS \"timestamp\", open, high, low, close, volume, trades FROM bars)"
_DAY = "year(make_timestamp(\"timestamp\" * 1000)) AS year, month(make_timestamp(\"timestamp\" * 1000)) AS month, day(make_timestamp(\"timestamp\" * 1000)) AS day"


def _klines(spark, sf):
    return hourly(spark, sf).select("symbol", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), "open", "high", "low", "close", "volume", "trades")


def _stored(spark, sf) -> str:
    base = fresh_folder(spark, "klines")
    datasets.write_daily(clean.add_constants(_klines(spark, sf), exchange="X", timeframe="1h"), base)
    return base


_SPAN = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20, 12)


@query(f"WITH {_KL} SELECT \"timestamp\", symbol, close, volume FROM kl WHERE \"timestamp\" BETWEEN epoch_ms(TIMESTAMP '2024-01-10') AND epoch_ms(TIMESTAMP '2024-01-20 12:00:00') AND symbol IN ('click', 'view') AND volume >= 5")
def dataset_daily_scan(spark, sf):
    wanted = [("symbol", "in", ["click", "view"]), ("volume", ">=", 5)]
    return datasets.scan(spark, _stored(spark, sf), ["timestamp", "symbol", "close", "volume"], wanted, *_SPAN)


@query(f"WITH {_KL} SELECT \"timestamp\", close FROM kl WHERE symbol = 'click'")
def dataset_symbol_scan(spark, sf):
    return datasets.scan_symbol(spark, _stored(spark, sf), "X", "click", "1h", columns=["timestamp", "close"])


@query(f"WITH {_KL} SELECT least(count(*), 100) AS n, count(*) > 100 AS more FROM kl")
def dataset_row_cap(spark, sf):
    base = _stored(spark, sf)
    some, every = datasets.scan(spark, base, most=100).agg(F.count("*").alias("n")), spark.read.parquet(base).agg((F.count("*") > 100).alias("more"))
    return some.crossJoin(F.broadcast(every))  # a row each


@query(f"WITH {_KL}, d AS (SELECT symbol, {_DAY} FROM kl) SELECT symbol, month::INT AS month, count(DISTINCT day) AS files, count(*) AS rows FROM d GROUP BY 1, 2")
def dataset_partitions(spark, sf):
    return datasets.partitions(spark, _stored(spark, sf), ["symbol", "month"])


@query(f"WITH {_KL}, d AS (SELECT symbol, {_DAY} FROM kl) SELECT count(*) AS rows, count(DISTINCT (symbol, year, month, day)) AS files, true AS has_bytes FROM d")
def dataset_size(spark, sf):
    return datasets.size_estimate(spark, _stored(spark, sf)).select("rows", "files", (F.col("bytes") > 0).alias("has_bytes"))


@query(f"WITH {_KL}, d AS (SELECT symbol, {_DAY}, \"timestamp\" AS t FROM kl) SELECT count(DISTINCT (symbol, year, month, day)) AS file_count, count(*) AS rows, min(t) AS first_timestamp, max(t) AS latest_timestamp FROM d")
def dataset_manifest(spark, sf):
    base = _stored(spark, sf)
    datasets.manifest(spark, base)
    kept = datasets.read_manifest(spark, base)
    return spark.createDataFrame([tuple(kept[c] for c in ("file_count", "rows", "first_timestamp", "latest_timestamp"))], "file_count long, rows long, first_timestamp long, latest_timestamp long")


@query(f"WITH {_KL}, d AS (SELECT symbol, {_DAY} FROM kl) SELECT symbol, month::INT AS month, 2 * count(*) AS rows, 1 AS files FROM d GROUP BY 1, 2")
def dataset_compaction(spark, sf):
    base, rows = fresh_folder(spark, "pieces"), clean.add_date_parts(_klines(spark, sf)).drop("day")
    for _ in range(2):
        rows.write.mode("append").partitionBy("symbol", "year", "month").parquet(base)
    done = datasets.compact(spark, base, ["symbol", "year", "month"])
    return datasets.partitions(spark, done, ["symbol", "month"]).withColumn("files", F.col("files").cast("int"))


@query(f"WITH {_KL} SELECT \"timestamp\", close, 2::BIGINT AS reads FROM kl WHERE symbol = 'view'")
def dataset_cached_projection(spark, sf):
    base, cache = _stored(spark, sf), fresh_folder(spark, "cache")
    ask = lambda: datasets.cached_projection(spark, base, cache, ["timestamp", "close"], [("symbol", "==", "view")], ttl=3600)
    first, again = ask(), ask()  # the second comes from the cache
    n = F.when(F.lit(first.inputFiles() == again.inputFiles()), 2).otherwise(1).cast("long")
    return again.withColumn("reads", n)


@query(f"WITH {_KL}, d AS (SELECT symbol, {_DAY} FROM kl) SELECT 'X' AS exchange, symbol, month::INT AS month, count(*) AS n FROM d GROUP BY 2, 3")
def dataset_flat_migration(spark, sf):
    flat, base = fresh_folder(spark, "flat"), fresh_folder(spark, "moved")
    datasets.write_flat(_klines(spark, sf), flat, 2)
    datasets.migrate_flat(spark, flat, base, exchange="X")
    return spark.read.parquet(base).groupBy("exchange", "symbol", "month").agg(F.count("*").alias("n"))


@query(f"WITH {_KL} SELECT symbol, count(*) AS n FROM kl GROUP BY 1")
def dataset_incremental_append(spark, sf):
    base, rows = fresh_folder(spark, "grown"), _klines(spark, sf)
    for s in (True, False):
        datasets.append(rows.where((F.col("symbol") == "click") == s), base)
    return spark.read.parquet(base).groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"WITH {_KL} SELECT symbol, count(*) AS n FROM kl GROUP BY 1")
def dataset_first_available(spark, sf):
    base = _stored(spark, sf)
    return datasets.first_available(spark, [f"{base}-gone", base]).groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"WITH {_KL} SELECT symbol, count(*) AS n FROM kl GROUP BY 1")
def dataset_repair(spark, sf):
    base, rows = fresh_folder(spark, "broken"), _klines(spark, sf)
    rows.write.parquet(base)
    rows.limit(50).write.mode("append").parquet(base)  # repeated rows
    rows.withColumn("timestamp", F.lit(None).cast("long")).write.mode("append").parquet(base)  # rows without a key
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/part-torn.parquet")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    stream.writeBytes("torn")
    stream.close()
    return datasets.repair(spark, base, fresh_folder(spark, "repaired"), ["symbol", "timestamp"]).groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"WITH {_KL} SELECT count(*) AS rows, 0::BIGINT AS close_missing, count(*) AS funding_missing FROM kl")
def file_validation(spark, sf):
    base = fresh_folder(spark, "valid")
    datasets.write_flat(_klines(spark, sf), base)
    return datasets.validate_files(spark, base, ["close", "funding"]).select("rows", "close_missing", "funding_missing")


@query(f"WITH {_KL}, d AS (SELECT symbol, {_DAY} FROM kl) SELECT day::INT AS day, count(*) AS n FROM d WHERE month = 1 AND day BETWEEN 8 AND 14 GROUP BY 1")
def file_date_window(spark, sf):
    base = fresh_folder(spark, "dated")
    x = clean.add_date_parts(_klines(spark, sf)).withColumn("date", F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd"))
    datasets.write_partitioned(x, base, ["date"])
    return datasets.date_window(spark.read.parquet(base), dt.date(2024, 1, 16), 6, 2).groupBy("day").agg(F.count("*").alias("n")).withColumn("day", F.col("day").cast("int"))


@query(f"WITH {_KL} SELECT \"timestamp\", close, volume FROM kl WHERE symbol = 'click'")
def csv_klines(spark, sf):
    base = fresh_folder(spark, "csv")
    x = _klines(spark, sf).where("symbol = 'click'").select("timestamp", "close", "volume").repartition(1).sortWithinPartitions("timestamp")
    odd = x.limit(3).withColumn("close", F.lit("no number")).unionByName(x.limit(3).withColumn("timestamp", F.lit(None).cast("long")).withColumn("close", F.col("close").cast("string")))
    x.withColumn("close", F.col("close").cast("string")).unionByName(odd).coalesce(1).write.option("header", "true").csv(base)
    return datasets.read_csv(spark, base, "timestamp long, close double, volume double", {"positive": "close > 0 AND (volume IS NULL OR volume >= 0)"})


@query(f"WITH {TRADES} SELECT trade_id, price, is_buyer_maker FROM trades")
def csv_trades(spark, sf):
    base = fresh_folder(spark, "csv")
    t = trades(spark, sf).select("trade_id", "price", "is_buyer_maker")
    t.unionByName(t.where("trade_id < 50")).write.option("header", "true").csv(base)
    return datasets.read_csv(spark, base, "trade_id long, price double, is_buyer_maker boolean", {"price": "price >= 0"}, key="trade_id")


@query(f"WITH {TRADES}, h AS (SELECT DISTINCT time_bucket(INTERVAL 8 hours, ts) AS t FROM trades) SELECT epoch_ms(t) AS \"timestamp\", (epoch_ms(t) // 3600000 % 24 - 8) / 10000.0::DOUBLE AS \"fundingRate\" FROM h")
def csv_futures(spark, sf):
    base = fresh_folder(spark, "csv")
    t = trades(spark, sf).select(F.unix_millis(F.window(F.col("ts").cast("timestamp"), "8 hours")["start"]).alias("timestamp")).distinct()
    t = t.withColumn("fundingRate", (F.floor(F.col("timestamp") / 3600000) % 24 - 8) / 10000.0)
    t.write.option("header", "true").csv(base)
    return datasets.read_csv(spark, base, "timestamp long, fundingRate double", {"rate": "abs(fundingRate) < 0.05"})


@query(f"WITH {BARS} SELECT symbol, count(*) AS n, round(max(close), 6) AS top FROM bars GROUP BY 1")
def report_json(spark, sf):
    base = fresh_folder(spark, "report")
    x = hourly(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.max("close"), 6).alias("top"))
    datasets.write_report(x, base)
    return spark.read.schema(x.schema).json(base)


@query(f"WITH {BARS} SELECT symbol, count(*) AS stats_n, round(max(close), 6) AS stats_top FROM bars GROUP BY 1")
def report_csv(spark, sf):
    base = fresh_folder(spark, "report")
    x = hourly(spark, sf).groupBy("symbol").agg(F.struct(F.count("*").alias("n"), F.round(F.max("close"), 6).alias("top")).alias("stats"))
    datasets.write_report(x, base, "csv")
    return spark.read.option("header", "true").schema("symbol string, stats_n long, stats_top double").csv(base)


@query(f"WITH {TRADES} SELECT epoch_us(ts) // 1000 AS \"timestamp\", price, coalesce(quantity, 0) AS quantity, trade_id AS agg_trade_id, is_buyer_maker FROM trades")
def wire_trades(spark, sf):
    t = trades(spark, sf).select(F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("T"), F.col("price").cast("string").alias("p"), F.coalesce("quantity", F.lit(0.0)).cast("string").alias("q"), F.col("trade_id").alias("a"), F.col("is_buyer_maker").alias("m"))).alias("value"))
    return schemas.from_trade_messages(t).select("timestamp", "price", "quantity", "agg_trade_id", "is_buyer_maker")


@query("SELECT t AS \"timestamp\", 100.0::DOUBLE + (t // 60000) % 7 AS price FROM range(1704067200000, 1704153600000, 60000) r(t)")
def paged_history(spark, sf):
    spark.dataSource.register(history.HistorySource)
    read = spark.read.format("paged_history").options(start=1704067200000, end=1704153600000, window=6 * 3600 * 1000, limit=100, pages="tidewell.sources.history:even_prices")
    return read.option("schema", "timestamp long, price double").load()


@query(f"WITH {BARS} SELECT symbol, ts, close - open AS body FROM bars")
def arrow_transform(spark, sf):
    def body(t):
        import pyarrow.compute as pc

        return t.select(["symbol", "ts"]).append_column("body", pc.subtract(t["close"], t["open"]))

    return datasets.transformed(hourly(spark, sf).select("symbol", "ts", "open", "close"), body, "symbol string, ts timestamp_ntz, body double")


@query(f"WITH {BARS} SELECT symbol, ts, close, trades FROM bars")
def schema_checked(spark, sf):
    return datasets.checked("symbol string, ts timestamp_ntz, close double, trades long")(hourly)(spark, sf)


# cleaning


@query(f"WITH {BARS} SELECT symbol, ts, close, 'X' AS exchange, 0.5::DOUBLE AS fee FROM bars")
def canonical_and_constant_columns(spark, sf):
    x = hourly(spark, sf).select("symbol", "ts", F.col("close").alias("CLOSE"))
    return clean.add_constants(clean.canonical_columns(x), exchange="X", fee=0.5)


@query(f"WITH {_KL} SELECT symbol, \"timestamp\", {_DAY} FROM kl")
def date_parts(spark, sf):
    x = clean.add_date_parts(_klines(spark, sf).select("symbol", "timestamp"))
    return x.withColumns({c: F.col(c).cast("long") for c in ("year", "month", "day")})


@query(f"WITH {BARS} SELECT close, high - low AS spread FROM bars")
def leakage_guard(spark, sf):
    x = hourly(spark, sf).withColumns({"spread": F.col("high") - F.col("low"), "meta_a": F.lit(1), "name": F.lit("x")})
    x = clean.drop_named(clean.drop_non_numeric(x), prefixes=["meta_"])
    return clean.drop_baseline(x, ["open", "high", "low", "close", "volume", "trades"], label="close")


@query(f"WITH {BARS} SELECT symbol, ts, open, close FROM bars")
def repeated_columns(spark, sf):
    b = hourly(spark, sf)
    return clean.drop_repeated_columns(b.select("symbol", "ts", "open", "close", F.col("high").alias("open"), F.lit(1).alias("ts")))


@query(f"WITH {BARS} SELECT symbol, ts, least(greatest(close - 50, 0), 100) AS rsi_x, least(greatest(volume / 10, 0), 10) AS a_ratio, least(greatest((high - low) / 100, 0), 1) AS volatility, close FROM bars")
def clip_by_name(spark, sf):
    c = F.col
    return clean.clip_by_name(hourly(spark, sf).select(*K, (c("close") - 50).alias("rsi_x"), (c("volume") / 10).alias("a_ratio"), ((c("high") - c("low")) / 100).alias("volatility"), "close"))


_ODD = "CASE WHEN trades % 3 = 0 THEN NULL WHEN trades % 5 = 0 THEN 'inf'::DOUBLE ELSE close END"


def _odd(spark, sf):
    n = F.col("trades")
    return hourly(spark, sf).withColumn("x", F.when(n % 3 == 0, F.lit(None).cast("double")).when(n % 5 == 0, F.lit(float("inf"))).otherwise(F.col("close")))


@query(f"WITH {BARS}, o AS (SELECT symbol, ts, nullif({_ODD}, 'inf'::DOUBLE) AS x FROM bars) SELECT symbol, ts, coalesce(last(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts), first(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS x FROM o")
def repair_by_filling(spark, sf):
    return clean.repair_series(_odd(spark, sf), ["x"]).select(*K, "x")


@query(f"WITH {BARS}, o AS (SELECT {_ODD} AS x, close FROM bars) SELECT 'x' AS \"column\", count(*) FILTER (x IS NULL) AS missing, count(*) FILTER (x = 'inf'::DOUBLE) AS infinite FROM o UNION ALL SELECT 'close', 0, 0")
def value_audit(spark, sf):
    return clean.audit(_odd(spark, sf), ["x", "close"])[1]


@query(f"WITH {BARS}, o AS (SELECT symbol, ts, {_ODD} AS x FROM bars) SELECT symbol, ts, CASE WHEN x IS NULL OR x = 'inf'::DOUBLE THEN -1 ELSE x END AS x FROM o")
def value_audit_filled(spark, sf):
    return clean.audit(_odd(spark, sf), ["x"], "fill", -1.0)[0].select(*K, "x")


@query(f"WITH {BARS} SELECT symbol, ts, ts AS open_time, ts + INTERVAL 1 hour AS close_time, CASE WHEN symbol = 'click' THEN 0 ELSE volume END AS volume FROM bars")
def chunk_repair(spark, sf):
    x = hourly(spark, sf).withColumn("volume", F.when(F.col("symbol") != "click", F.col("volume")))
    return clean.repair_klines(x).select(*K, "open_time", "close_time", "volume")


@query(f"WITH {BARS}, o AS (SELECT symbol, ts, CASE WHEN trades > 1 THEN close END AS price, CASE WHEN trades > 1 THEN volume END AS volume, CASE WHEN trades > 1 THEN close / open END AS close_ratio FROM bars) SELECT symbol, ts, last(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS price, coalesce(volume, 0) AS volume, coalesce(close_ratio, 1) AS close_ratio FROM o")
def typed_fill(spark, sf):
    on = lambda c: F.when(F.col("trades") > 1, c)
    return clean.fill_typed(hourly(spark, sf).select(*K, on(F.col("close")).alias("price"), on(F.col("volume")).alias("volume"), on(F.col("close") / F.col("open")).alias("close_ratio")))


# joins and sets


@query(f"WITH {BARS}, w AS (SELECT symbol, ts, trades / 2.0::DOUBLE AS sample_weight FROM bars WHERE trades >= 3) SELECT b.symbol, b.ts, coalesce(w.sample_weight, 1) AS sample_weight FROM bars b LEFT JOIN w USING (symbol, ts)")
def sample_weights_left_join(spark, sf):
    b = hourly(spark, sf)
    return align.with_weights(b.select(*K), b.where("trades >= 3").withColumn("sample_weight", F.col("trades") / 2.0), K)


@query(f"WITH {BARS}, e AS (SELECT symbol, ts, close * 2 AS code FROM bars WHERE trades % 2 = 0) SELECT b.symbol, b.ts, b.volume, coalesce(e.code, 0) AS code FROM bars b LEFT JOIN e USING (symbol, ts)")
def index_left_join(spark, sf):
    b = hourly(spark, sf)
    return align.index_left(b.select(*K, "volume"), b.where("trades % 2 = 0").select(*K, (F.col("close") * 2).alias("code")), K)


@query(f"WITH {BARS}, a AS (SELECT symbol, ts FROM bars WHERE trades >= 2 INTERSECT SELECT symbol, ts FROM bars WHERE close > open) SELECT symbol, ts, b.close FROM bars b SEMI JOIN a USING (symbol, ts)")
def index_intersection(spark, sf):
    b = hourly(spark, sf)
    return align.on_common_index([b.where("trades >= 2").select(*K, "close"), b.where("close > open").select(*K, "open")], K)[0]


@query(f"WITH {BARS}, a AS (SELECT symbol, ts, volume FROM bars WHERE trades >= 2), c AS (SELECT symbol, ts, close FROM bars WHERE close > open) SELECT symbol, ts, a.volume AS flow_volume, c.close AS price_close FROM a FULL JOIN c USING (symbol, ts)")
def outer_feature_join(spark, sf):
    b = hourly(spark, sf)
    return align.outer_features({"flow": b.where("trades >= 2").select(*K, "volume"), "price": b.where("close > open").select(*K, "close")}, K)


# indicators, vectors and selections that had no query


@query(f"""WITH {steps(BARS, {"r": f"{div('close', lag('close'))} - 1", "lr": f"ln({div('close', lag('close'))})"}, {"v": R("stddev_samp", "r", 20), "rv": f"CASE WHEN count(r) {over(19)} >= 20 THEN sqrt(sum(r * r) {over(19)}) END", "sm": R("avg", "volume", 20)}, {"vr": div("v", R("avg", "v", 40))})}
SELECT symbol, ts, round(v, 6) AS volatility, round(rv, 6) AS realized_volatility, round(vr, 6) AS volatility_ratio, round(sm, 6) AS volume_sma, round(volume / nullif(sm, 0), 6) AS volume_ratio, round({div("volume", lag("volume", 5))} - 1, 6) AS volume_momentum FROM s3""")
def timeframe_volatility(spark, sf):
    return out(I.timeframe_set(hourly(spark, sf), "1h"), "volatility", "realized_volatility", "volatility_ratio", "volume_sma", "volume_ratio", "volume_momentum")


@query(f"""WITH {steps(BARS, {"lr": f"ln({div('close', lag('close'))})"}, {"lr20": R("stddev_samp", "lr", 20, 5), "vr": div("volume", R("avg", "volume", 20, 1)), "rr": div("high - low", "close"), "br": div("close - open", "open")})}
SELECT symbol, ts, {", ".join(f"round(coalesce(last({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts), 0), 6) AS {n}" for c, n in (("lr", "log_return"), ("lr20", "volatility_20"), ("vr", "volume_ratio"), ("rr", "range_ratio"), ("br", "body_ratio")))} FROM s2""")
def combined_features(spark, sf):
    return out(I.combined_features(hourly(spark, sf)), "log_return", "volatility_20", "volume_ratio", "range_ratio", "body_ratio")


@query(f"WITH {BARS}, l AS (SELECT symbol, arg_max(close, ts) AS close, arg_max(volume, ts) AS volume, max(ts) AS ts, arg_max(trades >= 3, ts) AS busy FROM bars GROUP BY 1) SELECT symbol, ts, close, volume, busy::INT AS busy FROM l")
def live_snapshot(spark, sf):
    return X.snapshot(hourly(spark, sf), ["close", "volume"], {"busy": F.col("trades") >= 3})


@query("SELECT vec_id, 0.0::DOUBLE AS same, 0.0::DOUBLE AS zero FROM embeddings")
def dtw_of_equal_vectors(spark, sf):
    x = schemas.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    x = x.withColumn("twice", F.flatten(F.transform("e", lambda v: F.array(v, v))))  # every step repeated costs nothing
    return V.dtw_distance(V.dtw_distance(x, "e", "e", "same"), "e", "twice", "zero").select("vec_id", "same", "zero")


@query("SELECT * FROM (VALUES ('close', 'other'), ('volume', 'liquidity'), ('rsi', 'momentum'), ('atr', 'volatility'), ('spread_x', 'microstructure')) t(feature, block) WHERE block <> 'other'")
def feature_blocks(spark, sf):
    got = select.assign_blocks(["close", "volume", "rsi", "atr", "spread_x"])
    return spark.createDataFrame([(c, b) for b, cs in got.items() for c in cs], "feature string, block string")


@query(f"WITH {BARS}, t AS (SELECT *, coalesce({div(lag('close', -5), 'close')} - 1, 0) AS r FROM bars) SELECT symbol, ts, (r > 0)::INT AS up FROM t WHERE r <> 0")
def labels_without_hold(spark, sf):
    r = F.coalesce(E.div(E.lag("close", -5), "close") - 1, F.lit(0.0))
    x = hourly(spark, sf).withColumn("label", F.signum(r).cast("int"))
    return L.drop_hold(x).select(*K, (F.col("label") > 0).cast("int").alias("up"))


@query(f"WITH {steps(BARS, {'d': 'high - low'})} " + pick({"detrended": f"ln(close) - avg(ln(close)) {over(19)}", "normalised_volume": f"(volume - avg(volume) {over(19)}) / nullif(stddev_samp(volume) {over(19)}, 0)"}, "s1"))
def detrended_and_normalised(spark, sf):
    return out(X.normalised(hourly(spark, sf)), "detrended", "normalised_volume")
