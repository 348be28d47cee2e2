"""Queries over the relational tables and streams: dedup, set operations, grouping, SQL of the side tables, streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import bars as B, clean, metrics, select
from tidewell.plans.base import OHLC, TRADES, query, rounded
from tidewell.session import fresh_folder
from tidewell.sources import datasets, schemas
from tidewell.sources.schemas import table
from tidewell.streaming import bars as S


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def dedup_keep_last(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return clean.keep_one(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def dedup_composite_keep_first(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return clean.keep_one(l, ["l_orderkey", "l_linenumber"], ["l_partkey"], last=False)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_join_new_rows(spark, sf):
    return clean.new_rows(table(spark, sf, "customer").select("c_custkey", "c_name"), table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) SELECT strftime(x, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 day)) AS x FROM d) WHERE x::DATE NOT IN (SELECT day FROM d)")
def dates_missing(spark, sf):
    have = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    want = have.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return datasets.missing_dates(have, want).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END, 0) AS price, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END, '') AS priority FROM orders")
def fill_by_type(spark, sf):
    o = table(spark, sf, "orders")
    x = o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"))
    return clean.fill_by_type(x)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(greatest(coalesce(l_extendedprice / nullif(l_discount, 0), 0), -1000), 1000), 6) AS ratio FROM lineitem")
def sanitise_ratios(spark, sf):
    l = table(spark, sf, "lineitem")
    x = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.try_divide("l_extendedprice", "l_discount").alias("ratio"))
    return rounded(clean.sanitise(x, ["ratio"]))


@query("SELECT o_custkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice >= 50000 AND o_orderstatus = 'O' AND o_custkey > 20 AND o_orderpriority <> '5-LOW' AND o_totalprice < 300000")
def scan_many_predicates(spark, sf):
    return datasets.scan(spark, f"{sf}/orders.parquet", ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"], [("o_totalprice", ">=", 50000.0), ("o_orderstatus", "==", "O"), ("o_custkey", ">", 20), ("o_orderpriority", "!=", "5-LOW"), ("o_totalprice", "<", 300000.0)])


@query("SELECT epoch_ms(o_orderdate) AS \"timestamp\", NULL::DOUBLE AS open, NULL::DOUBLE AS high, NULL::DOUBLE AS low, o_totalprice AS close, NULL::DOUBLE AS volume, o_orderkey FROM orders")
def schema_enforced(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").cast("string").alias("close"), "o_orderkey")
    return schemas.enforce(o, "klines")


@query("SELECT o_custkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_f, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 7) AS \"F\", round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 7) AS \"O\", round(avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 7) AS \"P\" FROM orders GROUP BY 1")
def pivot_long_wide(spark, sf):
    o = table(spark, sf, "orders")
    wide = datasets.pivot_fields(o, "o_custkey", "o_orderstatus", "o_totalprice", ["F", "O", "P"])
    n = o.groupBy("o_custkey").agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_f"))
    return rounded(n.join(wide, "o_custkey"), 7)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_per_group(spark, sf):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf, "orders").withColumn("n", n).where("n <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_returnflag, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY 1")
def value_counts_pct(spark, sf):
    from tidewell.operators.regimes import distribution

    return rounded(distribution(table(spark, sf, "lineitem").select("l_returnflag"), "l_returnflag"))


@query("SELECT l_partkey, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS deviation, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1 ORDER BY mean DESC, l_partkey LIMIT 20")
def grouped_mean_nlargest(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("deviation"), F.count_distinct("l_suppkey").alias("suppliers"))
    return rounded(g).orderBy(F.desc("mean"), "l_partkey").limit(20)


@query("SELECT l_returnflag, l_linestatus, l_quantity AS price, sum(l_extendedprice)::DECIMAL(38, 2)::DOUBLE AS size FROM lineitem GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY sum(l_extendedprice) DESC, l_quantity) <= 5")
def group_sum_topk(spark, sf):
    from tidewell.operators.microstructure import size_per_price

    l = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("price"), F.col("l_extendedprice").alias("qty"))
    return size_per_price(l, ["l_returnflag", "l_linestatus"], 5).drop("rank").withColumn("size", F.round("size", 2))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_custkey % 10 = 3 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def latest_trades_of_symbol(spark, sf):
    return spark.sql("SELECT o_orderkey, o_orderdate, o_totalprice FROM {o} WHERE o_custkey % 10 = 3 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25", o=table(spark, sf, "orders"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30' AND o_orderstatus IN ('O', 'P')")
def range_scan_by_time(spark, sf):
    return spark.sql("SELECT o_orderkey, o_custkey, o_totalprice FROM {o} WHERE o_orderdate BETWEEN TIMESTAMP_NTZ '1996-01-01' AND TIMESTAMP_NTZ '1996-06-30' AND o_orderstatus IN ('O', 'P')", o=table(spark, sf, "orders"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def grouped_counts_sql(spark, sf):
    return spark.sql("SELECT p_type, count(*) AS n FROM {p} GROUP BY p_type", p=table(spark, sf, "part"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, 0.0::DOUBLE FROM customer WHERE c_custkey % 50 = 0")
def upsert_latest(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(c.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit(0.0).alias("c_acctbal")))
    return datasets.upsert_latest(c, new, ["c_custkey"])


@query("SELECT segment::INT AS segment, count(*) AS n FROM (SELECT date_diff('day', (SELECT min(o_orderdate::DATE) FROM orders), o_orderdate::DATE) // 30 AS segment FROM orders) GROUP BY 1")
def time_segments(spark, sf):
    return datasets.segment(table(spark, sf, "orders").select("o_orderdate"), 30, "o_orderdate").groupBy("segment").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) AS n, round((SELECT count(*) FROM orders) / (count(DISTINCT o_orderpriority) OVER () * 1.0 * count(*)), 6) AS weight FROM orders GROUP BY 1".replace("count(DISTINCT o_orderpriority) OVER ()", "(SELECT count(DISTINCT o_orderpriority) FROM orders)"))
def class_weights(spark, sf):
    return rounded(select.class_weights(table(spark, sf, "orders").select("o_orderpriority"), "o_orderpriority"))


@query("SELECT c_custkey, c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS code FROM customer")
def label_encoded(spark, sf):
    return select.label_encode(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "code").select("c_custkey", "c_mktsegment", "code")


@query("SELECT 1 AS one, o_orderstatus, n FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)".replace("1 AS one, ", ""))
def drop_constant_columns(spark, sf):
    x = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return clean.drop_constant(x.withColumns({"one": F.lit(1), "none": F.lit(None).cast("double")}))


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '\"k\": *([0-9.]+)', 1) AS BIGINT) AS k, md5(props) AS digest FROM events")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.md5(F.col("props").cast("binary")).alias("digest"))


@query("SELECT conv_id, count(*) AS turns, count(CASE WHEN role = 'user' THEN 1 END) AS user_turns, max(turn) AS last_turn FROM conversations GROUP BY 1")
def documents_side_table(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count(F.when(F.col("role") == "user", 1)).alias("user_turns"), F.max("turn").alias("last_turn"))


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def equi_joins_with_small_sides(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    x = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))
    return x.join(n, x.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name", "customers", F.round("balance", 2).alias("balance"))


@query("SELECT l_returnflag AS symbol, date_trunc('month', l_shipdate)::TIMESTAMP AS ts, round(min(l_extendedprice / l_quantity), 6) AS low, round(max(l_extendedprice / l_quantity), 6) AS high, round(sum(l_quantity), 2) AS volume, count(*) AS trades FROM lineitem GROUP BY 1, 2")
def monthly_bars_from_lineitem(spark, sf):
    l = table(spark, sf, "lineitem")
    p = F.col("l_extendedprice") / F.col("l_quantity")
    ts = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz")
    return l.groupBy(F.col("l_returnflag").alias("symbol"), ts.alias("ts")).agg(F.round(F.min(p), 6).alias("low"), F.round(F.max(p), 6).alias("high"), F.round(F.sum("l_quantity"), 2).alias("volume"), F.count("*").alias("trades"))


# streams over the events


def _ticks(spark, sf):
    raw = table(spark, sf, "events")
    s = S.tick_stream(spark, f"{sf}/events.parquet*", raw.schema)
    x = s.select(F.col("event_id").alias("trade_id"), "ts", F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.expr("try_cast(get_json_object(props, '$.k') AS double)").alias("quantity"))
    return S.with_event_time(x)


def _table(spark, df, mode="append", latest=None):
    return S.run_to_table(df, fresh_folder(spark, "stream"), mode, latest)


_CLOSED = f"WITH {TRADES}, w AS (SELECT max(ts) - INTERVAL 10 minutes AS mark FROM trades)"


@query(f"{_CLOSED}, b AS (SELECT symbol, date_trunc('hour', ts) AS ts, {OHLC} FROM trades GROUP BY symbol, date_trunc('hour', ts)) SELECT b.* FROM b, w WHERE b.ts + INTERVAL 1 hour <= mark")
def stream_tumbling_bars(spark, sf):
    return _table(spark, S.bars(_ticks(spark, sf), "1 hour")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"{_CLOSED}, s AS (SELECT *, unnest(range(0, 4)) AS k FROM trades), b AS (SELECT symbol, time_bucket(INTERVAL 15 minutes, ts) - INTERVAL 15 minutes * k AS ts, {OHLC.replace('ORDER BY ts', 'ORDER BY s.ts')} FROM s GROUP BY symbol, time_bucket(INTERVAL 15 minutes, s.ts) - INTERVAL 15 minutes * k) SELECT b.* FROM b, w WHERE b.ts + INTERVAL 1 hour <= mark")
def stream_sliding_bars(spark, sf):
    return _table(spark, S.bars(_ticks(spark, sf), "1 hour", "15 minutes")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"{_CLOSED}, g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY symbol ORDER BY ts) + INTERVAL 1 hour OR lag(ts) OVER (PARTITION BY symbol ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM trades), s AS (SELECT *, sum(n) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM g), b AS (SELECT symbol, i, min(ts) AS start, max(ts) + INTERVAL 1 hour AS \"end\", count(*) AS trades, sum(quantity) AS volume FROM s GROUP BY 1, 2) SELECT symbol, start, \"end\", trades, volume FROM b, w WHERE \"end\" <= mark")
def stream_sessions(spark, sf):
    return _table(spark, S.sessions(_ticks(spark, sf), "1 hour")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(f"WITH {TRADES} SELECT symbol, max(ts) AS ts, last(price ORDER BY ts, trade_id) AS price FROM trades GROUP BY 1")
def stream_last_values(spark, sf):
    return _table(spark, S.last_values(_ticks(spark, sf), ["price"]), "complete").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"WITH RECURSIVE {TRADES}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS i FROM trades), r AS (SELECT symbol, ts, trade_id, i, price AS e FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.ts, n.trade_id, n.i, (1 - 2 / 22.0::DOUBLE) * r.e + 2 / 22.0::DOUBLE * n.price FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1) SELECT symbol, ts, trade_id, round(e, 6) AS ema FROM r")
def stream_stateful_ema(spark, sf):
    return rounded(_table(spark, S.stateful_ema(_ticks(spark, sf), 21)).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


_NTZ = lambda df, *cs: df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cs or ("ts",)})


@query(f"WITH {TRADES} SELECT symbol, trade_id, price FROM trades QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, trade_id DESC) <= 7")
def stream_recent_trades(spark, sf):
    return _table(spark, S.recent_trades(_ticks(spark, sf), 7), "update", "symbol").select("symbol", "trade_id", "price")


@query(f"WITH {TRADES} SELECT trade_id, symbol, price FROM trades")
def stream_distinct_ticks(spark, sf):
    x = _ticks(spark, sf)
    return _table(spark, S.distinct_ticks(x.unionByName(x), ["trade_id", "ts"])).select("trade_id", "symbol", "price")


@query(f"WITH {TRADES}, f AS (SELECT symbol, ts, price / 100 AS rate FROM trades WHERE trade_id % 40 = 0 QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY trade_id) = 1) SELECT t.trade_id, t.symbol, round(f.rate, 6) AS rate FROM trades t ASOF LEFT JOIN f ON f.symbol = t.symbol AND t.ts >= f.ts")
def stream_asof_static(spark, sf):
    t = schemas.trades(spark, sf).where("trade_id % 40 = 0")
    rates = clean.keep_one(t, ["symbol", "ts"], ["trade_id"], last=False).select("symbol", "ts", (F.col("price") / 100).alias("rate"))
    return rounded(_table(spark, S.asof_static(_ticks(spark, sf), rates, "rate", days=3)).select("trade_id", "symbol", "rate"))


@query(f"WITH {TRADES} SELECT symbol AS kind, count(*) AS n, round(sum(price), 6) AS total FROM trades WHERE symbol IN ('click', 'error') GROUP BY 1")
def stream_event_bus(spark, sf):
    base = fresh_folder(spark, "bus")
    S.dispatch(_ticks(spark, sf), "symbol", {k: f"{base}/{k}" for k in ("click", "error")}, f"{base}/checkpoint")
    parts = [spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/{k}").withColumn("kind", F.lit(k)) for k in ("click", "error")]
    return rounded(parts[0].unionByName(parts[1]).groupBy("kind").agg(F.count("*").alias("n"), F.sum("price").alias("total")))


@query(f"WITH {TRADES} SELECT trade_id, symbol, round(price - avg(price) OVER (PARTITION BY symbol ORDER BY ts, trade_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS score FROM trades")
def stream_rolling_scores(spark, sf):
    base = fresh_folder(spark, "scores")
    w = Window.partitionBy("symbol").orderBy("ts", "trade_id").rowsBetween(-4, 0)
    S.score_batches(_ticks(spark, sf), lambda x: x.withColumn("score", F.col("price") - F.avg("price").over(w)), f"{base}/history", f"{base}/scores", f"{base}/checkpoint", days=60)
    return rounded(spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/scores").select("trade_id", "symbol", "score"))


@query(f"WITH {TRADES} SELECT ts::DATE::VARCHAR AS day, count(*) AS n, round(sum(price), 6) AS total FROM trades GROUP BY 1")
def stream_daily_conversion(spark, sf):
    base, x = fresh_folder(spark, "daily"), _ticks(spark, sf)
    S.to_daily(x, f"{base}/days", f"{base}/checkpoint", ["trade_id"])
    S.to_daily(x, f"{base}/days", f"{base}/again", ["trade_id"])  # run again from the start: nothing is doubled
    return rounded(spark.read.parquet(f"{base}/days").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum("price").alias("total")))


@query(f"WITH {TRADES}, b AS (SELECT symbol, CASE WHEN is_buyer_maker THEN 'bid' ELSE 'ask' END AS side, floor(price / 10) * 10 AS price, quantity, ts, trade_id FROM trades), l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY symbol, side, price ORDER BY trade_id DESC) = 1), q AS (SELECT *, coalesce(quantity, 0) % 50 AS qty FROM l WHERE coalesce(quantity, 0) % 50 <> 0) SELECT symbol, side, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) - 1 AS level, price, qty FROM q QUALIFY level < 5")
def stream_order_book(spark, sf):
    raw = table(spark, sf, "events")
    x = S.tick_stream(spark, f"{sf}/events.parquet*", raw.schema).select(F.col("event_id").alias("seq"), F.col("event_type").alias("symbol"), F.when(F.col("user_id") % 2 == 0, "bid").otherwise("ask").alias("side"), (F.floor(F.col("value") / 10) * 10).cast("double").alias("price"), (F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') AS double)"), F.lit(0.0)) % 50).alias("qty"))
    return _table(spark, S.order_book(x, depth=5), "update", "symbol").where("level IS NOT NULL")


@query(f"{_CLOSED}, b AS (SELECT symbol, date_trunc('hour', ts) AS ts, {OHLC} FROM trades GROUP BY symbol, date_trunc('hour', ts)) SELECT b.symbol, b.ts, b.close FROM b, w WHERE b.ts + INTERVAL 1 hour <= mark AND trades >= 2")
def stream_closed_candles(spark, sf):
    x = S.bars(_ticks(spark, sf), "1 hour").withColumn("is_closed", F.col("trades") >= 2)
    return _NTZ(_table(spark, S.closed_candles(x).select("symbol", "ts", "close")))
