"""Streaming bars, sessions, last values, books and stateful means.

Event time needs TIMESTAMP; NTZ columns are cast (the session is in UTC).  Late rows beyond the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tick_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def with_event_time(df: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def bars(ticks: DataFrame, window: str, slide: str | None = None, key: str = "symbol") -> DataFrame:
    """Tumbling or sliding bars, closed by the watermark in append mode."""
    at = F.struct("ts", "trade_id")
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return ticks.groupBy(key, w.alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"), F.count("*").alias("trades")).select(key, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "trades")


def sessions(ticks: DataFrame, gap: str, key: str = "symbol") -> DataFrame:
    return ticks.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("trades"), F.sum("quantity").alias("volume")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "trades", "volume")


def distinct_ticks(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Drops repeats within the watermark."""
    return ticks.dropDuplicatesWithinWatermark(keys)


def last_values(ticks: DataFrame, columns: list[str], key: str = "symbol") -> DataFrame:
    """Latest row per key (update or complete mode)."""
    return ticks.groupBy(key).agg(F.max_by(F.struct("ts", *columns), F.struct("ts", "trade_id")).alias("x")).select(key, "x.*")


def stateful_ema(ticks: DataFrame, span: float, key: str = "symbol") -> DataFrame:
    """Exponential mean of prices per key, in order of time within each batch."""
    a = 2.0 / (span + 1.0)

    def step(k, batches: Iterator, state):
        import pandas as pd

        ema = state.get[0] if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "trade_id"])
            out = []
            for x in pdf["price"]:
                ema = x if ema is None else (1 - a) * ema + a * x
                out.append(ema)
            yield pd.DataFrame({key: k[0], "ts": pdf["ts"].to_numpy(), "trade_id": pdf["trade_id"].to_numpy(), "ema": out})
        if ema is not None:
            state.update((float(ema),))

    return ticks.select(key, "ts", "trade_id", "price").groupBy(key).applyInPandasWithState(step, f"{key} string, ts timestamp, trade_id long, ema double", "ema double", "append", "NoTimeout")


def order_book(updates: DataFrame, key: str = "symbol", depth: int = 20) -> DataFrame:
    """Best levels of each side after each batch; of each level the update of greatest seq counts, in whatever order they arrive.

    A quantity of 0 removes its level, which the state keeps by its seq so that an older update can't bring it back.  A book without levels
    left is one row without side and level, so that its last levels don't stay.
    """

    def step(k, batches: Iterator, state):
        import pandas as pd

        book = {}  # (side, price): (seq, qty)
        if state.exists:
            book = {(s, p): (n, q) for s, p, n, q in zip(*state.get, strict=True)}
        for pdf in batches:  # rows of one key come in several parts, in no order
            newest = pdf.sort_values(["seq", "qty"]).drop_duplicates(["side", "price"], keep="last")
            for s, p, n, q in newest[["side", "price", "seq", "qty"]].itertuples(index=False):
                book[(s, p)] = max(book.get((s, p), (n, q)), (n, q))
        rows = sorted(book.items())
        state.update(([x[0][0] for x in rows], [float(x[0][1]) for x in rows], [int(x[1][0]) for x in rows], [float(x[1][1]) for x in rows]))
        left = [(s, p, q) for (s, p), (_, q) in rows if q != 0]
        bids = sorted(((p, q) for s, p, q in left if s == "bid"), reverse=True)[:depth]
        asks = sorted((p, q) for s, p, q in left if s == "ask")[:depth]
        out = [(k[0], side, i, p, q) for side, own in (("bid", bids), ("ask", asks)) for i, (p, q) in enumerate(own)]
        yield pd.DataFrame(out or [(k[0], None, None, None, None)], columns=[key, "side", "level", "price", "qty"])

    return updates.groupBy(key).applyInPandasWithState(step, f"{key} string, side string, level long, price double, qty double", "sides array<string>, prices array<double>, seqs array<long>, sizes array<double>", "update", "NoTimeout")


def closed_candles(messages: DataFrame) -> DataFrame:
    return messages.where("is_closed")


def recent_trades(ticks: DataFrame, n: int, key: str = "symbol") -> DataFrame:
    """The last n ticks of each key after every batch (update mode); the state holds no more than those."""

    def step(k, batches: Iterator, state):
        import pandas as pd

        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            held = sorted(held + list(zip(pdf["at"].astype("int64"), pdf["trade_id"].astype("int64"), pdf["price"].astype(float), strict=True)))[-n:]
        state.update(tuple(list(map(kind, x)) for kind, x in zip((int, int, float), zip(*held, strict=True), strict=True)))
        yield pd.DataFrame([(k[0], *x) for x in held], columns=[key, "at", "trade_id", "price"])

    rows = ticks.select(key, F.unix_micros("ts").alias("at"), "trade_id", "price")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} string, at long, trade_id long, price double", "ats array<long>, ids array<long>, prices array<double>", "update", "NoTimeout")


def asof_static(ticks: DataFrame, static: DataFrame, value: str, days: int = 1, key: str = "symbol") -> DataFrame:
    """A stream joined with the last static value at or before each tick.

    static: key, ts, value.  It is cut into chunks of days, each a sorted list opened by the last value before it, so the join is on
    (key, chunk) and a list holds one chunk's values; ticks of chunks after the last value take the latest.
    """
    from pyspark.sql import Window

    size = 86_400_000_000 * days
    s = static.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("_t"), F.col(value).alias("_v")).withColumn("_chunk", F.floor(F.col("_t") / size))
    ranges = s.groupBy(key).agg(F.min("_chunk").alias("a"), F.max("_chunk").alias("b"))
    every = ranges.select(key, F.explode(F.sequence("a", F.col("b") + 1)).alias("_chunk"))
    lists = s.groupBy(key, "_chunk").agg(F.array_sort(F.collect_list(F.struct("_t", "_v"))).alias("_own"), F.max(F.struct("_t", "_v")).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    table = every.join(lists, [key, "_chunk"], "left").withColumn("_before", before).drop("_end")
    table = table.join(ranges.select(key, (F.col("b") + 1).alias("_last")), key)
    t = F.unix_micros("ts")
    x = ticks.withColumn("_at", F.floor(t / size)).join(table.withColumnRenamed(key, "_key"), F.expr(f"{key} = _key AND (_at = _chunk OR (_chunk = _last AND _at > _last))"), "left")
    hit = F.element_at(F.filter(F.concat(F.array_compact(F.array("_before")), F.coalesce("_own", F.array().cast("array<struct<_t:bigint,_v:double>>"))), lambda v: v["_t"] <= t), -1)
    return x.withColumn(value, F.when(F.size(F.filter(F.concat(F.array_compact(F.array("_before")), F.coalesce("_own", F.array().cast("array<struct<_t:bigint,_v:double>>"))), lambda v: v["_t"] <= t)) > 0, hit["_v"])).select(*ticks.columns, value)


def dispatch(events: DataFrame, kind: str, tables: dict[str, str], checkpoint: str):
    """An event bus replayed from its log: each event goes to the table of its kind, once, in one pass over a batch; others are left out."""

    def sink(batch: DataFrame, number: int) -> None:
        own = batch.where(F.col(kind).isin(*tables)).persist()
        for name, path in tables.items():
            own.where(F.col(kind) == name).write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that is run again replaces itself
        own.unpersist()

    return run_available(events, sink=sink, checkpoint=checkpoint)


def score_batches(rows: DataFrame, scorer: Callable[[DataFrame], DataFrame], history: str, out: str, checkpoint: str, days: int = 2, ts: str = "ts"):
    """Rolling inference: every batch is scored together with the last days kept of the rows before it, and only its own scores are written."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.agg(F.min(ts)).first()[0]
        if first is None:
            return
        old = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(history) if number else batch.limit(0)
        own = old.where(F.col(ts) >= F.lit(first) - F.expr(f"INTERVAL {days} DAYS")).withColumn("_new", F.lit(False)).unionByName(batch.withColumn("_new", F.lit(True)))
        scorer(own).where("_new").drop("_new").write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.write.mode("overwrite").parquet(f"{history}/part-of={number}")

    return run_available(rows, sink=sink, checkpoint=checkpoint)


def to_daily(ticks: DataFrame, base: str, checkpoint: str, keys: list[str]):
    """Incremental conversion: each batch is merged into the days it touches, which alone are rewritten; repeated keys keep one row."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        x = batch.withColumn("day", F.to_date("ts"))
        try:
            old = spark.read.schema(x.schema).option("basePath", base).parquet(base)
        except Exception:  # noqa: BLE001 - there is no table before the first batch
            old = x.limit(0)
        days = x.select("day").distinct()
        merged = old.join(F.broadcast(days), "day", "left_semi").unionByName(x).dropDuplicates(keys)
        # written beside the table first, since a table can't be overwritten while it is read
        merged.write.mode("overwrite").partitionBy("day").parquet(f"{base}.next")
        again = spark.read.schema(x.schema).option("basePath", f"{base}.next").parquet(f"{base}.next")
        again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(base)

    return run_available(ticks, sink=sink, checkpoint=checkpoint)


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, name: str | None = None, mode: str = "append", checkpoint: str | None = None):
    """Processes all that is there, then ends; into a memory table (tests) or a batch function, from a checkpoint if one is named."""
    w = df.writeStream.outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    w = w.foreachBatch(sink) if sink else w.format("memory").queryName(name)
    q = w.start()
    q.awaitTermination()
    return q


def run_to_table(df: DataFrame, folder: str, mode: str = "append", latest: str | None = None) -> DataFrame:
    """Processes all that is there into a table under the folder, with a checkpoint beside it, and reads the table.

    append: rows as they are final.  complete: the last state.  update: of each value of ``latest`` what its last batch said.
    """
    spark, data, checkpoint = df.sparkSession, f"{folder}/data", f"{folder}/checkpoint"
    if mode == "append":
        q = df.writeStream.outputMode("append").trigger(availableNow=True).format("parquet").option("path", data).option("checkpointLocation", checkpoint).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(data)
    run_available(df, lambda b, i: b.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{data}/part-of={i}"), mode=mode, checkpoint=checkpoint)
    from pyspark.sql import Window

    rows = spark.read.option("recursiveFileLookup", "true").parquet(data)
    newest = F.max("_batch").over(Window.partitionBy(latest)) if latest else F.lit(rows.agg(F.max("_batch")).first()[0])
    return rows.withColumn("_newest", newest).where("_batch = _newest").drop("_batch", "_newest")
