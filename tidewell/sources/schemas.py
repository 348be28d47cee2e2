"""Named schemas, their enforcement, and the mapping of the driver's tables onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns and types of the named schemas.
SCHEMAS = {
    "klines": {"timestamp": "bigint", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double"},
    "aggtrades": {"timestamp": "bigint", "price": "double", "quantity": "double", "is_buyer_maker": "boolean", "agg_trade_id": "bigint"},
    "futures": {"timestamp": "bigint", "fundingRate": "double"},
    "split": {"timestamp": "bigint", "label": "bigint"},
    "unified": {"timestamp": "bigint", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "exchange": "string", "symbol": "string", "timeframe": "string", "year": "smallint", "month": "tinyint", "day": "tinyint"},
}
OPTIONAL = {"unified": {"trade_volume": "double", "trade_count": "bigint", "avg_price": "double", "min_price": "double", "max_price": "double", "volume_ratio": "double", "funding_rate": "double"}}


def epoch_ms(column: str, kind: str):
    """Milliseconds of a timestamp, or of an epoch in s, ms, us or ns told by its magnitude."""
    c = F.col(column)
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_millis(c.cast("timestamp"))
    n = F.expr(f"try_cast(`{column}` AS bigint)")
    size = F.abs(n)
    return F.when(size > 10**17, F.floor(n / 10**6)).when(size > 10**14, F.floor(n / 10**3)).when(size > 10**11, n).otherwise(n * 1000).cast("bigint")


def enforce(df: DataFrame, name: str) -> DataFrame:
    """Columns of the schema in order, cast; what can't be cast is NULL; other columns follow unchanged."""
    own = SCHEMAS[name] | {c: t for c, t in OPTIONAL.get(name, {}).items() if c in df.columns}
    have = dict(df.dtypes)
    out = []
    for c, t in own.items():
        if c == "timestamp" and c in have:
            out.append(epoch_ms(c, have[c]).alias(c))
        else:
            out.append((F.expr(f"try_cast(`{c}` AS {t})") if c in have else F.lit(None).cast(t)).alias(c))
    return df.select(*out, *[c for c in df.columns if c not in own])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ticks: symbol is the event type, quantity the number in props."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("trade_id"), "ts", F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.expr("try_cast(get_json_object(props, '$.k') AS double)").alias("quantity"), (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
    )


#: Fields of exchange messages and what they are called here.
WIRE = {"T": "timestamp", "p": "price", "q": "quantity", "a": "agg_trade_id", "f": "first_trade_id", "l": "last_trade_id", "m": "is_buyer_maker"}
KLINE_FIELDS = ("timestamp", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_base", "taker_quote", "ignore")


def from_trade_messages(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON trade messages to the aggtrades schema; what isn't valid becomes NULL."""
    x = df.select(F.from_json(column, "T bigint, p string, q string, a bigint, f bigint, l bigint, m boolean").alias("x")).select("x.*").withColumnsRenamed(WIRE)
    return enforce(x, "aggtrades")


def from_kline_lists(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON lists of twelve fields to the klines schema."""
    x = df.select(F.from_json(column, "array<string>").alias("x"))
    return enforce(x.select(*[F.get("x", i).alias(n) for i, n in enumerate(KLINE_FIELDS)]), "klines").select(*SCHEMAS["klines"])
