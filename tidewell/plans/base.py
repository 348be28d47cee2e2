"""Registration of queries with their oracles, and the pieces both sides are built from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import bars as B
from tidewell.sources.schemas import trades

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since engines add them up in different orders."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.trades_to_bars(trades(spark, sf_dir), "1h")


# SQL pieces

TRADES = "trades AS (SELECT event_id AS trade_id, ts, event_type AS symbol, value AS price, TRY_CAST(regexp_extract(props, '\"k\": *([0-9.]+)', 1) AS DOUBLE) AS quantity, user_id % 2 = 0 AS is_buyer_maker FROM events)"
_OHLC = "first(price ORDER BY ts, trade_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, trade_id) AS close, sum(quantity) AS volume, count(*) AS trades"
BARS = f"{TRADES}, bars AS (SELECT symbol, date_trunc('hour', ts) AS ts, {_OHLC} FROM trades GROUP BY symbol, date_trunc('hour', ts))"
OHLC = _OHLC


def over(before: int | None, after: int | None = 0) -> str:
    lo = "UNBOUNDED PRECEDING" if before is None else f"{before} PRECEDING" if before > 0 else "CURRENT ROW" if before == 0 else f"{-before} FOLLOWING"
    hi = "UNBOUNDED FOLLOWING" if after is None else f"{after} FOLLOWING" if after > 0 else "CURRENT ROW" if after == 0 else f"{-after} PRECEDING"
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {lo} AND {hi})"


def R(f: str, x: str, n: int, k: int | None = None) -> str:
    """Rolling aggregate with a least count; f may hold {x}."""
    call = f.format(x=x) if "{x}" in f else f"{f}({x})"
    return f"(CASE WHEN count({x}) {over(n - 1)} >= {n if k is None else k} THEN {call} {over(n - 1)} END)"


W = "OVER (PARTITION BY symbol ORDER BY ts)"


def lag(x: str, k: int = 1) -> str:
    return f"(lag({x}, {k}) {W})" if k >= 0 else f"(lead({x}, {-k}) {W})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def steps(first: str, *stages: dict[str, str], source: str = "bars") -> str:
    """CTEs s1, s2, ...: each adds (or replaces) columns of the one before."""
    out, last = [first], source
    for i, s in enumerate(stages, 1):
        out.append(f"s{i} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in s.items()) + f" FROM {last})")
        last = f"s{i}"
    return ", ".join(out)


def pick(columns: dict[str, str] | list[str], source: str, keys: str = "symbol, ts", digits: int = 6, where: str = "") -> str:
    """Rounded output columns."""
    columns = {c: c for c in columns} if not isinstance(columns, dict) else columns
    return f"SELECT {keys}, " + ", ".join(f"round({e}, {digits}) AS {n}" for n, e in columns.items()) + f" FROM {source}" + (f" WHERE {where}" if where else "")


def recursive(source: str, start: dict[str, str], step: dict[str, str], extra: str = "") -> str:
    """CTEs n (numbered rows of a source) and r (a fold over them by symbol): x is the new row, r the state before it."""
    cols = ", ".join(f"{e} AS {n}" for n, e in start.items())
    nxt = ", ".join(f"{e} AS {n}" for n, e in step.items())
    return f"n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM {source}), r AS (SELECT x.symbol, x.ts, x.i, {cols} FROM n x WHERE i = 1 UNION ALL SELECT x.symbol, x.ts, x.i, {nxt} FROM r JOIN n x ON x.symbol = r.symbol AND x.i = r.i + 1)"
