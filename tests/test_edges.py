"""Queries on small event tables with odd values, against their SQL; NULL, NaN and infinities are told apart."""

import datetime as dt
import random
from collections import Counter

import duckdb
import pandas as pd
import pytest

from tidewell.plans import registry

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Runs a query and its SQL on ticks (hours from the start, symbol, price) and compares; gives the SQL's rows."""

    def run(name, ticks):
        rows = [(i, T0 + dt.timedelta(hours=h), i, s, float(p), '{"k": %d}' % (i % 90 + 1)) for i, (h, s, p) in enumerate(ticks)]
        x = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
        x["ts"] = x["ts"].astype("datetime64[us]")
        x.to_parquet(tmp_path / "events.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        sql = con.execute(registry.oracle_sql()[name])
        columns = [c[0] for c in sql.description]
        want = [dict(zip(columns, r, strict=True)) for r in sql.fetchall()]
        got = registry.queries()[name](spark, str(tmp_path))
        assert sorted(got.columns) == sorted(columns)
        value = lambda v: repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)
        kept = lambda rs: Counter(tuple(value(r[c]) for c in columns) for r in rs)
        assert kept(r.asDict() for r in got.collect()) == kept(want)
        return want

    return run


def test_csv_trades_with_a_price_of_zero(same_as_sql):
    assert [r["price"] for r in same_as_sql("csv_trades", [(0, "A", 5), (1, "A", 0), (2, "B", 7)])] == [5.0, 0.0, 7.0]


def test_order_book_of_updates_out_of_order(spark, tmp_path):
    from tidewell.streaming import bars as S

    schema, n = "symbol string, seq long, side string, price double, qty double", 200
    # the greatest seq of a level comes first; level 0 is removed by its last update, level 1 has it in the first file
    x = [("A", i, "bid", float(i % 4), 0.0 if i % 4 == 0 and i >= n - 4 else float(i)) for i in reversed(range(n))]
    spark.createDataFrame(x, schema).coalesce(1).write.parquet(str(tmp_path / "u/1"))
    spark.createDataFrame([("A", 1, "bid", 1.0, 7.0), ("A", 0, "bid", 0.0, 7.0)], schema).coalesce(1).write.parquet(str(tmp_path / "u/2"))
    s = S.tick_stream(spark, str(tmp_path / "u/*"), schema)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # as larger groups are, in parts
    try:
        got = S.run_to_table(S.order_book(s), str(tmp_path / "t"), "update", "symbol").orderBy("level").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.level, r.price, r.qty) for r in got] == [(0, 3.0, 199.0), (1, 2.0, 198.0), (2, 1.0, 197.0)]


def test_order_book_that_empties(spark, tmp_path):
    from tidewell.streaming import bars as S

    schema = "symbol string, seq long, side string, price double, qty double"
    for i, q in enumerate((3.0, 0.0)):
        spark.createDataFrame([("A", i, "ask", 1.0, q)], schema).coalesce(1).write.parquet(str(tmp_path / f"u/{i}"))
    t = S.run_to_table(S.order_book(S.tick_stream(spark, str(tmp_path / "u/*"), schema)), str(tmp_path / "t"), "update", "symbol")
    assert [(r.symbol, r.level) for r in t.collect()] == [("A", None)]


# bars whose range reaches 0: between others, at open and close, and as a whole
RNG = random.Random(7)
ZEROS = [(h, s, p) for s in "AB" for h in range(40) for p in ({3: (5, 0, 6), 9: (0, 4), 15: (4, 0), 21: (0, 0), 39: (8, 0, 9)} if s == "A" else {0: (0, 3), 1: (2, 0), 33: (7, 0, 2)}).get(h, [RNG.uniform(8, 20) for _ in range(3)])]


def test_volatility_model_of_zero_prices(same_as_sql):
    got = {str(r["garman_klass_volatility"]) for r in same_as_sql("volatility_model", ZEROS)}
    assert {"inf", "nan"} <= got and len(got) > 3


def test_garman_klass_of_zero_prices(same_as_sql):
    got = Counter(str(r["gk_bar"]) for r in same_as_sql("garman_klass_bar", ZEROS))
    assert got["inf"] == 3 and got["nan"] == 5


def test_volatility_estimators_of_zero_prices(same_as_sql):
    got = {r["symbol"]: str(r["vol_parkinson"]) for r in same_as_sql("volatility_estimators", ZEROS)}
    assert got == {"A": "nan", "B": "inf"}  # A's last 30 bars hold a bar of zeros


def test_spread_of_zero_prices(same_as_sql):
    got = {(r["symbol"], r["ts"]): r["bid_ask_spread"] for r in same_as_sql("corwin_schultz_roll", ZEROS)}
    assert got["B", T0] == 0 and got["B", T0 + dt.timedelta(hours=1)] == 0.05  # no covariance yet for the Roll estimate


def test_best_threshold_where_none_is_within_bounds(same_as_sql):
    assert len(same_as_sql("best_threshold", [(h, "A", 5 + h * k) for h in range(9) for k in range(h % 5 + 1)])) == 1
    assert same_as_sql("best_threshold", [(h, "A", 5 + h * k) for h in range(9) for k in range(1, 6)]) == []  # every bar is at every threshold


def test_validation_of_zero_and_infinite_prices(same_as_sql):
    # at 05:00 the query moves the open to high - 400, below the low of 0
    ticks = [(4, "A", 0), (4, "A", 3), (5, "A", 0), (5, "A", 3), (6, "A", 2), (6, "A", float("inf")), (6, "A", 4), (7, "B", float("inf"))]
    got = {r["symbol"]: (r["negative"], r["zero_price"], r["infinite"], r["failure"]) for r in same_as_sql("kline_validation_report", ticks)}
    assert got == {"A": (1, 1, 0, "negative"), "B": (0, 0, 1, "infinite")}
