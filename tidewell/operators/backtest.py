"""Backtests with position state: sequential kernels per symbol, in Arrow batches of whole series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRADES = "symbol string, parameters int, entry_ts timestamp_ntz, exit_ts timestamp_ntz, entry_price double, exit_price double, pnl double, reason string"
#: What ATR counts as where it is 0.
LEAST_ATR = 0.01


def long_trades(close, high, low, signal, atr, take: float, stop: float) -> list[tuple[int, int, float, float, str]]:
    """(entry bar, exit bar, entry price, exit price, reason) of one long position at a time.

    A signal of the bar before enters at that bar's close, with targets from the ATR of the bar at hand, which may exit at once;
    the target is looked at first.  A position still open at the end leaves no trade.
    """
    out, held = [], None
    for i in range(1, len(close)):
        if held is None and signal[i - 1] == 1:
            a = LEAST_ATR if atr[i] == 0 else atr[i]
            held = (i - 1, close[i - 1], close[i - 1] + take * a, close[i - 1] - stop * a)
        if held:
            at, price, up, down = held
            if high[i] >= up or low[i] <= down:
                exit_, reason = (up, "take") if high[i] >= up else (down, "stop")
                out.append((at, i, price, exit_, reason))
                held = None
    return out


def over_parameters(bars: DataFrame, grid: list[dict], signal: str = "signal", atr: str = "atr") -> DataFrame:
    """Trades of the long backtest for every parameter set (column parameters: its number); a series is sorted once for all."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("ts", kind="stable")
        ts = pdf["ts"].to_numpy()
        columns = [pdf[c].to_numpy(float) for c in ("close", "high", "low", signal, atr)]
        out = [(pdf["symbol"].iloc[0], n, ts[a], ts[b], p, q, (q - p) / p, why) for n, g in enumerate(grid) for a, b, p, q, why in long_trades(*columns, g.get("take", 2.0), g.get("stop", 1.0))]
        return pd.DataFrame(out, columns=["symbol", "parameters", "entry_ts", "exit_ts", "entry_price", "exit_price", "pnl", "reason"])

    return bars.select("symbol", "ts", "high", "low", "close", signal, atr).groupBy("symbol").applyInPandas(run, TRADES)


def simple(bars: DataFrame, signal: str = "signal", atr: str = "atr", take: float = 2.0, stop: float = 1.0) -> DataFrame:
    """Trades of one parameter set."""
    return over_parameters(bars, [{"take": take, "stop": stop}], signal, atr).drop("parameters")


def score(trades: DataFrame, *keys: str) -> DataFrame:
    """Half the mean over deviation, .3 of the win rate and .2 of the profit factor (5 at most)."""
    p, tiny = F.col("pnl"), F.lit(1e-8)
    sharpe = F.avg(p) / (F.stddev_samp(p) + tiny)
    factor = F.abs(F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)) / (F.coalesce(F.sum(F.when(p < 0, p)), F.lit(0.0)) + tiny))
    x = trades.groupBy(*(keys or ("symbol",))).agg(F.count("*").alias("trades"), sharpe.alias("sharpe"), F.avg((p > 0).cast("int")).alias("win_rate"), factor.alias("profit_factor"))
    return x.withColumn("score", 0.5 * F.col("sharpe") + 0.3 * F.col("win_rate") + 0.2 * F.least("profit_factor", F.lit(5.0)))


def scores_of(trades: DataFrame, sets: DataFrame, *keys: str) -> DataFrame:
    """Scores for every wanted key (column names in ``keys``); -1 where there was no trade."""
    return sets.join(score(trades, *keys), list(keys), "left").withColumn("score", F.when(F.col("trades").isNull(), -1.0).otherwise(F.col("score"))).withColumn("trades", F.coalesce("trades", F.lit(0)))


SIDED = "symbol string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, side int, pnl double, reason string"
#: Share of a trade that fees take.
FEE = 0.0008


def both_sides(bars: DataFrame, signal: str = "signal", sell: str = "sell_confidence", buy: str = "buy_confidence", take: tuple[float, float] = (0.02, 0.02), stop: tuple[float, float] = (0.01, 0.01), confidence: float | None = 0.7, fee: float = FEE) -> DataFrame:
    """Trades of long (1) and short (-1) signals with relative targets (long, short) and an early exit on a model's confidence.

    A signal of the bar before enters at that bar's close; a bar then looks at the model first (``confidence``: None is off), at the target
    second, at the stop last.
    """

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("ts", kind="stable")
        ts = pdf["ts"].to_numpy()
        close, high, low, sig, against_long, against_short = (pdf[c].to_numpy(float) for c in ("close", "high", "low", signal, sell, buy))
        out, side, at, price = [], 0, 0, 0.0
        for i in range(1, len(close)):
            if side == 0 and sig[i - 1] in (1, -1):
                side, at, price = int(sig[i - 1]), i - 1, close[i - 1]
            if side == 0:
                continue
            up, down = (take[0], stop[0]) if side > 0 else (take[1], stop[1])
            best, worst = (high[i], low[i]) if side > 0 else (low[i], high[i])
            model = against_long[i] if side > 0 else against_short[i]
            if confidence is not None and model > confidence:
                pnl, why = side * (close[i] - price) / price, "model"
            elif side * (best - price * (1 + side * up)) >= 0:
                pnl, why = up, "take"
            elif side * (worst - price * (1 - side * down)) <= 0:
                pnl, why = -down, "stop"
            else:
                continue
            out.append((pdf["symbol"].iloc[0], ts[at], ts[i], side, pnl - fee, why))
            side = 0
        return pd.DataFrame(out, columns=["symbol", "entry_ts", "exit_ts", "side", "pnl", "reason"])

    return bars.select("symbol", "ts", "high", "low", "close", signal, sell, buy).groupBy("symbol").applyInPandas(run, SIDED)


def momentum_confidence(bars: DataFrame, n: int = 5, level: float = 0.01, value: float = 0.75) -> DataFrame:
    """Confidence against a side, from the change over n bars beyond a level."""
    from tidewell.functions import expr as E

    m = F.coalesce(E.pct("close", n), F.lit(0.0))
    return bars.withColumns({"sell_confidence": F.when(m < -level, value).otherwise(0.0), "buy_confidence": F.when(m > level, value).otherwise(0.0)})


def trade_summary(trades: DataFrame, *keys: str) -> DataFrame:
    """Gross profit and loss, profit factor (NULL without a loss), greatest drawdown of the compounded trades, and their count."""
    keys = keys or ("symbol",)
    order = Window.partitionBy(*keys).orderBy("exit_ts")
    x = trades.withColumn("_e", F.product(1 + F.col("pnl")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_d", F.col("_e") / F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    p = F.col("pnl")
    gain, loss = F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(p < 0, p)), F.lit(0.0)))
    return x.groupBy(*keys).agg(gain.alias("gross_profit"), loss.alias("gross_loss"), F.when(loss > 1e-9, gain / loss).alias("profit_factor"), F.abs(F.min("_d")).alias("max_drawdown"), F.count("*").alias("trades"))


def on_features(df: DataFrame, energy: list[str], entropy: list[str], key: str = "symbol") -> DataFrame:
    """A backtest on cached feature columns: long where the mean energy of a row exceeds their median, short where the mean entropy
    lies below theirs (which goes first); the position earns the bar's own change.  Total, Sharpe ratio, drawdown, wins, signals.
    """
    from tidewell.functions import expr as E

    mean = lambda cs: sum((F.col(c) for c in cs[1:]), F.col(cs[0])) / len(cs)

    def median(cs):
        a, n = F.array_sort(F.array(*cs)), len(cs)
        return F.get(a, n // 2) if n % 2 else (F.get(a, n // 2 - 1) + F.get(a, n // 2)) / 2

    s = F.lit(0)
    if energy:
        s = F.when(mean(energy) > median(energy), 1).otherwise(s)
    if entropy:
        s = F.when(mean(entropy) < median(entropy), -1).otherwise(s)
    order = Window.partitionBy(key).orderBy("ts")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_s", s).withColumn("_r", F.coalesce(F.col("_s") * E.pct("close", key=key), F.lit(0.0)))
    x = x.withColumn("_c", F.sum("_r").over(upto)).withColumn("_d", F.col("_c") - F.max("_c").over(upto))
    return x.groupBy(key).agg(
        F.max_by("_c", "ts").alias("total_return"), (F.avg("_r") / (F.stddev_pop("_r") + 1e-8) * 252**0.5).alias("sharpe"), F.min("_d").alias("max_drawdown"),
        F.avg((F.col("_r") > 0).cast("int")).alias("win_rate"), F.sum((F.col("_s") != 0).cast("long")).alias("signals"), F.max_by("_s", "ts").alias("final_position"),
    )


LEDGER = "symbol string, ts timestamp_ntz, cash double, quantity double, equity double, drawdown double"


def ledger(bars: DataFrame, signal: str = "signal", cash: float = 10_000.0, share: float = 1.0, fee: float = 0.001) -> DataFrame:
    """Buys with a share of the cash on 1, sells all on -1, with fees; equity and drawdown at every bar."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("ts", kind="stable")
        money, quantity, top, out = cash, 0.0, cash, []
        for ts, close, s in zip(pdf["ts"], pdf["close"], pdf[signal], strict=True):
            if s == 1 and money > 0:
                spend = money * share
                quantity += spend * (1 - fee) / close
                money -= spend
            elif s == -1 and quantity > 0:
                money += quantity * close * (1 - fee)
                quantity = 0.0
            equity = money + quantity * close
            top = max(top, equity)
            out.append((pdf["symbol"].iloc[0], ts, money, quantity, equity, equity / top - 1))
        return pd.DataFrame(out, columns=["symbol", "ts", "cash", "quantity", "equity", "drawdown"])

    return bars.select("symbol", "ts", "close", signal).groupBy("symbol").applyInPandas(run, LEDGER)


def progressive(df: DataFrame, evaluate, shares: tuple[float, ...] = (0.1, 0.25, 0.5, 1.0), least: float = float("-inf"), key: str = "symbol") -> list[float]:
    """Scores of growing prefixes in time, ended early where one falls below ``least``."""
    from pyspark.sql import Window

    n, total = F.row_number().over(Window.partitionBy(key).orderBy("ts")), F.count("*").over(Window.partitionBy(key))
    x, out = df.withColumns({"_n": n, "_t": total}).persist(), []
    for s in shares:
        out.append(float(evaluate(x.where(F.col("_n") <= F.ceil(F.col("_t") * s)).drop("_n", "_t"))))
        if out[-1] < least:
            break
    x.unpersist()
    return out
