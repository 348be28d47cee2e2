"""Event triggers, greedy spacing, suppression of overlaps, and windows around events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import expr as E


def triggers(df: DataFrame, thresholds: dict[str, float], key: str = E.KEY) -> DataFrame:
    """Long (key, ts, row_index, event_label, intensity, secondary_labels): a label's score rises to its threshold."""
    x = df.withColumn("row_index", F.row_number().over(E.series(key)) - 1)
    x = x.withColumns({f"_p_{c}": F.coalesce(E.lag(c, key=key), F.lit(0.0)) for c in thresholds})
    on = {c: F.col(c) >= t for c, t in thresholds.items()}
    cases = F.array(*[F.when(on[c] & (F.col(f"_p_{c}") < t), F.struct(F.lit(c).alias("event_label"), F.col(c).cast("double").alias("intensity"))) for c, t in thresholds.items()])
    active = F.filter(F.array(*[F.when(on[c], F.lit(c)) for c in thresholds]), lambda v: v.isNotNull())
    x = x.select(key, "ts", "row_index", active.alias("_a"), F.explode(F.filter(cases, lambda v: v.isNotNull())).alias("e"))
    return x.select(key, "ts", "row_index", "e.event_label", "e.intensity", F.array_sort(F.filter("_a", lambda v: v != F.col("e.event_label"))).alias("secondary_labels"))


def cooldown(events: DataFrame, bars: int = 45, key: str = E.KEY) -> DataFrame:
    """Per label, keeps an event only if at least ``bars`` rows have passed since the last kept one.

    An event that follows its predecessor after such a gap is always kept, so series are cut there; each piece is a chain of
    jumps through its sorted row numbers.
    """
    gap = F.col("row_index") - F.lag("row_index").over(Window.partitionBy(key, "event_label").orderBy("row_index"))
    piece = F.sum(F.coalesce((gap >= bars).cast("int"), F.lit(0))).over(Window.partitionBy(key, "event_label").orderBy("row_index"))
    x = events.select(key, "event_label", F.col("row_index").cast("long").alias("row_index")).withColumn("_piece", piece)

    def run(table):
        import numpy as np
        import pyarrow as pa

        rows = np.unique(table.column("row_index").to_numpy())
        at = [0]
        while (nxt := int(np.searchsorted(rows, rows[at[-1]] + bars))) < len(rows):
            at.append(nxt)
        one = lambda name: table.column(name).slice(0, 1).to_pylist() * len(at)
        return pa.table({key: one(key), "event_label": one("event_label"), "row_index": rows[at]})

    kinds = dict(events.dtypes)
    kept = x.groupBy(key, "event_label", "_piece").applyInArrow(run, f"`{key}` {kinds[key]}, event_label {kinds['event_label']}, row_index long")
    return events.join(kept, [key, "event_label", "row_index"], "left_semi")


def overlap(a: int, b: int, pre: int, post: int) -> float:
    """Intersection over union of the inclusive windows around two rows."""
    length = pre + post + 1
    both = max(0, length - abs(a - b))
    return both / (2 * length - both)


def suppress(events: DataFrame, least_overlap: float = 0.5, pre: int = 60, post: int = 20, key: str = E.KEY) -> DataFrame:
    """Greedy by intensity: drops an event whose window overlaps a stronger kept one (ties: earlier row, then label).

    Windows overlap that much up to a certain distance of their rows, so series are cut at greater gaps, and a kept event
    blocks the rows around it.
    """
    length = pre + post + 1
    reach = max(d for d in range(length) if overlap(0, d, pre, post) >= least_overlap) if least_overlap > 0 else length
    w = Window.partitionBy(key).orderBy("row_index")
    piece = F.sum(F.coalesce((F.col("row_index") - F.lag("row_index").over(w) > reach).cast("int"), F.lit(0))).over(w)
    columns = events.columns

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values(["intensity", "row_index", "event_label"], ascending=[False, True, True], kind="stable")
        first = int(pdf["row_index"].min())
        blocked, kept = np.zeros(int(pdf["row_index"].max()) - first + 1, bool), []
        for n, i in enumerate((pdf["row_index"] - first).tolist()):
            if not blocked[i]:
                kept.append(n)
                blocked[max(0, i - reach) : i + reach + 1] = True
        return pdf.iloc[kept][columns]

    return events.withColumn("_piece", piece).groupBy(key, "_piece").applyInPandas(run, events.schema)


def per_label(events: DataFrame, most: int, key: str = E.KEY) -> DataFrame:
    """The first ``most`` events of each label."""
    n = F.row_number().over(Window.partitionBy(key, "event_label").orderBy("row_index"))
    return events.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def windows(bars: DataFrame, events: DataFrame, features: list[str], pre: int = 60, post: int = 20, profit: float = 0.002, key: str = E.KEY) -> DataFrame:
    """For each event: arrays of features before and after, returns from its close, bars to the profit target, pooled means and deviations.

    Only events whose whole window exists are kept.
    """
    x = bars.withColumn("row_index", F.row_number().over(E.series(key)) - 1)
    state = F.struct(*features)
    x = x.withColumns({"pre_states": F.collect_list(state).over(E.frame(pre, -1, key=key)), "post_states": F.collect_list(state).over(E.frame(-1, post, key=key)), "_after": F.collect_list("close").over(E.frame(-1, post, key=key))})
    x = x.where((F.size("pre_states") == pre) & (F.size("post_states") == post))
    x = x.withColumn("path_returns", F.transform("_after", lambda v: v / F.col("close") - 1))
    hit = F.get(F.filter(F.transform("path_returns", lambda v, i: F.when(v >= profit, i + 1)), lambda v: v.isNotNull()), 0)
    mean = lambda f: F.aggregate("pre_states", F.lit(0.0), lambda a, v: a + v[f]) / pre
    x = x.withColumn("bars_to_profit", hit).withColumn("pooled", F.create_map(*[y for f in features for y in (F.lit(f"{f}_mean"), mean(f))]))
    return events.join(x.select(key, "row_index", "pre_states", "post_states", "path_returns", "bars_to_profit", "pooled"), [key, "row_index"])


def path_class(regimes, returns, level: float = 0.001, onset: int = 8, beginnings: bool = True):
    """Class of a path from the regimes after an event and the returns summed up, in this order of preference:

    beginning_of_trend (a change of regime within ``onset`` bars), continuation (none at all), reversal (a change anywhere), each
    only if the sum moves by ``level``; end_of_trend otherwise.
    """
    first = F.get(regimes, 0)
    changes = lambda a: F.exists(a, lambda r: r != first)
    moved = F.abs(F.aggregate(returns, F.lit(0.0), lambda s, r: s + F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)))) >= level
    some = F.size(regimes) > 0
    begins = some & changes(F.slice(regimes, 1, onset)) & moved if beginnings else F.lit(False)
    return F.when(begins, "beginning_of_trend").when(some & ~changes(regimes) & moved, "continuation").when(some & changes(regimes) & moved, "reversal").otherwise("end_of_trend")


def multi_hot(label, secondary, names: list[str]):
    return F.array(*[((label == n) | F.array_contains(secondary, n)).cast("int") for n in names])


#: Classes of paths, as ``path_class`` names them.
PATHS = ("continuation", "reversal", "beginning_of_trend", "end_of_trend")


def reliable(p, scale):
    """A probability scaled by the reliability of its source (1 if unknown), within [0, 1]."""
    return E.clip(p * F.coalesce(scale, F.lit(1.0)), 0, 1)


def combine_probabilities(df: DataFrame, weights: dict[str, float], keys: list[str], reliability: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """Weighted means over timeframes of the probability of each class, scaled by the reliability of (timeframe, class).

    Timeframes without a positive weight don't count; without any, all are 0.
    """
    table = lambda d: F.create_map(*[y for k, v in d.items() for y in (F.lit(k), F.lit(float(v)))])
    known = {k: v for k, v in weights.items() if v > 0}
    w = F.coalesce(F.element_at(table(known), F.col("timeframe")), F.lit(0.0))
    total = F.sum(w)
    out = []
    for c in PATHS:
        own = {t: v for (t, cls), v in (reliability or {}).items() if cls == c}
        p = reliable(F.coalesce(F.col(c), F.lit(0.0)), F.element_at(table(own), F.col("timeframe")) if own else F.lit(None).cast("double"))
        out.append(F.coalesce(F.try_divide(F.sum(w * p), total), F.lit(0.0)).alias(c))
    return df.groupBy(*keys).agg(*out)


def gate(df: DataFrame, least: float = 0.75, least_beginning: float = 0.75) -> DataFrame:
    """allow_trade and its trigger: continuation, or the beginning of a trend where it is as likely, beyond a threshold."""
    go, begin = F.col("continuation") >= least, (F.col("beginning_of_trend") >= least_beginning) & (F.col("beginning_of_trend") >= F.col("continuation"))
    return df.withColumns({"allow_trade": (go | begin).cast("int"), "trigger": F.when(begin, "beginning_of_trend").when(go, "continuation")})


def exit_bias(df: DataFrame, strong: float = 0.4) -> DataFrame:
    """How much more likely a reversal is than what favours the position; exit where it is, or is beyond ``strong``."""
    bias = F.col("reversal") - F.greatest("continuation", "beginning_of_trend")
    return df.withColumns({"exit_bias": bias, "strong_reversal": (F.col("reversal") > strong).cast("int"), "exit": ((F.col("reversal") > strong) | (bias > 0)).cast("int")})


def dtw(a, b) -> float:
    """Dynamic-time-warping distance of two sequences; with an empty one infinite, of two 0."""
    import numpy as np

    x, y = np.asarray(a, float), np.asarray(b, float)
    last = np.full(len(y) + 1, np.inf)
    last[0] = 0.0
    for v in x:
        cost, row = np.abs(y - v), np.full(len(y) + 1, np.inf)
        best = np.minimum(last[:-1], last[1:])
        for j in range(len(y)):
            row[j + 1] = cost[j] + min(best[j], row[j])
        last = row
    return float(last[-1])


def dtw_distance(df: DataFrame, a: str, b: str, out: str = "dtw") -> DataFrame:
    """The distance of two array columns, in Arrow batches; NULL where one is NULL."""

    def run(x, y):
        import pandas as pd

        return pd.Series([None if p is None or q is None else dtw(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return df.withColumn(out, F.pandas_udf(run, "double")(F.col(a), F.col(b)))


def near_duplicates(df: DataFrame, vector: str, most: float = 0.98, key: str = E.KEY) -> DataFrame:
    """Drops a sample whose vector's cosine to that of the sample before it (by row) is ``most`` or more."""
    from tidewell.operators.regimes import cosine

    before = F.lag(vector).over(Window.partitionBy(key, "event_label").orderBy("row_index"))
    return df.withColumn("_c", cosine(F.col(vector), before)).where(F.coalesce(F.col("_c") < most, F.lit(True))).drop("_c")


def rolling_windows(bars: DataFrame, features: list[str], state: str, pre: int = 60, post: int = 20, horizons: tuple[int, ...] = (5, 15), every: int = 1, key: str = E.KEY) -> DataFrame:
    """Samples at every bar with a whole window: pooled means and deviations before, states and returns after, path class and directions."""
    before, after = E.frame(pre, -1, key=key), E.frame(-1, post, key=key)
    i, n = F.row_number().over(E.series(key)) - 1, F.count("*").over(Window.partitionBy(key))
    x = bars.withColumns({"row_index": i, "_n": n, "_states": F.collect_list(state).over(after), "_after": F.collect_list("close").over(after)})
    x = x.withColumns({f"{m}_{c}": f(c).over(before) for c in features for m, f in (("mean", F.avg), ("std", F.stddev_pop))})
    x = x.withColumns({f"return_{h}": E.div(E.lag("close", -h, key=key), "close") - 1 for h in horizons})
    x = x.where((F.col("row_index") >= pre) & (F.col("row_index") <= F.col("_n") - post - 1) & ((F.col("row_index") - pre) % every == 0))
    x = x.withColumns({f"direction_up_{h}": (F.col(f"return_{h}") > 0).cast("int") for h in horizons})
    x = x.withColumn("post_returns", F.transform("_after", lambda v: v / F.col("close") - 1))
    names = [f"{m}_{c}" for c in features for m in ("mean", "std")] + [f"{k}_{h}" for h in horizons for k in ("return", "direction_up")]
    return x.select(key, "ts", "row_index", *names, "post_returns", path_class(F.col("_states"), F.col("post_returns")).alias("path"))
