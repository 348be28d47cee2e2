"""Mixing sources to target weights by hierarchical budgeting.

A tree of levels (domain, language, source) shares a token budget: every node divides its budget among its
children by weight, but a child takes no more than its capacity (its tokens times ``max_epochs``); what a
child can't take goes to its siblings by their weights, and only what a whole subtree can't take is left
to the ancestors' other children.  Each leaf then reads seeded epochs: a fresh order of its documents
per epoch, whole epochs while the budget lasts and of the last one the longest prefix whose tokens fit.

Prefixes need no global sort: hashes cut each leaf's epoch into ``slots``, sums per slot tell in which slot the
budget ends, and only that slot is ordered.  The number of slots grows with the rows, so a hot leaf is spread.
Only totals per leaf come to the driver.

Defined cases: null levels form a leaf of their own; null or empty texts have 0 tokens and
cost nothing, so they go along where a prefix reaches them; rows of equal doc_id are ordered by their text's
hash, wholly equal rows share a place and are taken or left together; a weight of 0 or a missing one (default 1) is possible;
a budget beyond all capacities takes everything; an empty table gives an empty result; extra columns are kept, whatever
their names, but for ``mix_epoch``, ``mix_tokens`` and ``mix_budget``, which are replaced.  Words are what stands between
white space of any kind; a text of white space alone has none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm._shared import Scratch

#: Rows of a slot, about.
SLOT_ROWS = 2000
OWN = ["mix_epoch", "mix_tokens", "mix_budget"]


def water_fill(budget: int, capacity: dict, weight: dict) -> dict:
    """Whole tokens for each child: by weight, at most its capacity, shortages shared out among the others."""
    out, left, open_ = dict.fromkeys(capacity, 0), min(budget, sum(capacity.values())), sorted(capacity, key=str)
    while left > 0 and open_:
        total = sum(weight[c] for c in open_)
        share = {c: left * weight[c] / total if total > 0 else left / len(open_) for c in open_}
        full = [c for c in open_ if share[c] >= capacity[c] - out[c]]
        if full:
            for c in full:
                left -= capacity[c] - out[c]
                out[c] = capacity[c]
            open_ = [c for c in open_ if c not in full]
            continue
        for c in open_:
            out[c] += int(share[c])
        rest = left - sum(int(share[c]) for c in open_)
        for c in sorted(open_, key=lambda c: (int(share[c]) - share[c], str(c))):
            take = min(rest, 1, capacity[c] - out[c])
            out[c] += take
            rest -= take
        left = 0
    return out


def budgets(leaves: dict[tuple, int], budget: int, weight: Callable[[tuple], float], max_epochs: int = 1) -> dict[tuple, int]:
    """Budget of each leaf.  leaves: tokens by path; weight: of the node at a path (relative to its siblings)."""
    capacity: dict[tuple, int] = {}
    children: dict[tuple, set] = {}
    for path, tokens in leaves.items():
        for n in range(len(path) + 1):
            capacity[path[:n]] = capacity.get(path[:n], 0) + tokens * max_epochs
            if n:
                children.setdefault(path[: n - 1], set()).add(path[:n])
    got, todo = {(): min(budget, capacity.get((), 0))}, [()]
    while todo:
        node = todo.pop()
        if own := children.get(node):
            got |= water_fill(got[node], {c: capacity[c] for c in own}, {c: weight(c) for c in own})
            todo += own
    return {path: got[path] for path in leaves}


def word_tokens(text) -> F.Column:
    """Words between white space, as the measure of a budget."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"\S+")).cast("long")


def mix(docs: DataFrame, levels: list[str], budget: float, weight: Callable[[tuple], float] = lambda path: 1.0, max_epochs: int = 1, seed: int = 17, tokens=None) -> DataFrame:
    """All selected rows, once per epoch that selects them, with mix_epoch, mix_tokens and mix_budget (the leaf's).

    budget: tokens, or a share of all tokens if below 1 or a float up to ``max_epochs``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    # columns go by their place, so that no name of the input can clash with those of the plan
    kept = [c for c in docs.columns if c.lower() not in OWN]
    place_ = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64(F.col("text").cast("string"))))
    measure = tokens if tokens is not None else word_tokens(F.col("text"))
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], measure.cast("long").alias("mix_tokens"), F.array(*[F.col(c).cast("string") for c in levels]).alias("mix_own"), place_.alias("mix_name"))
    leaves = own.groupBy("mix_own").agg(F.sum("mix_tokens").alias("t"), F.count("*").alias("n")).collect()  # a row per leaf
    sizes = {tuple(r.mix_own): int(r.t) for r in leaves}
    rows = {tuple(r.mix_own): r.n for r in leaves}
    total = int(budget * sum(sizes.values())) if isinstance(budget, float) else budget
    given = budgets(sizes, total, weight, max_epochs)
    plan = []
    for path, tokens_ in sizes.items():
        whole = min(given[path] // tokens_, max_epochs) if tokens_ else 1
        slots = -(-rows[path] // SLOT_ROWS)
        plan += [(list(path), e, slots, given[path], -1 if e < whole else given[path] - whole * tokens_) for e in range(min(whole + 1, max_epochs))]
    plan_df = spark.createDataFrame(plan, "mix_path array<string>, mix_epoch int, mix_slots int, mix_budget long, mix_rest long")
    place = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("mix_epoch").cast("string"), "mix_name"))

    def spread(by_leaf: DataFrame) -> DataFrame:
        """Every row once per epoch of its leaf, with its place and slot there."""
        by_leaf = F.broadcast(by_leaf) if len(plan) <= 20_000 else by_leaf  # a leaf's row takes about 100 bytes
        x = own.join(by_leaf, F.col("mix_own").eqNullSafe(F.col("mix_path"))).drop("mix_own").withColumn("mix_place", place)
        return x.withColumn("mix_slot", F.floor(F.conv(F.substring("mix_place", 1, 12), 16, 10).cast("long") * F.col("mix_slots") / F.lit(float(1 << 48))).cast("int"))

    wide = spread(plan_df)
    key = ["mix_path", "mix_epoch"]
    sums = scratch.table("sums", wide.where("mix_rest >= 0").groupBy(*key, "mix_slot", "mix_rest").agg(F.sum("mix_tokens").alias("mix_sum")))
    through = Window.partitionBy(*key).orderBy("mix_slot")  # rows per slot, not per document
    ends = sums.withColumn("mix_to", F.sum("mix_sum").over(through)).where("mix_to > mix_rest and mix_to - mix_sum <= mix_rest")
    ends = ends.groupBy(*key).agg(F.min(F.struct("mix_slot", (F.col("mix_rest") - F.col("mix_to") + F.col("mix_sum")).alias("room"))).alias("x"))
    cuts = plan_df.join(ends, key, "left").select(*key, "mix_slots", "mix_budget", F.coalesce("x.mix_slot", "mix_slots").alias("mix_cut"), F.coalesce("x.room", F.lit(0)).alias("mix_room"))
    placed = spread(scratch.table("cuts", cuts))
    inside = Window.partitionBy(*key).orderBy("mix_place").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # of one slot
    last = placed.where("mix_slot = mix_cut").withColumn("mix_upto", F.sum("mix_tokens").over(inside)).where("mix_upto <= mix_room")
    out = [*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *OWN]
    scratch.keep("cuts")
    return placed.where("mix_slot < mix_cut").select(*out).unionByName(last.select(*out))
