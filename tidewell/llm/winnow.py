"""Document fingerprints by winnowing, in SQL expressions only.

Tokens are the words between white space.  Every ``GRAM`` consecutive tokens have a cyclic-polynomial rolling hash (the words'
hashes, each rotated by its distance from the gram's end, added without carry); of every ``WINDOW`` consecutive hashes the
least is selected, the rightmost of equal ones, and its position kept.  So two texts that share ``GRAM + WINDOW - 1``
consecutive tokens share a selected hash, and a passage of fewer than ``GRAM`` tokens shares none by design.  Hash and
reversed position are packed into one long (33 bits and 31 bits, as many as an array has places), whose minimum is the least
hash with rightmost ties.

Defined cases: null texts are empty; an empty text, or one of white space alone, has an empty fingerprint,
and two of those are alike to degree 1; a text of fewer than ``GRAM`` tokens is one gram, one of fewer
than ``WINDOW`` grams one window; the next document in descending doc_id order is the next row of least
doc_id below, rows of equal doc_id follow in descending order of text, null doc_ids come last, after
the last row comes the first (of one row, itself); an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm._shared import partitions

GRAM, WINDOW = 3, 4
#: Text of one bucket of doc_ids, about; bounds of buckets that are looked through at a time.
BUCKET_BYTES, FAN = 32 << 20, 64
_POSITIONS = 31


def _steps(n: Column, size: int) -> Column:
    """0 .. n - size, and 0 alone where n is positive but less than size."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def with_fingerprint(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds array<long> ``out``: selected (hash, position) pairs, packed, in order of position."""
    t, h, m = (f"_{x}_{out}" for x in "thm")
    df = df.withColumn(t, F.transform(tokens(F.col(text)), lambda w: F.xxhash64(w)))

    def rolled(i: Column) -> Column:
        parts = [_rotated(F.coalesce(F.get(F.col(t), i + j), F.lit(0)), gram - 1 - j) for j in range(gram)]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.bitwiseXOR(p)
        return F.xxhash64(whole)  # words of few bits in common stay spread after rotation; equal words in a row don't cancel

    pack = lambda i: F.shiftleft(F.shiftright(rolled(i), _POSITIONS), _POSITIONS) + (F.lit((1 << _POSITIONS) - 1) - i.cast("long"))
    df = df.withColumn(h, F.transform(_steps(F.size(t), gram), pack)).drop(t)
    least = lambda i: F.least(*[F.get(F.col(h), i + j) for j in range(window)])
    df = df.withColumn(m, F.transform(_steps(F.size(h), window), least)).drop(h)
    return df.withColumn(out, F.array_distinct(m)).drop(m)


def hashes(packed: Column) -> Column:
    """The distinct selected hashes, without positions."""
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, _POSITIONS)))


def rendered(packed: Column) -> Column:
    """``hash@position`` in hexadecimal and decimal, comma-joined."""
    full = (1 << _POSITIONS) - 1
    return F.array_join(F.transform(packed, lambda x: F.concat(F.hex(F.shiftrightunsigned(x, _POSITIONS)), F.lit("@"), (F.lit(full) - x.bitwiseAND(F.lit(full))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; of two empty ones 1."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def bucket_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most the value, by a search in two steps."""
    if not cuts:
        return F.lit(0)
    upto = lambda own: F.size(F.filter(own, lambda x: x <= value))
    one = lambda own: F.array(*[F.lit(x) for x in own]).cast("array<long>")
    groups = [cuts[i : i + FAN] for i in range(0, len(cuts), FAN)]
    coarse = F.greatest(upto(one([g[0] for g in groups])) - 1, F.lit(0))
    return coarse * FAN + upto(F.get(F.array(*[one(g) for g in groups]), coarse))


def with_next(docs: DataFrame, parts: int | None = None) -> tuple[DataFrame, Window]:
    """doc_id, text, bucket, guard; each bucket also holds a copy of the row that follows it (guard true).

    Buckets are ranges of doc_id, by the bytes of text; the returned window runs through a bucket in descending order.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if not parts:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(2 * partitions(docs.sparkSession), -(-size // BUCKET_BYTES))
    bounds = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(20 * parts))).first()[0] if parts > 1 else None
    cuts = sorted(set(bounds or []))
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - bucket_of(F.col("doc_id"), cuts))
    rows = rows.withColumn("bucket", place.cast("int")).withColumn("guard", F.lit(0))
    heads = rows.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "text")).alias("x"))
    numbers = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # as many as there are buckets
    after = {b: numbers[i - 1] for i, b in enumerate(numbers)}  # the first one follows the last
    target = F.element_at(F.create_map(*[F.lit(x) for b in after.items() for x in b]), F.col("bucket")) if after else F.col("bucket")
    guards = heads.select(F.col("x.doc_id").alias("doc_id"), F.col("x.text").alias("text"), target.alias("bucket"), F.lit(1).alias("guard"))
    within = Window.partitionBy("bucket").orderBy("guard", F.desc("doc_id"), F.desc("text"))
    return rows.unionByName(guards), within


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every row its fingerprint, that of its text with the last half replaced by the next document's opening, and likenesses."""
    rows, within = with_next(docs)
    rows = rows.withColumn("after", F.lead("text").over(within))
    rows = rows.withColumn("n_chars", F.length("text").cast("int")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - F.col("half")), F.substring("after", F.lit(1), F.col("half"))))
    rows = with_fingerprint(rows.drop("after"), "text", "packed")
    rows = rows.withColumn("own", hashes(F.col("packed"))).withColumn("following", F.lead("own").over(within)).where("guard = 0")
    rows = with_fingerprint(rows, "edited", "edited_packed")
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        rendered(F.col("packed")).alias("fingerprint"), rendered(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("own"), hashes(F.col("edited_packed"))).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
