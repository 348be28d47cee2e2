"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by their number of distinct five-word shingles (powers of two).  The signature of
an item is its bottom-m MinHash sketch: its m shingles of least hash.  For containment t, an item of n
shingles may lack at most ``n - ceil(t n)`` of them, so with ``m = n - ceil(t n) + 1`` every text that
contains the item to that degree holds at least one shingle of the signature: m is set for each size
partition from its largest size, so the search loses nothing, however long the text is.  A candidate's
containment is then counted exactly over the whole text.

An item of one to four words is one shingle of its own length, and texts are cut into shingles of that length too, so it
is found inside a longer text like any other.

A benchmark of up to ``SLICE_CHARS`` characters is sent to all executors and the documents are read once.  A larger one
stays in tables: texts send out the shingles that a bit table of the benchmark's lets through (of a fixed size, so a larger
benchmark lets more through but loses nothing), which meet the signatures and then, for candidates, all shingles in joins.

Defined cases: null or empty texts and items (without words) match nothing; null ids are kept
as null; repeated rows of documents give a row each; an item id that occurs with several texts counts once
per text; empty tables give an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm._shared import Scratch, bound_batches, trim
from tidewell.llm._text import hashed, mix, shingles

SHINGLE, THRESHOLD = 5, 0.8
#: Most characters of items that are sent to the executors (a few tens of MB there).
SLICE_CHARS = 8 << 20
#: Bits of a hash that number the places of the bit tables: of the index, and of a benchmark that stays in tables (8 MB).
_BITS, _TABLE_BITS = 20, 26
SCHEMA = "doc_id long, item_id long, item_shingles long, shared_shingles long, containment double"


def signature_size(n: int, threshold: float) -> int:
    """Shingles in the sketch of an item of n: enough for the largest size of its partition."""
    upper = 1 << int(n - 1).bit_length()
    return upper - int(np.ceil(threshold * upper - 1e-9)) + 1


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For every text: the length of its shingles (k, or its words if fewer; 0 without words) and their distinct hashes."""
    for _, words, first in hashed(column):
        n = np.diff(first)
        cut = {size: shingles(words, first, size) for size in set(np.minimum(n, k).tolist()) if size}
        for i, size in enumerate(np.minimum(n, k).tolist()):
            h, begin = cut.get(size, (np.zeros(0, np.uint64), None))
            yield size, np.unique(h[begin[i] : begin[i + 1]] ^ _length(size)) if size else h


def text_shingles(column: pa.Array, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk and length: row of its first text, hashes of all shingles of the length, and their starts by text."""
    for row, words, first in hashed(column):
        for size in sizes:
            h, begin = shingles(words, first, size)
            yield row, h ^ _length(size), begin


def _length(size: int) -> np.uint64:
    """Tells shingles of different lengths apart; nothing for the usual length."""
    return mix(np.array([size], np.uint64))[0] if size != SHINGLE else np.uint64(0)


class ItemIndex:
    """Signatures of items, by size partition, as one sorted array with the items that own each hash."""

    def __init__(self, ids: list, texts: list[str], threshold: float = THRESHOLD, k: int = SHINGLE):
        got = list(shingle_sets(pa.array(texts, pa.large_string()), k))
        self.ids, self.sets, self.threshold = ids, [own for _, own in got], threshold
        self.sizes = sorted({size for size, _ in got if size})
        keys, owners = [], []
        for item, own in enumerate(self.sets):
            if len(own):
                own = own[: signature_size(len(own), threshold)]
                keys.append(own)
                owners.append(np.full(len(own), item))
        keys, owners = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *owners])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.keys >> np.uint64(64 - _BITS)] = True

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h and items, for every shingle of h that is in an item's signature."""
        at = np.flatnonzero(self.bits[h >> np.uint64(64 - _BITS)])
        lo, hi = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
        n = hi - lo
        first = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else lo
        return np.repeat(at, n), self.owners[np.arange(n.sum()) + first]

    def found(self, column: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of every text that contains an item to the threshold."""
        for row, h, begin in text_shingles(column, self.sizes):
            at, item = self.probe(h)
            doc = np.searchsorted(begin, at, "right") - 1
            for d, i in sorted(set(zip(doc.tolist(), item.tolist(), strict=True))):
                own = self.sets[i]
                n = int(np.isin(own, h[begin[d] : begin[d + 1]]).sum())
                if n >= self.threshold * len(own) - 1e-9:
                    yield row + d, i, n


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for b in batches:
            ids = b.column(0)
            out = [(ids[r].as_py(), x.ids[i], len(x.sets[i]), n, n / len(x.sets[i])) for r, i, n in x.found(b.column(1))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.float64()]
            names = ["doc_id", "item_id", "item_shingles", "shared_shingles", "containment"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return run


def _without(index):
    """Keeps the rows whose last column, a text, contains no item; all columns pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for r, _, _ in index.value.found(b.column(b.num_columns - 1)):
                keep[r] = False
            yield b.filter(pa.array(keep))
        trim()

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    item = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return item.where(F.length("text") > 0).distinct()


def _index(spark: SparkSession, items: DataFrame, threshold: float, k: int):
    """The broadcast index, or None if the benchmark is too large to be sent."""
    if items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] > SLICE_CHARS:
        return None
    rows = items.collect()
    return spark.sparkContext.broadcast(ItemIndex([r.item_id for r in rows], [r.text for r in rows], threshold, k))


def _item_shingles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column(1), k))
            n = [len(own) for _, own in sets]
            at = pa.array(np.repeat(np.arange(len(n)), n))
            place = np.concatenate([np.zeros(0, np.int64), *(np.arange(x) for x in n)])
            size = np.repeat(np.array([s for s, _ in sets], np.int32), n)
            h = np.concatenate([np.zeros(0, np.uint64), *(own for _, own in sets)]).view(np.int64)
            cols = [b.column(0).take(at), pa.array(h), pa.array(place), pa.array(np.repeat(np.array(n, np.int64), n)), pa.array(size)]
            yield pa.RecordBatch.from_arrays(cols, ["item", "h", "place", "n", "size"])

    return run


def _hits(bits, sizes: list[int]):
    """(doc_id, row_key, h) for the distinct shingles of each text that the bit table lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, h, begin in text_shingles(b.column(2), sizes):
                top = (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
                at = np.flatnonzero(bits.value[top >> 3] >> (top & 7).astype(np.uint8) & 1)
                doc = np.searchsorted(begin, at, "right") - 1
                own = np.unique(np.stack([doc, h[at].view(np.int64)]), axis=1)
                which = pa.array(row + own[0])
                yield pa.RecordBatch.from_arrays([b.column(0).take(which), b.column(1).take(which), pa.array(own[1])], ["doc_id", "row_key", "h"])

    return run


def _joined(spark: SparkSession, texts: DataFrame, items: DataFrame, threshold: float, k: int) -> DataFrame:
    """The search with a benchmark of any size; texts: doc_id, text."""
    scratch = Scratch(spark, "decontam")
    items = scratch.table("items", items.withColumn("item", F.monotonically_increasing_id()))
    owned = items.select("item", "text").mapInArrow(_item_shingles(k), "item long, h long, place long, n long, size int")
    owned = scratch.table("shingles", owned)
    byte = F.shiftrightunsigned("h", 64 - _TABLE_BITS + 3)
    bit = F.expr(f"shiftleft(1, cast(shiftrightunsigned(h, {64 - _TABLE_BITS}) & 7 as int))")
    got = owned.select(byte.alias("at"), bit.alias("b")).groupBy("at").agg(F.bit_or("b").alias("b"))
    got = got.toArrow()  # as many rows as the table has bytes, at most
    table = np.zeros(1 << (_TABLE_BITS - 3), np.uint8)
    table[got["at"].to_numpy()] = got["b"].to_numpy().astype(np.uint8)
    sizes = sorted(r.size for r in owned.select("size").distinct().collect())  # 1 to k
    rows = texts.withColumn("row_key", F.monotonically_increasing_id()).select("doc_id", "row_key", "text")
    hits = scratch.table("hits", rows.mapInArrow(_hits(spark.sparkContext.broadcast(table), sizes), "doc_id long, row_key long, h long"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double"))))
    signed = owned.where(F.col("place") < upper - F.ceil(threshold * upper - 1e-9) + 1).select("item", "h")
    pairs = hits.join(signed, "h").select("row_key", "item").distinct()
    both = hits.join(owned.select("item", "h", "n"), "h").join(pairs, ["row_key", "item"])
    both = both.groupBy("row_key", "doc_id", "item", "n").agg(F.count("*").alias("shared")).where(F.col("shared") >= threshold * F.col("n") - 1e-9)
    named = both.join(items.select("item", "item_id"), "item")
    return named.select("doc_id", "item_id", F.col("n").alias("item_shingles"), F.col("shared").alias("shared_shingles"), (F.col("shared") / F.col("n")).alias("containment"))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains to the degree ``threshold`` or more."""
    bound_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = _items(benchmark)
    index = _index(spark, items, threshold, k)
    return texts.mapInArrow(_search(index), SCHEMA) if index else _joined(spark, texts, items, threshold, k)


def clean_rows(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, columns: list[str], threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """The rows of docs, with the given columns, whose text contains no benchmark item."""
    bound_batches(spark)
    items = _items(benchmark)
    index = _index(spark, items, threshold, k)
    if index:
        rows = docs.select(*columns, F.col("text").cast("string").alias("_text"))
        return rows.mapInArrow(_without(index), rows.schema).drop("_text")
    keyed = docs.select(*columns, F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("_key"))
    texts = docs.select(F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _joined(spark, texts, items, threshold, k).select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(found, "_key", "left_anti").select(*columns)
