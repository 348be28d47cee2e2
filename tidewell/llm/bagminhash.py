"""Near-duplicate classes by BagMinHash signatures of five-word shingle multisets.

Weights (multiplicities) are discretised at the integers, and the half-line is cut into dyadic levels
[0,1), [1,2), [2,4), [4,8) ...  Every element owns one Poisson process per level, of rate equal to the
level's width; each point falls into a random register.  A weight w takes all points of its full levels
and thins the points of the last level to those whose position lies below w, so equal parts of two weights
share their points: register minima agree with probability equal to the weighted Jaccard similarity.
Points are made in ascending order up to a bound at which every register of the document is filled, so
work is proportional to distinct shingles plus registers, not to weights.

Classes are the connected components of all links of weighted Jaccard ``threshold`` or more between
candidates that share a band:

1. exact copies (equal multisets by a 128-bit key) fold into one node;
2. every bucket's least node is its pivot; each member is verified against it, and the links give components;
3. where the members of a pivot still fall into several components, those outside the largest are compared, in
   blocks, with all members of other components, exactly.  So a chain that misses the pivot is found too; only links
   leave a block, nothing is capped, and no candidate is left out by an estimate.

Defined cases: texts without words (null, empty, punctuation only) are compared with nothing and each is
its own class; texts of fewer than five words are one shingle; null doc_ids are not compared, and
their class is null; every input row gives a row, repeated ones too; the class id is the least doc_id of the class;
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._shared import Scratch, partitions, trim
from tidewell.llm._text import mix, shingled
from tidewell.llm.graph import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Words of the few in one block, members that meet one copy of it, members that meet one copy of a pivot's text.
BLOCK_WORDS, SPREAD_ROWS, SALT_ROWS = 400_000, 2048, 2000
_U = np.uint64


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((h >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (n_docs x registers, uint64; all ones where a document has no elements).

    doc, element, weight: the distinct elements of each document with their multiplicities.
    """
    out = np.full((n_docs, registers), np.inf)
    total = np.bincount(doc, weight, n_docs)
    todo = np.flatnonzero(total > 0)
    bound = np.zeros(n_docs)
    bound[todo] = registers / total[todo] * (np.log(registers) + 2.5)
    pick = np.arange(len(doc))
    while len(todo):
        d, e, w = doc[pick], element[pick], weight[pick]
        # level l covers [2**(l-1), 2**l), level 0 covers [0, 1)
        top = np.where(w > 1, np.ceil(np.log2(np.maximum(w, 1))).astype(np.int64), 0)
        level = np.arange((top + 1).sum()) - np.repeat(np.cumsum(top + 1) - top - 1, top + 1)
        d, e, w = np.repeat(d, top + 1), np.repeat(e, top + 1), np.repeat(w, top + 1)
        low = np.where(level > 0, 2.0 ** np.maximum(level - 1, 0), 0.0)
        width = np.where(level > 0, low, 1.0)
        share = np.minimum((w - low) / width, 1.0)
        state = mix(e + level.astype(_U) * _U(0xA24BAED4963EE407))
        t = np.zeros(len(d))
        rate, most = width, bound[d]
        while len(d):
            state = mix(state)
            t = t - np.log(_unit(state)) / rate
            live = t < most
            if not live.all():
                d, t, state, rate, most, share = d[live], t[live], state[live], rate[live], most[live], share[live]
            where = mix(state ^ _U(0x94D049BB133111EB))
            own = share >= 1.0
            if not own.all():  # thinning of the last level
                own |= _unit(mix(where ^ _U(0xBF58476D1CE4E5B9))) <= share
                dd, tt, ww = d[own], t[own], where[own]
            else:
                dd, tt, ww = d, t, where
            np.minimum.at(out.reshape(-1), dd * registers + ((ww >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64), tt)
        todo = todo[np.isinf(out[todo]).any(1)]
        bound[todo] *= 2
        again = np.zeros(n_docs, bool)
        again[todo] = True
        out[todo] = np.inf
        pick = np.flatnonzero(again[doc])
    return out.view(_U)


def multisets(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each text: text, element, multiplicity; sorted by text and element."""
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def content_keys(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of the multisets; equal multisets have equal keys."""
    keys = []
    for salt in (0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1):
        x = mix(mix(element ^ _U(salt)) + weight.astype(_U) * _U(0x9E3779B97F4A7C15))
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(x)])
        at = np.searchsorted(doc, np.arange(n_docs + 1))
        keys.append(mix(sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return keys[0], keys[1]


SIGNED = "doc_id long, tag long, k1 long, k2 long, words long, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, h, begin, words in shingled(b.column(2), SHINGLE):
            n = len(words)
            doc, element, weight = multisets(h, begin)
            k1, k2 = content_keys(doc, element, weight, n)
            # of equal texts in a chunk, one is signed
            _, first, back = np.unique(k1, return_index=True, return_inverse=True)
            own = np.zeros(n, bool)
            own[first] = True
            slot = np.cumsum(own) - 1
            take = own[doc]
            sig = signatures(slot[doc[take]], element[take], weight[take].astype(np.float64), int(own.sum()))[slot[first[back]]]
            sig = mix(sig)
            bands = np.zeros((n, BANDS), _U)
            for r in range(ROWS):
                bands = mix(bands ^ sig[:, r::ROWS])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(row, n), b.column(1).slice(row, n), pa.array(k1), pa.array(k2), pa.array(words.astype(np.int64)), flat], ["doc_id", "tag", "k1", "k2", "words", "bands"])
    trim()


PAIRS = "u long, v long"


def _jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets given as sorted elements and multiplicities."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0]
    both = int(np.minimum(a[1][at[same]], b[1][same]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def _verify(threshold: float):
    """Rows (pivot, salt, member, node, text), a pivot's own text before its members', to links (u pivot, v member)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _links(batches, threshold)

    return run


def _links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    key, held = None, None
    for b in batches:
        pivot, salt, member, node = (b.column(i).to_pylist() for i in range(4))
        out = []
        for row, h, begin, words in shingled(b.column(4), SHINGLE):
            doc, element, weight = multisets(h, begin)
            cut = np.searchsorted(doc, np.arange(len(words) + 1))
            for d in range(len(words)):
                i = row + d
                own = element[cut[d] : cut[d + 1]], weight[cut[d] : cut[d + 1]]
                if not member[i]:
                    key, held = (pivot[i], salt[i]), own
                elif key == (pivot[i], salt[i]):
                    if _jaccard(held, own) >= threshold - 1e-12:
                        out.append((pivot[i], node[i]))
        cols = list(zip(*out, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v"])
    trim()


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u pivot, v member) whose exact similarity reaches the threshold.  nodes: node, doc_id, tag; texts: doc_id, tag, text."""
    spark = pairs.sparkSession
    n = partitions(spark)
    wanted = pairs.select(F.col("v").alias("node")).unionByName(pairs.select(F.col("u").alias("node"))).distinct()
    text = texts.join(nodes.join(wanted, "node"), ["doc_id", "tag"]).select("node", "text").dropDuplicates(["node"])
    sizes = pairs.groupBy("u").count().select("u", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("salts"))
    members = pairs.join(sizes, "u").select("u", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"), F.col("v").alias("node"))
    pivots = sizes.select("u", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("u").alias("node"))
    rows = members.unionByName(pivots).join(text, "node").select("u", "salt", "member", "node", "text")
    return rows.repartition(n, "u", "salt").sortWithinPartitions("u", "salt", "member").mapInArrow(_verify(threshold), PAIRS)


class _Merged(dict):
    """Components merged by the links that this task has found."""

    def root(self, x: int) -> int:
        while x in self:
            x = self[x]
        return x


class _Few:
    """Multisets side by side, as one array of elements with the multisets that hold them."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        element = np.concatenate([e for e, _ in sets])
        order = np.argsort(element, kind="stable")
        self.element = element[order]
        self.owner = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])[order]
        self.weight = np.concatenate([w for _, w in sets])[order]
        self.total = np.array([w.sum() for _, w in sets])

    def similarities(self, own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Weighted Jaccard similarity of every multiset and ``own``."""
        lo, hi = np.searchsorted(self.element, own[0], "left"), np.searchsorted(self.element, own[0], "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        both = np.bincount(self.owner[at], np.minimum(self.weight[at], np.repeat(own[1], n)), len(self.total))
        return both / (self.total + own[1].sum() - both)


def _blocks(threshold: float):
    """Rows (block key, side, node, component, text), side false (the few) before side true (all), to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, few, table, merged = None, [], None, _Merged()
        for b in batches:
            keys, side, node, comp = (b.column(i).to_pylist() for i in range(4))
            out = []
            for row, h, begin, words in shingled(b.column(4), SHINGLE):
                doc, element, weight = multisets(h, begin)
                cut = np.searchsorted(doc, np.arange(len(words) + 1))
                for d in range(len(words)):
                    i = row + d
                    if keys[i] != key:
                        key, few, table = keys[i], [], None
                    own = element[cut[d] : cut[d + 1]], weight[cut[d] : cut[d + 1]]
                    if not side[i]:
                        few.append((node[i], comp[i], own))
                        table = None
                    elif few:
                        table = table or _Few([x[2] for x in few])
                        for x in np.flatnonzero(table.similarities(own) >= threshold - 1e-12).tolist():
                            r, q = merged.root(few[x][1]), merged.root(comp[i])
                            if r != q:
                                merged[max(r, q)] = min(r, q)
                                out.append((few[x][0], node[i]))
            cols = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v"])
        trim()

    return run


def _leftover(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, comps: DataFrame, threshold: float) -> DataFrame:
    """Links across components among the members of a pivot, found in blocks.

    pairs: u pivot, v member; nodes: node, doc_id, tag, words.  Two nodes of one bucket share its pivot.
    """
    n = partitions(pairs.sparkSession)
    members = pairs.select(F.col("u").alias("pivot"), F.col("v").alias("node")).unionByName(pairs.select(F.col("u").alias("pivot"), F.col("u").alias("node")).distinct())
    ids = members.join(nodes.select("node", "words"), "node").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = ids.groupBy("pivot", "component").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    largest = parts.groupBy("pivot").agg(F.max(F.struct("n", "w", "component")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("parts")).where("parts > 1")
    size = largest.select("pivot", F.col("top.component").alias("top"), F.ceil((F.col("w") - F.col("top.w")) / BLOCK_WORDS).cast("int").alias("blocks"), F.ceil(F.col("n") / SPREAD_ROWS).cast("int").alias("spread"))
    wanted = ids.select("pivot", "node", "component").join(size, "pivot")
    own = nodes.join(wanted.select("node").distinct(), "node").join(texts, ["doc_id", "tag"]).select("node", "text").dropDuplicates(["node"])
    block, part = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("spread"))
    key = lambda x, y: F.concat_ws("/", "pivot", x, y)
    few = wanted.where("component <> top").select("*", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("y")).select(key(block, F.col("y")).alias("key"), F.lit(False).alias("side"), "node", "component")
    every = wanted.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x")).select(key(F.col("x"), part).alias("key"), F.lit(True).alias("side"), "node", "component")
    rows = few.unionByName(every).join(own, "node").select("key", "side", "node", "component", "text")
    return rows.repartition(n, "key").sortWithinPartitions("key", "side").mapInArrow(_blocks(threshold), PAIRS)


def _classified(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, tag, words, k1, k2: null where the row isn't compared), and the classes (k1, k2, component, class_id, class_size)."""
    scratch = Scratch(docs.sparkSession, "bagminhash")
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    signed = scratch.table("signed", texts.mapInArrow(_sign, SIGNED).withColumn("row", F.monotonically_increasing_id()))
    live = signed.where("words > 0 and doc_id is not null")
    folds = scratch.table("nodes", live.groupBy("k1", "k2").agg(F.min(F.struct("row", "doc_id", "tag", "words")).alias("x"), F.min("doc_id").alias("least"), F.count("*").alias("copies")).select("k1", "k2", "x.*", "least", "copies").withColumnRenamed("row", "node"))
    bands = signed.join(folds.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), F.posexplode("bands").alias("band", "bh"))
    pivots = bands.groupBy("band", "bh").agg(F.min("node").alias("u"), F.count("*").alias("n")).where("n > 1").select("band", "bh", "u")
    pairs = scratch.table("pairs", bands.join(pivots, ["band", "bh"]).where("node <> u").select("u", F.col("node").alias("v")).distinct())
    links = scratch.table("links", verified(pairs, folds.select("node", "doc_id", "tag"), texts, threshold))
    comps = components(links, scratch, "first")
    later = scratch.table("later", _leftover(pairs, folds.select("node", "doc_id", "tag", "words"), texts, comps, threshold))
    comps = scratch.table("comps", components(links.unionByName(later), scratch, "second"))
    classed = folds.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = classed.join(classed.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size")), "component").select("k1", "k2", "component", "class_id", "class_size")
    named = scratch.table("classes", named)
    scratch.keep("signed", "classes")
    return signed.select("doc_id", "tag", "words", F.when(F.expr("words > 0 and doc_id is not null"), F.col("k1")).alias("k1"), "k2"), named


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, class_size, words) for every input row; class_id is the least doc_id of its class."""
    rows, named = _classified(docs, threshold)
    out = rows.join(named, ["k1", "k2"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "words")


def one_of_each(docs: DataFrame, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The given columns of one row of each class, that of least doc_id (of those, of least text hash), and of all rows that aren't compared.

    Decided by row, so documents that share a doc_id are told apart by their texts; of wholly equal rows one stays.
    """
    rows, named = _classified(docs, threshold)
    key = ["doc_id", "tag"]
    compared = rows.join(named.select("k1", "k2", "component"), ["k1", "k2"])
    first = compared.groupBy("component").agg(F.min(F.struct(*key)).alias("first"))
    gone = compared.join(first, "component").where(F.struct(*key) > F.col("first")).select(*key).distinct()
    again = rows.where("doc_id is not null").groupBy(*key).count().where("count > 1").select(*key).join(gone, key, "left_anti")
    own = docs.select(*columns, F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_tag"))
    named_ = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"))
    alone = own.join(named_(gone.unionByName(again)), ["_id", "_tag"], "left_anti")
    return alone.unionByName(own.join(named_(again), ["_id", "_tag"]).dropDuplicates(["_id", "_tag"]).select(*own.columns)).select(*columns)
