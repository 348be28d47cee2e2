"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased words and their openings of four and five letters; the vocabulary holds the terms whose presence
clearly depends on the label (log-likelihood ratio of document counts in the sample, and lift).  The length of a text takes
in its other words too, so a term that a long text shows once by chance says less than terms that fill a text.  A query's upper bound
for a block of examples is the sum of its weights times the block's greatest weight of each term; blocks are taken
from the highest bound down until no bound can beat the k-th best, so the neighbours are exact.  Their
votes, weighted by similarity, are drawn towards the base rate, so that few or distant neighbours say little.

Examples are at most ``SAMPLE`` labelled rows of each label, those of least hash of doc_id, one of each group
of near copies; document frequencies are counted over all documents.  Labels, lang, source and doc_id are inputs of no score.

Defined cases: null texts are empty; a text without terms of the vocabulary (an empty one too) gets the base
rate; a doc_id with several labels takes the highest; null labels aren't learnt; without examples of
both labels every score is the base rate (0 without labels); ties of similarity go to the least doc_id; null
doc_ids and repeated rows are scored and kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._shared import bound_batches
from tidewell.llm._text import shingled
from tidewell.llm.quality import remainder

#: Most labelled examples of each label; most terms; how many times as often one label must show a term.
SAMPLE, TERMS, LEAST_LIFT = 4000, 4096, 3.0
NEAREST, PULL, BLOCK, FIRST = 16, 0.5, 64, 8
_WORD = re.compile(r"\w+")
_CACHE = 300_000


def terms_of(word: str) -> tuple[str, ...]:
    """A word and its openings."""
    return (word, *(word[:n] + "*" for n in (4, 5) if len(word) > n))


class _Lookup(dict):
    """Word to the numbers of its terms in the vocabulary."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _CACHE:
            self.clear()
        out = self[word] = tuple(self.vocabulary[t] for t in terms_of(word) if t in self.vocabulary)
        return out


def vector(text: str, lookup: _Lookup, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and TF-IDF weights (1 + ln tf) of a whole text, over a length in which each other distinct word counts as 1."""
    counts: Counter[int] = Counter()
    other = 0
    for word, n in Counter(_WORD.findall(text.lower())).items():
        own = lookup[word]
        other += not own
        for t in own:
            counts[t] += n
    at = np.array(sorted(counts), np.int64)
    w = (1 + np.log(np.array([counts[i] for i in at.tolist()], np.float64))) * idf[at] if len(at) else np.zeros(0)
    return at, w / np.sqrt((w**2).sum() + other) if len(at) else w


class BlockMaxIndex:
    """Exact top-k cosine over labelled examples."""

    def __init__(self, vocabulary: dict[str, int], idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], base: float):
        self.vocabulary, self.idf, self.base = vocabulary, idf, base
        lead = np.array([v[0][v[1].argmax()] if len(v[0]) else -1 for v in vectors], np.int64)
        order = np.lexsort((ids, lead))  # examples of one leading term share blocks, which sharpens the bounds
        order = order[lead[order] >= 0]
        self.ids, self.labels = ids[order], labels[order].astype(np.float64)
        self.blocks = -(-len(order) // BLOCK)
        term = np.concatenate([np.zeros(0, np.int64), *(vectors[i][0] for i in order)])
        weight = np.concatenate([np.zeros(0), *(vectors[i][1] for i in order)])
        row = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order]) if len(order) else np.zeros(0, np.int64)
        by = np.lexsort((row, term))
        self.row, self.weight = row[by], weight[by]
        self.begin = np.searchsorted(term[by], np.arange(len(idf) + 1))
        self.bounds = []
        for t in range(len(idf)):
            own = slice(self.begin[t], self.begin[t + 1])
            block = self.row[own] // BLOCK
            at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
            top = np.maximum.reduceat(self.weight[own], at) if len(at) else np.zeros(0)
            self.bounds.append((block[at], top, np.append(at, len(block)) + self.begin[t]))

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """Rows and similarities of the k nearest examples of positive similarity; ties by least doc_id."""
        bound = np.zeros(self.blocks)
        for t, x in zip(at.tolist(), w.tolist(), strict=True):
            block, top, _ = self.bounds[t]
            bound[block] += x * top
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        first, rest = order[:FIRST], order[FIRST:]
        rows, best = self._best(first, at, w, np.zeros(0, np.int64), np.zeros(0), k)
        if len(best) >= k:  # no example of a block below this bound can be among the nearest
            rest = rest[bound[rest] >= best[k - 1] - 1e-12]
        return self._best(rest, at, w, rows, best, k) if len(rest) else (rows, best)

    def _best(self, take: np.ndarray, at: np.ndarray, w: np.ndarray, rows: np.ndarray, best: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of those at hand and all examples of the given blocks."""
        seen = np.zeros(self.blocks, bool)
        seen[take] = True
        most = 4 * len(take) > self.blocks
        score = np.zeros(self.blocks * BLOCK)
        for t, x in zip(at.tolist(), w.tolist(), strict=True):
            if most:
                own = slice(self.begin[t], self.begin[t + 1])
                score[self.row[own]] += x * self.weight[own]
                continue
            block, _, cut = self.bounds[t]
            for j in np.flatnonzero(seen[block]).tolist():
                own = slice(cut[j], cut[j + 1])
                score[self.row[own]] += x * self.weight[own]
        if most:
            score.reshape(-1, BLOCK)[~seen] = 0
        found = np.flatnonzero(score > 0)
        if len(found) > 4 * k:
            found = found[score[found] >= np.partition(score[found], -k)[-k] - 1e-12]
        rows, best = np.concatenate([rows, found]), np.concatenate([best, score[found]])
        keep = np.lexsort((self.ids[rows], -np.round(best, 12)))[:k]
        return rows[keep], best[keep]

    def vote(self, rows: np.ndarray, similarity: np.ndarray) -> float:
        """Votes weighted by squared similarity, with PULL votes at the base rate."""
        w = similarity**2
        return float((w @ self.labels[rows] + PULL * self.base) / (w.sum() + PULL))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least shingle hash: near copies share it as often as they are alike."""
    for b in batches:
        keys = []
        for _, h, begin, _ in shingled(b.column(2)):
            keys += [int(h[x:y].min().view(np.int64)) if y > x else 0 for x, y in zip(begin[:-1], begin[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], ["doc_id", "label", "text", "key"])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            seen[label].update({t for w in set(_WORD.findall((text.as_py() or "").lower())) for t in terms_of(w)})
        for label in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(list(seen[label]), pa.string()), pa.array([label] * len(seen[label]), pa.int32()), pa.array(list(seen[label].values()), pa.int64())], ["term", "label", "n"])


def _presence(vocabulary: dict[str, int]):
    """(number of a term, texts that hold it), and under -1 all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = _Lookup(vocabulary), np.zeros(len(vocabulary), np.int64)
        rows = 0
        for b in batches:
            rows += b.num_rows
            for text in b.column(0):
                for t in {t for w in set(_WORD.findall((text.as_py() or "").lower())) for t in lookup[w]}:
                    total[t] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows))], ["at", "n"])

    return run


def _contexts(terms: set[str]):
    """(term, label, hash of the words before and after) for every occurrence of the given terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for b in batches:
            out = []
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = ["", *_WORD.findall((text.as_py() or "").lower()), ""]
                for i in range(1, len(words) - 1):
                    w = words[i]
                    if w not in known:
                        known[w] = tuple(x for x in terms_of(w) if x in terms)
                    for x in known[w]:
                        out.append((x, label, zlib.crc32(f"{words[i - 1]} {words[i + 1]}".encode())))
            if len(known) > _CACHE:
                known.clear()
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cols, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["term", "label", "context"])

    return run


def _telling(counts: DataFrame, t: int, c: int, least: float) -> DataFrame:
    """Terms (a toxic documents of t, b others of c) that depend on the label, with their log-likelihood ratio."""
    part = lambda seen, expected: F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(c + t)
    have = a + b
    ratio = 2 * (part(a, have * t / n) + part(b, have * c / n) + part(t - a, (n - have) * t / n) + part(c - b, (n - have) * c / n))
    lift = (a + 0.5) / (t + 1) / ((b + 0.5) / (c + 1))
    return counts.withColumn("ratio", ratio).where((F.col("ratio") >= least) & ((lift >= LEAST_LIFT) | (lift <= 1 / LEAST_LIFT)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fold: int = 3, held: int = 1, sample: int = SAMPLE, terms: int = TERMS) -> BlockMaxIndex:
    """An index of labelled examples outside the held-out fold, ``sample`` of each label at most."""
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), fold) != held)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    base = known.agg(F.avg("label")).first()[0] or 0.0
    few = None
    for label in (0, 1):
        own = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        few = own if few is None else few.unionByName(own)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(few), "doc_id").select("doc_id", "label", "text")  # at most 2 * sample rows of 12 bytes
    rows = rows.mapInArrow(_sampled, "doc_id long, label int, text string, key long").groupBy("label", "key").agg(F.min(F.struct("doc_id", "text")).alias("x")).select("x.doc_id", "label", "x.text").persist()
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    c, t = sizes.get(0, 0), sizes.get(1, 0)
    if not c or not t:
        rows.unpersist()
        return BlockMaxIndex({}, np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), [], float(base))
    counts = rows.select("label", "text").mapInArrow(_document_counts, "term string, label int, n long").groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b")).where("a + b >= 3").persist()
    least = 2 * math.log(max(counts.count(), 1)) + 2  # of that many terms about one in twenty samples has one by chance
    first = _telling(counts, t, c, least).orderBy(F.desc("ratio"), "term").limit(terms).collect()
    # near copies repeat a term in one context: the effective number of contexts (inverse Simpson) bounds the documents
    seen = rows.select("label", "text").mapInArrow(_contexts({r.term for r in first}), "term string, label int, context long").groupBy("term", "label", "context").agg(F.count("*").cast("double").alias("n"))
    spread = lambda label: F.coalesce(F.floor(F.pow(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(2.0)) / F.sum(F.when(F.col("label") == label, F.col("n") * F.col("n")))), F.lit(0)).cast("long")
    contexts = seen.groupBy("term").agg(spread(1).alias("u"), spread(0).alias("v"))
    plain = spark.createDataFrame([(r.term, r.a, r.b) for r in first], "term string, a long, b long")
    apart = plain.join(contexts, "term").select("term", F.least("a", "u").alias("a"), F.least("b", "v").alias("b"))
    picked = _telling(apart, t, c, least).orderBy(F.desc("ratio"), "term").collect()
    counts.unpersist()
    vocabulary = {r.term: i for i, r in enumerate(picked)}
    seen = texts.select("text").mapInArrow(_presence(vocabulary), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # a row per term
    found = {r.at: r.n for r in seen}
    idf = np.array([np.log(1 + found[-1] / max(found.get(i, 0), 1)) for i in range(len(picked))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(vocabulary)
        for x in batches:
            got = [vector(text.as_py() or "", lookup, idf) for text in x.column(2)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array([v[0] for v in got], pa.list_(pa.int64())), pa.array([v[1] for v in got], pa.list_(pa.float64()))], ["doc_id", "label", "at", "w"])

    got = rows.select("doc_id", "label", "text").mapInArrow(vectors, "doc_id long, label int, at array<long>, w array<double>").toPandas().sort_values(["doc_id", "label"])
    rows.unpersist()
    return BlockMaxIndex(vocabulary, idf, got["doc_id"].to_numpy(np.int64), got["label"].to_numpy(np.int64), [(np.array(x, np.int64), np.array(y, np.float64)) for x, y in zip(got["at"], got["w"], strict=True)], float(base))


SCORED = "doc_id long, score double, neighbours string, terms string"


def score_toxicity(docs: DataFrame, index: BlockMaxIndex) -> DataFrame:
    """For every row: score from 0 to 1, and its evidence: nearest examples (doc_id:label:similarity) and strongest terms."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = held.value
        lookup, names = _Lookup(x.vocabulary), list(x.vocabulary)
        for b in batches:
            score, near, strong = [], [], []
            for text in b.column(1):
                at, w = vector(text.as_py() or "", lookup, x.idf)
                rows, similarity = x.nearest(at, w) if len(at) else (at, w)
                score.append(x.vote(rows, similarity) if len(rows) else x.base)
                near.append(",".join(f"{x.ids[r]}:{int(x.labels[r])}:{s:.3f}" for r, s in zip(rows[:3], similarity[:3], strict=True)))
                strong.append(" ".join(names[at[i]] for i in np.argsort(-w, kind="stable")[:5]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(near, pa.string()), pa.array(strong, pa.string())], ["doc_id", "score", "neighbours", "terms"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)


def reliability(scored: DataFrame, labels: DataFrame, label_col: str = "toxic", bins: int = 10) -> DataFrame:
    """How far scores are calibrated: for each bin of scores its labelled rows, their mean score and the share of label 1."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).alias("_y"))
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.join(known, "doc_id").groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("_y").alias("share"))
