"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from one pass of numpy kernels over the UTF-8 buffer of whole texts.  Trees grow level by
level on quantile bins and are flattened into arrays, through which all rows of a batch go down at once.

The model is fitted on at most ``SAMPLE`` labelled rows, those of least hash of doc_id; everything else
covers all rows.  Labels, lang, source and doc_id are inputs of no score.

Defined cases: null texts are empty; an empty text has the statistics 0 and is scored; a doc_id with
several labels takes the lowest, one with several texts is learnt from that of least hash; labels without a document, or null, aren't learnt; with no labels of both
kinds the score is the share of label 1 (0.5 without any); null doc_ids and repeated rows are scored and
kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm._shared import bound_batches, trim
from tidewell.llm._text import SEPARATOR, buffers, chunks, shingles, span_hashes, word_spans

#: Most labelled rows that a model is fitted on.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS, SMOOTH = 80, 4, 64, 0.15, 10, 1.0
_is = lambda f: np.array([f(chr(b)) if b < 128 else False for b in range(256)])
_CLASSES = {
    "upper": _is(str.isupper), "lower": _is(str.islower), "digit": _is(str.isdigit), "space": _is(str.isspace), "line": _is(lambda c: c == "\n"),
    "stop": _is(lambda c: c in ".?"), "comma": _is(lambda c: c in ",;:"), "bang": _is(lambda c: c == "!"), "bar": _is(lambda c: c == "|"),
    "symbol": _is(lambda c: 32 < ord(c) < 127 and not c.isalnum() and c not in ".,;:!?'\"()-|"), "wide": np.arange(256) >= 128,
}
_LINE = np.array([b == 10 for b in range(256)])
FEATURES = (*_CLASSES, "log_bytes", "log_words", "word_bytes", "word_spread", "short", "distinct", "top", "adjacent", "repeated_shingles", "repeated_lines", "capitals")


def _by_text(at: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Sums over each text from cumulative sums that start at 0."""
    return np.diff(sums[at]).astype(np.float64)


def _repeats(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: distinct values and the count of its most frequent value."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    top = np.zeros(n)
    np.maximum.at(top, doc[at], np.diff(np.append(at, len(h))))
    return np.bincount(doc[at], minlength=n).astype(np.float64), top


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for every text of a column."""
    out = []
    for _, part in chunks(column):
        data, offsets = buffers(part)
        size = np.diff(offsets).astype(np.float64)
        per_byte = np.maximum(size, 1)
        cols = [_by_text(offsets, np.concatenate([[0], np.cumsum(own[data], dtype=np.int64)])) / per_byte for own in _CLASSES.values()]
        low, low_at = buffers(pc.utf8_lower(part))
        ws, we, first = word_spans(low, low_at)
        h = span_hashes(low, ws, we)
        words = np.diff(first).astype(np.float64)
        per_word = np.maximum(words, 1)
        length = (we - ws).astype(np.float64)
        mean = _by_text(first, np.concatenate([[0], np.cumsum(length)])) / per_word
        square = _by_text(first, np.concatenate([[0], np.cumsum(length**2)])) / per_word
        short = _by_text(first, np.concatenate([[0], np.cumsum(length <= 3)])) / per_word
        distinct, top = _repeats(h, first)
        inner = np.ones(len(h), bool)
        inner[first[:-1][first[:-1] < len(h)]] = False
        again = np.concatenate([[False], h[1:] == h[:-1]]) & inner if len(h) else np.zeros(0, bool)
        adjacent = _by_text(first, np.concatenate([[0], np.cumsum(again)])) / per_word
        sh, sfirst = shingles(h, first)
        sn = np.maximum(np.diff(sfirst), 1)
        srep = np.where(words > 0, 1 - _repeats(sh, sfirst)[0] / sn, 0)
        ls, le, lfirst = word_spans(data, offsets, _LINE)
        ln = np.diff(lfirst)
        lrep = np.where(ln > 0, 1 - _repeats(span_hashes(data, ls, le), lfirst)[0] / np.maximum(ln, 1), 0)
        rs, _, rfirst = word_spans(data, offsets, SEPARATOR)
        capitals = _by_text(rfirst, np.concatenate([[0], np.cumsum(_CLASSES["upper"][data[rs]])])) / np.maximum(np.diff(rfirst), 1)
        cols += [np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(square - mean**2, 0)), short, distinct / per_word, top / per_word, adjacent, srep, lrep, capitals]
        out.append(np.stack(cols, 1))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


class Trees:
    """Boosted trees for a 0/1 label, as complete binary trees in flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 0.001), 0.999)
        self.base = float(np.log(share / (1 - share)))
        inner = 2**DEPTH - 1
        self.feature, self.cut, self.value = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 2**DEPTH))
        if len(set(y.tolist())) < 2:
            return
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        margin, n, m = np.full(len(y), self.base), len(y), x.shape[1]
        features, cuts, values = [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, w = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(DEPTH):
                base, nodes = 2**level - 1, 2**level
                key = ((node - base)[:, None] * m + np.arange(m)) * BINS + binned
                size = nodes * m * BINS
                shape = (nodes, m, BINS)
                sums = [np.bincount(key.ravel(), np.repeat(v, m), size).reshape(shape).cumsum(2) for v in (g, w, np.ones(n))]
                gl, wl, nl = sums
                gt, wt, nt = (s[:, :1, -1:] for s in sums)
                gain = gl**2 / (wl + SMOOTH) + (gt - gl) ** 2 / (wt - wl + SMOOTH) - gt**2 / (wt + SMOOTH)
                gain[(nl < LEAST_ROWS) | (nt - nl < LEAST_ROWS)] = 0
                for f, e in enumerate(edges):
                    gain[:, f, len(e) :] = 0
                best = gain.reshape(nodes, -1).argmax(1)
                f, b = best // BINS, best % BINS
                real = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
                feature[base : base + nodes] = f
                cut[base : base + nodes] = [edges[f[i]][b[i]] if real[i] else np.inf for i in range(nodes)]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            leaf = node - inner
            value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, w, inner + 1) + SMOOTH)
            margin += value[leaf]
            features.append(feature), cuts.append(cut), values.append(value)
        self.feature, self.cut, self.value = np.stack(features), np.stack(cuts), np.stack(values)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin, row = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            margin += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-margin))


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of doc_id as text, modulo ``of``."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(of))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = statistics(b.column(3))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], flat], ["doc_id", "label", "tag", "x"])
    trim()


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fold: int = 4, held: int = 2, sample: int = SAMPLE) -> Trees:
    """A model from labelled rows outside the held-out fold, ``sample`` of them at most."""
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), fold) != held))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # at most `sample` rows of 12 bytes
    rows = rows.select("doc_id", "label", F.xxhash64("text").alias("tag"), "text").mapInArrow(_features, "doc_id long, label int, tag long, x array<double>")
    got = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min_by("x", "tag").alias("x")).toPandas().sort_values("doc_id")
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    return Trees(x, got["label"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: Trees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and a score from 0 to 1 for every row; ``keep`` may hold the text."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = held.value.score(statistics(b.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(score)], names)
        trim()

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes[: len(keep)]), "score double"])
    return rows.mapInArrow(run, schema)
