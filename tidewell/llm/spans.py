"""Substring dedup by sliding sentence spans.

Sentences end at ``.``, ``!`` or ``?`` followed by white space, or at a line break.  One of more than ``LONG`` words is cut
into pieces where the text itself says so: before each word whose hash is the least of its neighbourhood (``REACH`` words to
either side), so cuts move with the words wherever they stand.  At every sentence starts a span: ``sentences`` consecutive
sentences, and more where those hold fewer than ``min_words`` words (0: never).  All spans are hashed and met globally;
sentences that lie in a span which is not the first of its kind (least doc_id, then least position) are removed.  Spans are
compared by their words in lower and upper case as they are; punctuation and white space between words don't count.

Sentence spans miss a passage whose sentences are cut at other words or are too few.  With ``run_words``, runs of that many
words are spans too, those whose hash is the least of ``window`` consecutive ones: their place depends on the words alone, so
two texts that share ``run_words + window - 1`` consecutive words share a span, whatever stands around them.  Of these the
words themselves are removed, with what follows the last of them up to the next word.

Only hashes and positions are shuffled, one of each kind per text: later ones in the same text are known to be
repeats.  First occurrences come from a grouped minimum with map-side combining and are written; the spans then
meet the repeated hashes in an equi-join, whose hot keys Spark can split.

Defined cases: null texts are empty; empty texts and those of too few sentences or words keep all;
null doc_ids are never compared and kept as they are; rows that repeat a doc_id are told apart by their
text, and of wholly equal rows each keeps or loses the same sentences; ties go to the least doc_id, then
the least position; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._shared import Scratch
from tidewell.llm._text import SEPARATOR, buffers, chunks, mix, span_hashes, word_spans

SENTENCES = 3
#: Together they find every repeated run of 49 words.
RUN_WORDS, WINDOW = 40, 10
#: A sentence of more than LONG words is cut before the words of least hash among REACH words to either side.
LONG, REACH = 30, 8
_STOP = np.array([chr(b) in ".!?" for b in range(256)])
_SPACE = np.array([chr(b) in " \t\r\n\v\f" for b in range(256)])
_BREAK = np.array([b == 10 for b in range(256)])
#: start and n count sentences; of spans of words n is negative, and both count words.
SPANS = "doc_id long, row_key long, start int, n int, h1 long, h2 long"


def sentence_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where sentences begin, over all texts; the first of each text (n + 1 values).

    A sentence includes the white space that follows it.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    # a white-space run closes a sentence if it follows a stop or holds a line break
    run = np.flatnonzero(np.diff(np.concatenate([[0], space.view(np.int8), [0]])))
    begin, end = run[::2], run[1::2]
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
    closing = (breaks[end] > breaks[begin]) | ((begin > 0) & _STOP[data[np.maximum(begin - 1, 0)]])
    starts = np.concatenate([offsets[:-1][np.diff(offsets) > 0], end[closing]])
    starts = np.unique(starts[starts < n])
    ws, we, _ = word_spans(data, offsets)
    w0 = np.searchsorted(ws, starts)
    words = np.diff(np.append(w0, len(ws)))
    long = np.flatnonzero(words > LONG)
    if len(long):
        begin, n = w0[long], words[long]
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        low, high = np.repeat(begin, n), np.repeat(begin + n, n)
        h = span_hashes(data, ws, we)
        cut = at > low
        for j in range(1, REACH + 1):
            cut &= (at - j < low) | (h[at] < h[np.maximum(at - j, 0)])
            cut &= (at + j >= high) | (h[at] <= h[np.minimum(at + j, len(h) - 1)])
        starts = np.unique(np.concatenate([starts, ws[at[cut]]]))
    return starts, np.searchsorted(starts, offsets)


def selected_runs(least: np.ndarray, valid: np.ndarray, opens: np.ndarray, window: int) -> np.ndarray:
    """Positions whose hash is the least of a window (all equal ones); where a text has fewer, its one window is shorter.

    valid: whether a run starts there; runs of one text are followed by ``window - 1`` invalid positions at least.
    """
    n, top = len(least), np.iinfo(np.uint64).max
    if not valid.any():
        return np.zeros(0, np.int64)
    low = np.concatenate([np.where(valid, least, top), np.full(window, top, np.uint64)])
    high, size = low, 1
    while size < window:  # minima of twice as many, or of window
        step = min(size, window - size)
        high, size = np.minimum(high[: len(high) - step], high[step:]), size + step
    whole = valid & (np.append(valid, np.zeros(window, bool))[window - 1 : window - 1 + n] | opens)
    cover, size = np.concatenate([np.zeros(window - 1, np.uint64), np.where(whole, high[:n], 0)]), 1
    while size < window:
        step = min(size, window - size)
        cover, size = np.maximum(cover[: len(cover) - step], cover[step:]), size + step
    return np.flatnonzero(valid & (low[:n] == cover))


def sentence_spans(column: pa.Array, sentences: int, min_words: int, run_words: int = 0, window: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk: row of its first text, then text, first sentence, sentences and two hashes of every span.

    With ``run_words``, spans of words follow: their first word, and less than nothing by the number of words.
    """
    if run_words and not 0 < window <= run_words:
        raise ValueError("window is from 1 to run_words")
    for row, part in chunks(column):
        data, offsets = buffers(part)
        starts, first = sentence_starts(data, offsets)
        ws, we, wfirst = word_spans(data, offsets)
        hashes = span_hashes(data, ws, we)
        doc = np.repeat(np.arange(len(part)), np.diff(first))
        w0 = np.searchsorted(ws, starts)
        w1 = np.append(w0[1:], len(ws))
        # the sentence that brings min_words words, but at least the given count
        need = np.searchsorted(w1, w0 + min_words, "left")
        last = np.maximum(need, np.arange(len(starts)) + sentences - 1)
        ok = last < first[doc + 1]
        i, j = np.flatnonzero(ok), last[ok]
        c = mix(hashes)
        weights = np.multiply.accumulate(np.full(len(c) + 1, np.uint64(0xD6E8FEB86659FD93 | 3)))
        inverse = np.multiply.accumulate(np.full(len(c) + 1, np.uint64(pow(0xD6E8FEB86659FD93 | 3, -1, 1 << 64))))
        out, of, start, count = [], doc[i], i - first[doc[i]], j - i + 1
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(c ^ np.uint64(salt)) * weights[: len(c)])]) for salt in (0x0123456789ABCDEF, 0x6A09E667F3BCC909)]
        a, b = w0[i], w1[j]
        if run_words:
            own = np.repeat(np.arange(len(part)), np.diff(wfirst))
            at = np.arange(len(ws))
            valid, end = at + run_words <= wfirst[own + 1], np.minimum(at + run_words, len(ws))
            at = selected_runs(mix((sums[0][end] - sums[0][at]) * inverse[at]), valid, at == wfirst[own], window)
            of, start, count = np.concatenate([of, own[at]]), np.concatenate([start, at - wfirst[own[at]]]), np.concatenate([count, np.full(len(at), -run_words)])
            a, b = np.concatenate([a, at]), np.concatenate([b, at + run_words])
        kind = np.where(count < 0, np.uint64(0xBB67AE8584CAA73B), np.uint64(0))
        for x in sums:
            out.append(mix((x[b] - x[a]) * inverse[a] + (b - a).astype(np.uint64) ^ kind).view(np.int64))
        yield row, of, start, count, *out


def _again(doc: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether a span equals an earlier one of its own text."""
    order = np.lexsort((h2, h1, doc))  # stable: positions stay in order
    same = np.zeros(len(doc), bool)
    a, b = order[1:], order[:-1]
    same[a] = (doc[a] == doc[b]) & (h1[a] == h1[b]) & (h2[a] == h2[b])
    return same


def _emit(*rules: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc, start, n, h1, h2 in sentence_spans(b.column(2), *rules):
                own = ~_again(doc, h1, h2)
                doc, start, n, h1, h2 = doc[own], start[own], n[own], h1[own], h2[own]
                at = pa.array(row + doc)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(h1), pa.array(h2)], ["doc_id", "row_key", "start", "n", "h1", "h2"])

    return run


CLEAN = "doc_id long, n_sentences long, n_removed long, removed string, text string"


def _remove(*rules: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, runs, counts, gone, spans, kept = b.column(0), b.column(2), [], [], [], []
            for (row, part), (_, sdoc, sstart, sn, h1, h2) in zip(chunks(b.column(1)), sentence_spans(b.column(1), *rules), strict=True):
                data, offsets = buffers(part)
                starts, first = sentence_starts(data, offsets)
                ws, _, wfirst = word_spans(data, offsets)
                again = _again(sdoc, h1, h2)
                if ids.null_count:
                    again &= ~ids.slice(row, len(part)).is_null().to_numpy(zero_copy_only=False)[sdoc]
                met = runs.slice(row, len(part))
                flat = pc.list_flatten(met)
                doc = np.concatenate([sdoc[again], pc.list_parent_indices(met).to_numpy()])
                at = np.concatenate([sstart[again], flat.field(0).to_numpy()]).astype(np.int64)
                n = np.concatenate([sn[again], flat.field(1).to_numpy()]).astype(np.int64)
                # byte ranges; the last sentence and the last word of a text end with it
                mark = np.zeros(len(data) + 1, np.int32)
                for own, begin, of in ((n > 0, starts, first), (n < 0, ws, wfirst)):
                    x = of[doc[own]] + at[own]
                    y = x + np.abs(n[own])
                    np.add.at(mark, begin[x], 1)
                    np.add.at(mark, np.where(y < of[doc[own] + 1], np.append(begin, 0)[y], offsets[doc[own] + 1]), -1)
                drops = np.cumsum(mark)[:-1] > 0
                lost = np.concatenate([[0], np.cumsum(drops)])
                cut = np.append(starts, len(data))
                hit = np.concatenate([[0], np.cumsum(lost[cut[1:]] > lost[cut[:-1]])])
                counts += np.diff(first).tolist()
                gone += (hit[first[1:]] - hit[first[:-1]]).tolist()
                for d in range(len(part)):
                    x, y = offsets[d], offsets[d + 1]
                    if lost[x] == lost[y]:
                        kept.append(part[d].as_py())
                        spans.append("")
                        continue
                    raw, drop = data[x:y], drops[x:y]
                    kept.append(raw[~drop].tobytes().decode())
                    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    edges = points[np.flatnonzero(np.diff(np.concatenate([[0], drop.view(np.int8), [0]])))].tolist()
                    spans.append(",".join(f"{p}:{q}" for p, q in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_sentences", "n_removed", "removed", "text"])

    return run


def dedup_spans(docs: DataFrame, sentences: int = SENTENCES, min_words: int = 0, run_words: int = 0, window: int = 0) -> DataFrame:
    """One row per input row: sentences, of how many something was removed, code-point spans of that, and what is left."""
    rules = sentences, min_words, run_words, window
    scratch = Scratch(docs.sparkSession, "spans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row_key"), F.col("text").cast("string").alias("text"))
    spans = rows.where("doc_id is not null").mapInArrow(_emit(*rules), SPANS)
    at = F.struct("doc_id", "start", "row_key")
    first = scratch.table("first", spans.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last").select("h1", "h2", "first"))
    met = spans.join(first, ["h1", "h2"]).where(at > F.col("first"))
    runs = scratch.table("runs", met.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "n")).alias("runs")))
    return rows.join(runs, ["doc_id", "row_key"], "left").select("doc_id", "text", "runs").mapInArrow(_remove(*rules), CLEAN)
