"""Secret scan: Aho-Corasick prefilter, anchored patterns near the hits, checksum validation.

An automaton of keywords finds where a secret can start; only there is a pattern matched, anchored at
the hit.  Kinds whose tokens embed a checksum are reported only if it holds.

Defined cases: a null text is empty; an empty text has no span; a null doc_id stays null; repeated rows
are scanned one by one; extra columns are ignored, those of the result have fixed names; an empty table
gives an empty result.  Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm._shared import bound_batches

#: The base kinds, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: Kinds with an embedded checksum: prefix letters, 30 of base 62, then the CRC-32 of those 30 as 6 of base 62.
CHECKED = {"github": re.compile(r"(gh[pousr]_)([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), "npm": re.compile(r"(npm_)([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")}
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
KINDS = ("assign", "access", "hex", "github", "npm")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_FOLD = {i: i + 32 for i in range(65, 91)}


def checksum62(body: str) -> str:
    """CRC-32 of the body as six digits of base 62."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return out


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def scan(text: str, a) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, kind's number, end), in that order."""
    low = text.lower()
    if len(low) != len(text):  # some letters have two code points in lower case
        low = text.translate(_FOLD)
    hits: dict[str, list[int]] = {}
    for end, (n, kind) in a.iter(low):
        hits.setdefault(kind, []).append(end - n + 1)
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for kind, starts in hits.items():
        number, past = KINDS.index(kind), 0
        for at in sorted(starts):
            if at < past:
                continue
            if kind == "assign":
                if m := ASSIGN.match(text, at):
                    past = m.end()
                    if m.end(2) - m.start(2) >= MIN_ASSIGN:
                        found.append((at, number, past))
            elif kind == "access":
                if m := ACCESS.match(text, at):
                    past = m.end()
                    if past - at >= MIN_ACCESS:
                        found.append((at, number, past))
            elif (m := CHECKED[kind].match(text, at)) and checksum62(m[2]) == m[3]:
                past = m.end()
                found.append((at, number, past))
    found.sort()
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = automaton()
    for b in batches:
        rows = []
        for text in b.column(1):
            spans = scan(text.as_py() or "", a)
            base = [x for x in spans if x[1] < 3]
            n = [sum(x[1] == k for x in base) for k in range(3)]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of the base kinds, digest of the base spans, all spans."""
    bound_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(_batches, SCHEMA)
