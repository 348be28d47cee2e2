"""Token files: canonical length-limited Huffman coding of token ids, read back by table.

A text is cut before every space that a non-space follows; byte-level BPE never merges across such a cut,
so each piece is encoded once by the tokenizers library (Latin words by its model alone) and then looked
up.  Texts are put into order and their ids kept in a table of the shared folder, from which ids are counted
globally (a partial count per partition, summed by id); the counts give code lengths of at most ``LIMIT``
bits (one more than the ids need, if that is more) by package-merge, and lengths alone give the canonical codes, in which the blocks are then written.

File format (a Parquet folder, so that Spark's committed writes and any file system serve)::

    codebook  id, length                 canonical codes: by length, then id; most significant bit first
    blocks    bucket, block, doc_ids, lengths (ids per document, end id included), n_tokens,
              checkpoints (bits from each STRIDE-th id to the next, 16 bits each), payload (bytes)
    buckets   bucket, start, n_tokens    ids of all documents in lower buckets

Buckets are ranges of doc_id, and of hashes of texts within one; in a bucket, blocks follow ascending doc_id and hold whole documents.  Every
block is decoded by itself, all its checkpoints in lockstep through one table of as many entries as the longest code has values.

Defined cases: a null text is empty; an empty text is the end id alone; null doc_ids come before all
others; repeated doc_ids follow one another in the order of their text's hash; an empty table makes empty files; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import operator
import re
import zlib
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm._shared import Scratch, partitions, release, trim

END, LIMIT, STRIDE, TOTALS, SLICE = 0, 20, 128, -1, 1 << 15
#: Ids gathered before a block is closed; pieces that a worker keeps with their ids (twice as many at most).
BLOCK_TOKENS, CACHE = 1 << 19, 300_000
#: Text of one bucket, about.
BUCKET_BYTES = 64 << 20
_U = np.uint64
_LINES = re.compile(r"(\S+)\n(\S+)")


#: The pre-tokenizer makes one token of a run of letters, and one of the ASCII punctuation that ends a piece.
_STOPPED = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256 on."""
    own = {b for lo, hi in (("!", "~"), ("\u00a1", "\u00ac"), ("\u00ae", "\u00ff")) for b in range(ord(lo), ord(hi) + 1)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


_ID = operator.attrgetter("id")


class _Apart(Exception):
    """A space that no non-space follows: the text must be cut with care."""


class _Words(dict):
    """Bytes of the little-endian 32-bit ids of one pre-token (in byte letters), by the library's model."""

    def __init__(self, tokenizer):
        self.tokenize = tokenizer.model.tokenize
        self.bytes = [i.to_bytes(4, "little") for i in range(max(tokenizer.get_vocab().values(), default=0) + 1)].__getitem__

    def ids(self, word: str) -> bytes:
        return b"".join(map(self.bytes, map(_ID, self.tokenize(word))))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[word] = self.ids(word)
        return ids


class _Pieces(dict):
    """Bytes of the ids of a piece with its prefix, encoded when first met.

    Of a word with stops and of two parts around a line break the parts are kept, and the whole only once its parts were known.
    """

    def __init__(self, tokenizer, prefix: str, words: _Words, letters: str, head: _Pieces | None = None):
        self.encode, self.prefix, self.words, self.head = tokenizer.encode, prefix, words, self if head is None else head
        self.old: dict[str, bytes] = {}
        self.letters, self.start, self.line = letters, charmap_decode(prefix.encode(), "strict", letters)[0], letters[10]

    def word(self, word: str) -> bytes:
        """Ids of a Latin word."""
        return self.words.ids(self.start + (word if word.isascii() else charmap_decode(word.encode(), "strict", self.letters)[0]))

    def keep(self, piece: str, ids: bytes) -> bytes:
        if len(self) >= CACHE:  # what is used again comes back from the generation before
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def __missing__(self, piece: str) -> bytes:
        if ids := self.old.get(piece):
            return self.keep(piece, ids)
        if piece.isascii() and piece.isalpha():
            return self.keep(piece, self.words.ids(self.start + piece))
        if m := _STOPPED.fullmatch(piece):
            word, stops = m.groups()
            if not stops:
                return self.keep(piece, self.word(word))
            ids = self.get(word)
            if ids or (ids := self.old.get(word)):
                return self.keep(piece, ids + self.words[stops])
            return self.keep(word, self.word(word)) + self.words[stops]
        if self.start and (not piece or piece[0].isspace()):
            raise _Apart
        if m := _LINES.fullmatch(piece):  # a line break between two non-spaces is a token of its own
            first, second = m.groups()
            known = first in self and second in self.head
            ids = self[first] + self.words[self.line] + self.head[second]
            return self.keep(piece, ids) if known else ids
        return self.keep(piece, np.array(self.encode(self.prefix + piece, add_special_tokens=False).ids, "<u4").tobytes())


class Encoder:
    """Whole texts to ids, exactly as the tokenizer's ``encode`` gives them (byte-level BPE without a normalizer)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        words, letters = _Words(self.tokenizer), "".join(byte_letters())
        self.head = _Pieces(self.tokenizer, "", words, letters)
        self.tail = _Pieces(self.tokenizer, " ", words, letters, self.head)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    @staticmethod
    @functools.lru_cache(2)
    def of(path: str) -> Encoder:
        """The encoder of this worker process, with the pieces that earlier tasks have met."""
        return Encoder(path)

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        rest = text.split(" ")
        first = rest.pop(0)
        try:
            ids = b"".join(map(self.tail.__getitem__, rest))
        except _Apart:
            merged = [first]
            for x in rest:
                if not x or x[0].isspace():  # the space belongs to the piece before it
                    merged[-1] += " " + x
                else:
                    merged.append(x)
            first, *rest = merged
            ids = b"".join(map(self.tail.__getitem__, rest))
        return self.head[first] + ids if first else ids


#: Blocks of ids, and for every task a row of its totals by id (bucket TOTALS).
IDS = "bucket int, block int, doc_ids array<long>, lengths array<long>, planes array<binary>"


def to_planes(ids: np.ndarray) -> list[bytes]:
    """The bytes of 32-bit ids by significance, without leading planes of zeros: they compress better apart."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    used = 1 + max([i for i in range(4) if raw[:, i].any()], default=0)
    return [raw[:, i].tobytes() for i in range(used)]


def from_planes(planes: list[bytes]) -> np.ndarray:
    out = np.zeros(len(planes[0]), np.int64)
    for i, p in enumerate(planes):
        out |= np.frombuffer(p, np.uint8).astype(np.int64) << (8 * i)
    return out


def _tokenise(path: str):
    """Rows (bucket, doc_id, text) in order to blocks of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder.of(path), np.array([END], "<u4").tobytes()
        bucket, block, docs, lengths, parts, held = None, 0, [], [], [], 0
        total = np.zeros(END + 1, np.int64)

        def row(bucket: int, block: int, docs: list, lengths: list, planes: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([planes], pa.list_(pa.binary()))], ["bucket", "block", "doc_ids", "lengths", "planes"])

        def close() -> pa.RecordBatch:
            nonlocal total
            ids = np.frombuffer(b"".join(parts), "<u4")
            own = np.bincount(ids, minlength=len(total))
            own[: len(total)] += total
            total = own
            return row(bucket, block, docs, lengths, to_planes(ids))

        for b in batches:
            for own, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if docs and (own != bucket or held >= BLOCK_TOKENS):
                    yield close()
                    block = block + 1 if own == bucket else 0
                    docs, lengths, parts, held = [], [], [], 0
                bucket = own
                ids = encode(text.as_py() or "") + end
                docs.append(doc)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                held += len(ids) // 4
        if docs:
            yield close()
            yield row(TOTALS, 0, [], [], [total.astype("<i8").tobytes()])
        trim()

    return run


COUNTS = "id int, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of totals to (id, n)."""
    for b in batches:
        for planes in b.column(0):
            total = np.frombuffer(planes[0].as_py(), "<i8")
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["id", "n"])


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); counts are positive."""
    n = len(counts)
    limit = limit or max(LIMIT, n.bit_length() + 1)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit into {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    levels, packed = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaf, packed])
        is_leaf = np.arange(len(both)) < n
        rank = np.argsort(both, kind="stable")
        levels.append(is_leaf[rank])
        both = both[rank]
        packed = both[0 : len(both) // 2 * 2 : 2] + both[1::2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for own in reversed(levels):
        leaves = int(own[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes of ids and the table that decodes them."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.limit = limit = int(self.lengths.max(initial=1))
        step = np.left_shift(1, limit - self.lengths)
        begin = np.concatenate([[0], np.cumsum(step)])
        size = int(self.ids.max(initial=0)) + 1
        self.code, self.bits = np.zeros(size, _U), np.zeros(size, np.int64)
        self.code[self.ids] = (begin[:-1] >> (limit - self.lengths)).astype(_U)
        self.bits[self.ids] = self.lengths
        self.table = np.zeros(1 << limit, np.int32)
        self.table[: begin[-1]] = np.repeat(self.ids, step)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The payload, and the distances in bits between every STRIDE-th id (16 bits each, the first 0)."""
        bits = self.bits[ids]
        end = np.cumsum(bits)
        begin = end - bits
        total = int(end[-1]) if len(ids) else 0
        words = np.zeros((total >> 6) + 2, _U)
        for i in range(0, len(ids), SLICE):  # slices stay in a processor's cache
            own = slice(i, i + SLICE)
            # each code lies in two 64-bit words at most; bits of different codes are disjoint, so sums are unions
            at, code, over = begin[own] >> 6, self.code[ids[own]], (begin[own] & 63) + bits[own] - 64
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            cut = np.flatnonzero(over > 0)
            left = code << np.maximum(-over, 0).astype(_U)
            left[cut] = code[cut] >> over[cut].astype(_U)
            words[at[new]] += np.add.reduceat(left, new)
            words[at[cut] + 1] += code[cut] << (64 - over[cut]).astype(_U)
        marks = begin[::STRIDE]
        return words.astype(">u8").tobytes()[: (total + 7) // 8], np.diff(marks, prepend=0).astype("<u2").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """All n ids of a block, its checkpoints in lockstep."""
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        pad = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # 32 bits from every byte
        mask = np.uint32((1 << self.limit) - 1)
        at = np.cumsum(np.frombuffer(checkpoints, "<u2"), dtype=np.int64)
        out = np.zeros((STRIDE, len(at)), np.int32)
        last = n - (len(at) - 1) * STRIDE
        for i in range(STRIDE):
            if i == last:
                at = at[:-1]
            window = (pad[at >> 3] >> (32 - self.limit - (at & 7)).astype(np.uint32)) & mask
            ids = self.table[window]
            out[i, : len(at)] = ids
            at = at + self.bits[ids]
        return out.T.reshape(-1)[:n]


BLOCKS = "bucket int, block int, doc_ids array<long>, lengths array<long>, n_tokens long, checkpoints binary, payload binary"


def _encode(book):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = book.value
        for b in batches:
            for i in range(b.num_rows):
                ids = from_planes(b.column(4)[i].as_py())
                payload, checkpoints = codes.encode(ids)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in b.columns[:4]), pa.array([len(ids)], pa.int64()), pa.array([checkpoints], pa.binary()), pa.array([payload], pa.binary())], ["bucket", "block", "doc_ids", "lengths", "n_tokens", "checkpoints", "payload"])
        trim()

    return run


DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long, bucket int"


def _decode(book):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = book.value
        for b in batches:
            for bucket, start, docs, lengths, n, checkpoints, payload in zip(*(b.column(i) for i in range(7)), strict=True):
                ids = codes.decode(payload.as_py(), checkpoints.as_py(), n.as_py()).astype("<u4")
                lengths = np.array(lengths.values.to_numpy())
                cut = np.concatenate([[0], np.cumsum(lengths)])
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(start.as_py() + cut[:-1]), pa.array(lengths), pa.array(crc, pa.int64()), pa.array([bucket.as_py()] * len(crc), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "bucket"])
        trim()

    return run


def count_ids(docs: DataFrame, tokenizer_path: str, name: str) -> DataFrame:
    """All columns, and under ``name`` (instead of a column so called) the ids of the text with its end id."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(tokenizer_path)
        for b in batches:
            n = pa.array([len(encode(x.as_py() or "")) // 4 + 1 for x in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*b.schema.names[:-1], name])
        trim()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(name, T.LongType())]))


def write_tokens(docs: DataFrame, tokenizer_path: str, out: Scratch, parts: int | None = None) -> None:
    """Writes codebook, blocks and buckets of all documents, in ascending doc_id order.

    A bucket is a range of (doc_id, hash of the text), so a doc_id that very many rows share is split too; the number
    of buckets follows the bytes of text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tag"), F.col("text").cast("string").alias("text"))
    if not parts:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(partitions(spark), -(-size // BUCKET_BYTES))
    order = ["doc_id", "tag", "text"]
    rows = rows.repartitionByRange(parts, "doc_id", "tag").sortWithinPartitions(*order).select(F.spark_partition_id().alias("bucket"), "doc_id", "text")
    ids = out.table("ids", rows.mapInArrow(_tokenise(tokenizer_path), IDS))
    release(spark)  # the shuffled texts
    counts = ids.where(F.col("bucket") == TOTALS).select("planes").mapInArrow(_count, COUNTS).groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row per id of the vocabulary at most
    lengths = code_lengths(counts["n"].to_numpy(np.int64))
    out.table("codebook", spark.createDataFrame([(int(i), int(n)) for i, n in zip(counts["id"], lengths, strict=True)], "id int, length int"))
    book = spark.sparkContext.broadcast(Codebook(counts["id"].to_numpy(np.int64), lengths))
    blocks = out.table("blocks", ids.where(F.col("bucket") != TOTALS).mapInArrow(_encode(book), BLOCKS), codec="uncompressed")
    out.drop("ids")
    totals = blocks.groupBy("bucket").agg(F.sum("n_tokens").alias("n_tokens")).orderBy("bucket").collect()  # a row per bucket
    start, index = 0, []
    for r in totals:
        index.append((r.bucket, start, r.n_tokens))
        start += r.n_tokens
    out.table("buckets", spark.createDataFrame(index, "bucket int, start long, n_tokens long"))


def read_tokens(spark: SparkSession, root: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    rows = spark.read.schema("id int, length int").parquet(f"{root}/codebook").toPandas()
    book = spark.sparkContext.broadcast(Codebook(rows["id"].to_numpy(np.int64), rows["length"].to_numpy(np.int64)))
    blocks = spark.read.schema(BLOCKS).parquet(f"{root}/blocks")
    buckets = spark.read.schema("bucket int, start long, n_tokens long").parquet(f"{root}/buckets").select("bucket", F.col("start").alias("base"))
    earlier = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    before = blocks.select("bucket", "block", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("within"))
    placed = before.join(buckets, "bucket").select("bucket", "block", (F.col("base") + F.col("within")).alias("start"))
    rows = blocks.join(F.broadcast(placed) if placed_is_small(blocks) else placed, ["bucket", "block"])
    return rows.select("bucket", "start", "doc_ids", "lengths", "n_tokens", "checkpoints", "payload").mapInArrow(_decode(book), DECODED).drop("bucket")


def placed_is_small(blocks: DataFrame, most: int = 200_000) -> bool:
    """Whether the list of blocks (24 bytes each) may be sent to all executors."""
    return blocks.count() <= most
