"""Token ids in patched frame-of-reference blocks.

A segment holds the ids of consecutive documents, each with its end id.  Layout, little-endian:

    magic "PFR1", block length u32, ids u64, documents u64, blocks u64, data bytes u64
    per document: doc_id i64, has_id u8, number of ids u64
    per block: start of its bytes u64, minimum u32, width u8, exceptions u16
    data: per block its packed offsets, places of exceptions (u8), their whole offsets (u32)

Offsets from a block's minimum are packed at the width that a percentile of them needs; wider ones are exceptions.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridbrook.llm.pretokens import BYTE_CHAR, load, public_path
from gridbrook.llm.shared import in_batches, save

BLOCK, PERCENT, SEGMENT_IDS, MOST_PARTS = 128, 90, 1 << 20, 500_000
HEAD = struct.Struct("<4sIQQQQ")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values to rows of bytes, value i from bit i * width."""
    words = np.zeros((BLOCK * width // 64, len(values)), np.uint64)
    for i, v in enumerate(np.ascontiguousarray(values.T.astype(np.uint64))):
        at, shift = divmod(i * width, 64)
        words[at] |= v << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= v >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).view(np.uint8).reshape(len(values), -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").T)
    out, mask = np.empty((BLOCK, packed.shape[0]), np.uint64), np.uint64(2**width - 1)
    for i in range(BLOCK):
        at, shift = divmod(i * width, 64)
        v = words[at] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (words[at + 1] << np.uint64(64 - shift))
        out[i] = v & mask
    return out.T.astype(np.uint32)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start .. start + length - 1 of each pair, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, percent: int = PERCENT) -> bytes:
    """Bytes of a segment; ``ids`` are those of all documents in order, unsigned 32-bit."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.zeros(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n:
        full[n:] = ids[-1]
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1) if blocks else np.empty(0, np.uint32)
    off = full - low[:, None]
    bits = np.frexp(off.astype(np.float64))[1].astype(np.uint8)
    width = np.partition(bits, BLOCK * percent // 100 - 1, axis=1)[:, BLOCK * percent // 100 - 1] if blocks else np.empty(0, np.uint8)
    wide = bits > width[:, None]
    counts = wide.sum(axis=1)
    packed = width.astype(np.int64) * (BLOCK // 8)
    sizes = packed + 5 * counts
    starts = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        kept = np.where(wide[rows], 0, off[rows])
        data[starts[rows][:, None] + np.arange(int(w) * BLOCK // 8)] = _pack(kept, int(w))
    row, place = np.nonzero(wide)
    at = starts + packed
    data[_ranges(at, counts)] = place.astype(np.uint8)
    data[_ranges(at + counts, 4 * counts)] = off[row, place].astype("<u4").view(np.uint8)
    has = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([
        HEAD.pack(b"PFR1", BLOCK, n, len(doc_ids), blocks, len(data)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), has.tobytes(), np.array(lengths, "<u8").tobytes(),
        starts.astype("<u8").tobytes(), low.astype("<u4").tobytes(), width.tobytes(), counts.astype("<u2").tobytes(), data.tobytes(),
    ])


class Segment:
    """Reader of a segment's bytes; ``ids(first, last)`` decodes only the blocks that it touches."""

    def __init__(self, raw: bytes):
        magic, block, self.n, docs, blocks, _ = HEAD.unpack_from(raw)
        if magic != b"PFR1" or block != BLOCK:
            raise ValueError("not a segment of token ids")
        at = HEAD.size

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        ids, has, self.lengths = take("<i8", docs), take("u1", docs), take("<u8", docs)
        self.doc_ids = [int(d) if h else None for d, h in zip(ids, has)]
        self.starts, self.low, self.width, self.counts = take("<u8", blocks).astype(np.int64), take("<u4", blocks), take("u1", blocks), take("<u2", blocks).astype(np.int64)
        self.data = np.frombuffer(raw, np.uint8, offset=at)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        last = self.n if last is None else last
        if first >= last:
            return np.empty(0, np.uint32)
        b0, b1 = first // BLOCK, -(-last // BLOCK)
        out = np.zeros((b1 - b0, BLOCK), np.uint32)
        width, starts, counts = self.width[b0:b1], self.starts[b0:b1], self.counts[b0:b1]
        for w in np.unique(width[width > 0]):
            rows = np.flatnonzero(width == w)
            out[rows] = _unpack(self.data[starts[rows][:, None] + np.arange(int(w) * BLOCK // 8)], int(w))
        at = starts + width.astype(np.int64) * (BLOCK // 8)
        place = self.data[_ranges(at, counts)]
        out[np.repeat(np.arange(b1 - b0), counts), place] = self.data[_ranges(at + counts, 4 * counts)].view("<u4")
        out += self.low[b0:b1, None]
        return out.ravel()[first - b0 * BLOCK : last - b0 * BLOCK]


#: Latin-1 characters to those that stand for their bytes.
_BYTE_OF = {b: c for b, c in enumerate(BYTE_CHAR) if chr(b) != c}


class Encoder:
    """Ids of whole texts as the library gives them; the library's model encodes the words that a bounded table doesn't hold.

    Texts with special tokens, and all texts where a file has other rules than byte-level pre-splitting, go to the library whole.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.file, self.most = load(path), most
        self.library, self.model = self.file.library, self.file.library.model
        self.words: dict[str, bytes] = {}
        self.raw = [i.to_bytes(4, "little") for i in range(max(self.file.vocab.values()) + 1)]

    def _word(self, word: str) -> bytes:
        bare = word[1:]
        plain = word[0] == " " and bare.isascii() and bare.isalnum()
        told = BYTE_CHAR[32] + bare if plain else word.encode("utf-8", "surrogateescape").decode("latin-1").translate(_BYTE_OF)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(told)])

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        words, ends, table = [], [0], self.words
        if len(table) >= self.most:
            table.clear()
        for text in texts:
            words += self.file.pieces(text)
            ends.append(len(words))
        found = list(map(table.get, words))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            word = words[i]
            ids = table.get(word)
            if ids is None:
                ids = self._word(word)
                if len(word) <= 200:
                    table[word] = ids
            found[i] = ids
        return [b"".join(found[a:b]) for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        whole = [k for k, t in enumerate(texts) if t and (not self.file.byte_level or any(s in t for s in self.file.special))]
        left = set(whole)
        plain = [k for k, t in enumerate(texts) if t and k not in left]
        for k, ids in zip(plain, self._plain([texts[k] for k in plain])):
            out[k] = ids
        for k, e in zip(whole, self.library.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False) if whole else ()):
            out[k] = np.array(e.ids, "<u4").tobytes()
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Encode whole texts and write segments in ascending id order; returns (part, seg, n_ids, payload) as reread.

    Range partitions of the id are sorted and cut into segments of about a million ids, one row of a table each,
    so that Spark's commit protocol covers lost tasks and executors.  Null ids come first; rows that repeat an id
    come in the order of their texts.
    """

    def run(batches):
        enc, end, part, seg = encoder(path), end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        ids, lengths, raw, held = [], [], [], 0

        def flush():
            values = np.frombuffer(b"".join(raw), "<u4")
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seg": pa.array([seg], pa.int32()), "n_ids": pa.array([len(values)], pa.int64()), "payload": pa.array([write_segment(ids, lengths, values)], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                some = batch.slice(at, 32)
                for doc_id, one in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist())):
                    one += end
                    ids.append(doc_id)
                    lengths.append(len(one) // 4)
                    raw.append(one)
                    held += len(one) // 4
                    if held >= SEGMENT_IDS:
                        yield flush()
                        ids, lengths, raw, held, seg = [], [], [], 0, seg + 1
        if ids:
            yield flush()

    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return save(in_batches(ordered, run, "part int, seg int, n_ids long, payload binary"), "tokens")


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, out of the segments."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = save(segments.select("part", "seg", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("seg_start")).join(parts, "part").select("part", "seg", (F.col("part_start") + F.col("seg_start")).alias("start")), "starts")
    few = starts.limit(MOST_PARTS + 1).count() <= MOST_PARTS
    placed = segments.join(F.broadcast(starts) if few else starts, ["part", "seg"]).select("start", "payload")

    def run(batches):
        for batch in batches:
            for start, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                segment = Segment(raw.as_py())
                values = segment.ids().astype("<u4")
                ends = np.cumsum(segment.lengths).astype(np.int64)
                begins = ends - segment.lengths.astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(segment.doc_ids, pa.int64()), "start": pa.array(begins + start), "n_tokens": pa.array(ends - begins),
                    "ids_crc32": pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(begins, ends)], pa.int64()),
                })

    return in_batches(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the ids of all documents and read them back: doc_id, start, n_tokens (with the end id), ids_crc32.

    Null and empty texts have the end id alone; repeated rows are written as often; no rows give no rows; other
    columns are ignored.
    """
    return read_tokens(write_tokens(docs, path or public_path("byte_bpe_50k.json"), end_id))
