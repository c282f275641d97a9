"""Benchmark decontamination by spaced-seed hashing.

A stretch of 13 words (or the whole item, if shorter) is contaminated where at least 80 % of the aligned words are
equal.  If up to t words may differ, the stretch is cut into t + 2 blocks: any t changes leave two of them whole.
Each mask keeps two blocks and ignores the rest, so every stretch that is to be found gives an equal hash under some
mask.  Hits name a diagonal (place in the document minus place in the item), along which the words are compared.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridbrook.llm.near_dup import _Hashes, words
from gridbrook.llm.shared import in_batches, save

STRETCH, PERCENT, SHORTEST = 13, 80, 5
#: Words of a benchmark that is broadcast; larger ones are joined, behind a bitmap of so many bits (a power of 2).
BLOCK_WORDS, BITS = 200_000, 28
#: Words of documents that are hashed at once.
AT_ONCE = 65536
#: Hits that are held at once before they are made distinct.
HITS = 1_000_000
_C = np.random.default_rng(7).integers(1, 2**63, STRETCH, dtype=np.uint64) | np.uint64(1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
FOUND = "doc_id long, item_id long, matched long, aligned long, doc_start long"


def blocks_of(n: int) -> list[range]:
    """Blocks of a stretch of n words: two more than the words that may differ, or one if none may."""
    changes = n * (100 - PERCENT) // 100
    count = min(n, changes + 2) if changes else 1
    cuts = [n * k // count for k in range(count + 1)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:])]


def masks_of(n: int) -> list[tuple[int, ...]]:
    """Blocks that each mask of a stretch of n words keeps."""
    k = len(blocks_of(n))
    return list(combinations(range(k), 2)) if k > 1 else [(0,)]


def _hashes(text: str | None, known: _Hashes) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(known.__getitem__, w), np.uint64, len(w))


def _seeds(h: np.ndarray, n: int) -> list[np.ndarray]:
    """Seeds of every stretch of n words under each of its masks."""
    size = max(len(h) - n + 1, 0)
    sums = []
    for block in blocks_of(n):
        one = np.zeros(size, np.uint64)
        for p in block:
            one += h[p : p + size] * _C[p]
        sums.append(one)
    out = [sum((sums[k] for k in kept[1:]), sums[kept[0]]) for kept in masks_of(n)]
    return [(x ^ (x >> np.uint64(29))) * _SPREAD for x in out]


def _aligned(own: np.ndarray, target: np.ndarray, d: int) -> tuple[int, int, int] | None:
    """(equal words, aligned words, minus the start in the document) of an item at the diagonal d, if some stretch has enough equal words."""
    a, b = max(0, -d), min(len(target), len(own) - d)
    need = min(STRETCH, len(target))
    if b - a < need:
        return None
    total = np.concatenate([[0], np.cumsum(target[a:b] == own[a + d : b + d])])
    if 100 * (total[need:] - total[:-need]).max() < PERCENT * need:
        return None
    return int(total[-1]), b - a, -(a + d)


class Index:
    """Seeds of benchmark items, sorted for each mask."""

    def __init__(self, items: list[tuple[int, str | None]]):
        known = _Hashes()
        self.items = [(i, h) for i, t in items if len(h := _hashes(t, known)) >= SHORTEST]
        self.tables = []
        for n in sorted({min(len(h), STRETCH) for _, h in self.items}):
            own = [k for k, (_, h) in enumerate(self.items) if min(len(h), STRETCH) == n]
            found = [_seeds(self.items[k][1], n) for k in own]
            sizes = [len(x[0]) for x in found]
            which, where = np.repeat(np.array(own, np.int32), sizes), np.concatenate([np.arange(z, dtype=np.int32) for z in sizes])
            masks = []
            for seeds in map(np.concatenate, zip(*found)):
                order = np.argsort(seeds, kind="stable")
                shift = np.uint64(64 - min(24, len(seeds).bit_length() + 4))
                bits = np.zeros(1 << (64 - int(shift)), bool)
                bits[seeds >> shift] = True
                masks.append((seeds[order], which[order], where[order], bits, shift))
            self.tables.append((n, masks))

    def find(self, docs: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """For each document, (item_id, equal words, aligned words, start in the document) of the best alignment of each item found."""
        out: list[list[tuple[int, int, int, int]]] = []
        while len(out) < len(docs):
            size, end = 0, len(out)
            while end < len(docs) and (end == len(out) or size + len(docs[end]) <= AT_ONCE):
                size, end = size + len(docs[end]), end + 1
            out += self._find(docs[len(out) : end])
        return out

    def _find(self, docs: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        h = np.concatenate(docs)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
        lines = []
        for n, masks in self.tables:
            for own, (seeds, which, where, bits, shift) in zip(_seeds(h, n), masks):
                at = np.flatnonzero(bits[own >> shift])
                a = np.searchsorted(seeds, own[at])
                times = np.searchsorted(seeds, own[at], "right") - a
                hit = np.flatnonzero(times)
                # a seed that recurs in text and benchmark gives a hit for each pair of its places: so many are taken at once
                for some in np.split(hit, np.flatnonzero(np.diff(np.cumsum(times[hit]) // HITS)) + 1) if len(hit) else ():
                    t = times[some]
                    x = np.repeat(a[some] - np.cumsum(t) + t, t) + np.arange(t.sum())
                    place = np.repeat(at[some], t)
                    doc = np.searchsorted(starts, place, "right") - 1
                    lines.append(np.unique(np.column_stack([doc, which[x], place - starts[doc] - where[x]]), axis=0))
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        # stretches that reach into the next document give lines too; words are compared within one document only
        for j, k, d in (np.unique(np.concatenate(lines), axis=0) if lines else np.empty((0, 3), int)).tolist():
            item, target = self.items[k]
            found = _aligned(docs[j], target, d)
            if found:
                one = (*found, item)
                best[j, item] = max(one, best.get((j, item), one))
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in docs]
        for j, item in sorted(best):
            m, n, s, _ = best[j, item]
            out[j].append((item, m, n, -s))
        return out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.selectExpr("cast(item_id as long) item_id", "text").where("item_id is not null and text is not null")


def _index(benchmark: DataFrame) -> Index | None:
    """The index of a benchmark of at most BLOCK_WORDS words, else None; words have a byte and a space at least."""
    own = _items(benchmark)
    if own.agg(F.expr("coalesce(sum(octet_length(text) + 1), 0)")).first()[0] > 2 * BLOCK_WORDS:
        return None
    return Index(sorted({(r[0], r[1]) for r in own.toLocalIterator()}))


def _digested(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, then a 128-bit digest of their words."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            raw = b"".join(hashlib.blake2b(b" ".join(words(t)), digest_size=16).digest() for t in batch.column(at).to_pylist())
            f = np.frombuffer(raw, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy())], [f"c{i}" for i in range(batch.num_columns + 2)])

    kinds = [f.dataType for f in docs.schema] + [LongType()] * 2
    return in_batches(docs, run, StructType([StructField(f"c{i}", t) for i, t in enumerate(kinds)]))


def _seeded(texts: DataFrame, key: list[str], lengths: list[int] | None, bits=None) -> DataFrame:
    """(key, n, mask, seed, at) of every place of the texts, in the length that an item has for itself or in all ``lengths``; only seeds that are in the bitmap."""

    def run(batches):
        known = _Hashes()
        for batch in batches:
            at = batch.num_columns - 1
            for i, text in enumerate(batch.column(at).to_pylist()):
                h = _hashes(text, known)
                for n in lengths or ([min(len(h), STRETCH)] if len(h) >= SHORTEST else []):
                    for m, seeds in enumerate(_seeds(h, n)):
                        places = np.arange(len(seeds), dtype=np.int64)
                        if bits is not None:
                            slot = (seeds >> np.uint64(64 - BITS)).astype(np.int64)
                            places = np.flatnonzero(bits.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                        if len(places):
                            k = len(places)
                            cols = [batch.column(c).take(pa.array([i] * k)) for c in range(at)]
                            yield pa.RecordBatch.from_arrays([*cols, pa.array([n] * k, pa.int32()), pa.array([m] * k, pa.int32()), pa.array(seeds[places].view(np.int64)), pa.array(places)], [*key, "n", "mask", "seed", "at"])

    return in_batches(texts.select(*key, "text"), run, ", ".join([*(f"{k} long" for k in key), "n int, mask int, seed long, at long"]))


def _dealt(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """t1, t2, item_id, matched, aligned, doc_start of each text (t1, t2, text) and item that it overlaps, by joins of seeds.

    A bitmap of the benchmark's seeds (2^BITS bits, whatever its size) leaves out most seeds of the texts before they are
    shuffled.  Texts are read again only for those that share a seed with an item.
    """
    spark = texts.sparkSession
    items = save(_items(benchmark).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = save(_seeded(items, ["item"], None).withColumnRenamed("at", "place"), "seeds")
    lengths = sorted(r["n"] for r in seeds.select("n").distinct().collect())
    byte = seeds.select(F.shiftrightunsigned("seed", 64 - BITS).alias("slot")).groupBy(F.shiftright("slot", 3).alias("b")).agg(F.bit_or(F.expr("cast(shiftleft(1, cast(slot & 7 as int)) as int)")).alias("v")).toPandas()
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    bits[byte["b"].to_numpy(np.int64)] = byte["v"].to_numpy(np.uint8)
    hits = _seeded(texts, ["t1", "t2"], lengths, spark.sparkContext.broadcast(bits))
    lines = hits.join(seeds, ["n", "mask", "seed"]).select("t1", "t2", "item", (F.col("at") - F.col("place")).alias("d")).distinct()
    lines = save(lines.groupBy("t1", "t2", "item").agg(F.collect_list("d").alias("ds")), "lines")
    read = texts.join(lines.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.min("text").alias("text"))
    pairs = lines.join(read, ["t1", "t2"]).join(items.select("item", "item_id", F.col("text").alias("wanted")), "item")

    def run(batches):
        known = _Hashes()
        for batch in batches:
            rows = []
            for t1, t2, item_id, ds, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                own, target = _hashes(text, known), _hashes(wanted, known)
                found = [x for x in (_aligned(own, target, d) for d in ds) if x]
                if found:
                    m, n, start = max(found)
                    rows.append((t1, t2, item_id, m, n, -start))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6, ["t1", "t2", "item_id", "matched", "aligned", "doc_start"])

    told = in_batches(pairs.select("t1", "t2", "item_id", "ds", "text", "wanted"), run, "t1 long, t2 long, item_id long, matched long, aligned long, doc_start long")
    best = told.groupBy("t1", "t2", "item_id").agg(F.max(F.struct("matched", "aligned", (-F.col("doc_start")).alias("s"))).alias("b"))
    return save(best.select("t1", "t2", "item_id", "b.matched", "b.aligned", (-F.col("b.s")).alias("doc_start")), "overlaps")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, aligned, doc_start of each document and benchmark item that it overlaps.

    Words are as in near-duplicate detection.  Items of fewer than 5 words are not looked for, those of 5 to 12 only
    as a whole, with at least 80 % of their words equal.  Null and empty texts match nothing; items that share an id are one; rows without an id
    are left out; repeated rows give repeated results; empty tables give no rows; other columns are ignored.
    A benchmark of up to BLOCK_WORDS words, which are counted, is broadcast; a larger one is joined.
    """
    own = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("doc_id is not null")
    index = _index(benchmark)
    if index is None:
        told = _digested(own).toDF("doc_id", "text", "t1", "t2")
        return told.select("doc_id", "t1", "t2").join(_dealt(told.select("t1", "t2", "text"), benchmark), ["t1", "t2"]).select("doc_id", "item_id", "matched", "aligned", "doc_start")
    sent = docs.sparkSession.sparkContext.broadcast(index)  # at most BLOCK_WORDS words

    def run(batches):
        known = _Hashes()
        for batch in batches:
            found = sent.value.find([_hashes(t, known) for t in batch.column(1).to_pylist()])
            rows = [(d, *x) for d, xs in zip(batch.column(0).to_pylist(), found) for x in xs]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, ["doc_id", "item_id", "matched", "aligned", "doc_start"])

    return in_batches(own, run, FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that overlap no benchmark item; rows without an id are looked at too."""
    at = docs.columns.index("text")
    index = _index(benchmark)
    if index is None:
        names = [f"c{i}" for i in range(len(docs.columns))]
        told = _digested(docs).toDF(*names, "t1", "t2")
        bad = _dealt(told.select("t1", "t2", F.col(names[at]).alias("text")), benchmark).select("t1", "t2").distinct()
        return told.join(bad, ["t1", "t2"], "left_anti").select(*names).toDF(*docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        known = _Hashes()
        for batch in batches:
            found = sent.value.find([_hashes(t, known) for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([not xs for xs in found], pa.bool_()))

    return in_batches(docs, run, docs.schema)
