"""Token counts by byte-pair merging with a heap and a linked list; no ids are made."""

from __future__ import annotations

import functools
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame

from gridbrook.llm.pretokens import BYTE_CHAR, Table, TokenizerFile, load, public_path
from gridbrook.llm.shared import in_batches

BYTE_BPE = "byte_bpe_50k.json"


class Counter:
    """Counts tokens of whole texts for the merges of ``file``."""

    def __init__(self, file: TokenizerFile):
        self.file, ids = file, file.vocab
        self.size = size = max(ids.values()) + 1
        #: left * size + right -> rank * size + merged
        self.merges: dict[int, int] = {}
        for r, (a, b) in enumerate(file.merges):
            self.merges.setdefault(ids[a] * size + ids[b], r * size + ids[a + b])
        self.bytes = [ids.get(c, -1) for c in BYTE_CHAR]
        self.last = [ids.get(c + file.suffix, -1) for c in BYTE_CHAR]
        self.words = Table(200_000, self.merged)

    def merged(self, word: str) -> int:
        """Symbols left of a word: the initial ones minus the merges.

        The heap holds rank * n + place of adjacent pairs: lowest rank, then leftmost, first.  A popped pair is
        stale unless the symbols now at its place still have that rank.
        """
        raw = word.encode("utf-8", "surrogateescape")
        at, n = [self.bytes[x] for x in raw], len(raw)
        if n and self.file.suffix:
            at[-1] = self.last[raw[-1]]
        size, found = self.size, self.merges.get
        heap = [m // size * n + i for i in range(n - 1) if (m := found(at[i] * size + at[i + 1], -1)) >= 0]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, left = [*range(1, n), -1], [*range(-1, n - 1)], n
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if j < 0 or at[i] < 0 or (m := found(at[i] * size + at[j], -1)) < 0 or m // size != r:
                continue
            left -= 1
            at[i], at[j], k = m % size, -1, after[j]
            after[i], h = k, before[i]
            if k >= 0:
                before[k] = i
                if (m := found(at[i] * size + at[k], -1)) >= 0:
                    heapq.heappush(heap, m // size * n + i)
            if h >= 0 and (m := found(at[h] * size + at[i], -1)) >= 0:
                heapq.heappush(heap, m // size * n + h)
        return left

    def count(self, text: str | None) -> int:
        total = 0
        for part, special in self.file.segments(text or ""):
            total += 1 if special is not None else sum(map(self.words.__getitem__, self.file.pieces(part)))
        return total


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(load(path))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``), one row for each row.

    Null and empty texts count 0; null ids stay null; repeated rows are repeated; other columns are ignored.
    Map side only, whole texts, memory bounded by a batch and a bounded table of words.
    """
    path = path or public_path(BYTE_BPE)

    def run(batches):
        c = counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_bytes": pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()),
                "over_limit": pa.array([x > limit for x in n], pa.bool_()),
            })

    return in_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
