"""Byte-pair encoding and decoding by a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that byte-pair merging yields.  It starts with one state
that loops on every base symbol; each merge (a, b) -> c, in rank order, applies one gadget where the state
reached by ``a`` has an arc ``b`` (else merging never meets the pair, and the gadget is void):

* the state reached by ``a`` loses its arc ``b`` (that path now reads ``c``);
* every state that still has an arc ``a`` gains an arc ``c``;
* the state reached by ``c`` is a snapshot of the state reached by ``b`` before this merge.

All arcs with one label lead to one state, so a state is named by the token that leads to it, and a gadget is
three facts: the removed arc with its rank, the arc that ``c`` follows, and the snapshot.  Storing these instead
of copied arc lists keeps the automaton at O(merges) instead of O(vocabulary squared); ``arc`` reads a
transition out of the snapshots and the table keeps what it has read.

One token sequence of every string is accepted, and all prefixes of an accepted sequence are.  So each place of a
word is reached in one state, and a word is encoded in one pass from left to right without going back.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridbrook.llm.pretokens import Table, TokenizerFile, load, public_path
from gridbrook.llm.shared import in_batches

WORD_BPE = "word_bpe_49k.json"
OUT = "doc_id long, n_tokens long, token_ids array<int>, ids_sha256 string, decoded_sha256 string"


class Automaton:
    """Transitions of the merge automaton of ``file``; base symbols are tokens without a merge."""

    def __init__(self, file: TokenizerFile, table_size: int = 300_000):
        n = max(file.vocab.values()) + 1
        self.born, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.removed: dict[int, int] = {}
        self.n, self.suffix, self.table, self.table_size = n, file.suffix, {}, table_size
        self.gadgets = len(file.merges)
        made = {file.vocab[a + b] for a, b in file.merges}
        self.live = [i not in made for i in range(n)]
        for rank, (a, b) in enumerate(file.merges):
            self._gadget(rank, file.vocab[a], file.vocab[b], file.vocab[a + b])
        self.labels = [""] * n
        for text, i in file.vocab.items():
            self.labels[i] = text
        self.sizes = [len(text.removesuffix(self.suffix)) for text in self.labels]
        #: Tokens that some path reads: those that end a word by their bare text, the others in a table of all prefixes, -1 for mere prefixes.
        self.last: dict[str, int] = {}
        self.inner: dict[str, int] = {}
        for text, i in file.vocab.items():
            if self.live[i]:
                bare = text[: self.sizes[i]]
                for k in range(1, len(bare) + 1):
                    self.inner.setdefault(bare[:k], -1)
                if bare == text:
                    self.inner[bare] = i
                if bare != text or not self.suffix:
                    self.last[bare] = i

    def _gadget(self, rank: int, a: int, b: int, c: int) -> None:
        if self.live[a] and self.live[b] and self._read(a, b, rank):
            self.removed[a * self.n + b] = rank
            if self.born[c] < 0:
                self.born[c], self.left[c], self.right[c], self.live[c] = rank, a, b, True

    def arc(self, state: int, label: int) -> bool:
        """Whether ``label`` leaves the state reached by ``state``."""
        key = state * self.n + label
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= self.table_size:
                self.table.clear()
            known = self.table[key] = self._read(state, label, self.gadgets)
        return known

    def _read(self, state: int, label: int, until: int) -> bool:
        """The arc as it is when the gadgets with ranks below ``until`` have been applied."""
        while True:
            if self.removed.get(state * self.n + label, until) < until:
                return False
            if self.born[state] > self.born[label]:  # the state is a snapshot from before its own merge
                until, state = self.born[state], self.right[state]
            elif self.born[label] >= 0:  # the arc followed that of the label's left part, after the label's own merge removed its arc
                until, label = self.born[label] + 1, self.left[label]
            else:
                return True

    def encode(self, symbols: list[str]) -> list[int]:
        """Ids of a word: each place's state is the token of the one arc that leads there."""
        text, n, width, known = "".join(symbols).removesuffix(self.suffix), len(symbols), self.n, self.table.get
        inner, last = self.inner.get, self.last.get
        states = [-1] * (n + 1)
        for at in range(n):
            state = states[at]
            if at and state < 0:
                continue
            for end in range(at + 1, n):
                token = inner(text[at:end])
                if token is None:
                    break
                if token >= 0:
                    leads = known(state * width + token) if at else True
                    if leads or (leads is None and self.arc(state, token)):
                        states[end] = token
            else:
                token = last(text[at:])
                if token is not None and (not at or self.arc(state, token)):
                    states[n] = token
        out, at = [], n
        while at:
            if states[at] < 0:
                raise ValueError(f"no accepted path for {text[:80]!r}")
            out.append(states[at])
            at -= self.sizes[states[at]]
        return out[::-1]


class Codec:
    """Whole texts to ids and back, as the library does for a file without a decoder."""

    def __init__(self, path: str):
        self.file = load(path)
        self.automaton = Automaton(self.file)
        self.words = Table(150_000, lambda w: np.array(self.automaton.encode(self.file.symbols(w)), "<u4").tobytes())
        self.labels = self.automaton.labels + [""] * (max([-1, *self.file.special.values()]) + 1 - self.automaton.n)
        for text, i in self.file.special.items():
            self.labels[i] = text

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null and empty texts give none."""
        out = []
        for part, special in self.file.segments(text or ""):
            out += [special.to_bytes(4, "little")] if special is not None else map(self.words.__getitem__, self.file.pieces(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, joined by spaces as the library joins tokens without a decoder."""
        labels = self.labels
        return " ".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Encode the whole ``text`` of each row and decode the ids.

    Returns doc_id, n_tokens, token_ids (unless ``keep_ids`` is false), ids_sha256 and decoded_sha256, one row
    for each row; null and empty texts have no tokens, null ids stay null, repeated rows are repeated, other
    columns are ignored and no rows give no rows.  Map side only: no shuffle, memory bounded by a batch.
    """
    path = path or public_path(WORD_BPE)

    def run(batches):
        c = codec(path)
        for batch in batches:
            rows = {k: [] for k in ("n", "ids", "a", "b")}
            for text in batch.column(1).to_pylist():
                ids = c.encode(text)
                rows["n"].append(len(ids) // 4)
                if keep_ids:
                    rows["ids"].append(np.frombuffer(ids, "<i4"))
                rows["a"].append(hashlib.sha256(ids).hexdigest())
                rows["b"].append(hashlib.sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            cols = {"doc_id": batch.column(0), "n_tokens": pa.array(rows["n"], pa.int64())}
            if keep_ids:
                cols["token_ids"] = pa.array(rows["ids"], pa.list_(pa.int32()))
            cols |= {"ids_sha256": pa.array(rows["a"], pa.string()), "decoded_sha256": pa.array(rows["b"], pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    schema = OUT if keep_ids else OUT.replace("token_ids array<int>, ", "")
    return in_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, schema)
