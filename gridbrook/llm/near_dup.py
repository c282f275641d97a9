"""Near-duplicate detection: b-bit MinHash signatures and a multi-index Hamming join.

A signature has 32 symbols in 8 chunks of 4, the last of a chunk of 14 bits and the others of 15.  Two signatures that differ in at most 15 symbols have,
by pigeonhole, a chunk that differs in at most one, so they share a key (chunk, place left out, the three other
symbols): enumerating the place left out finds every pair within distance 15.  Pairs that share a key at
distance 16 are looked at too, which a pair of similarity 0.8 exceeds with probability 4e-5.  A longer sketch of
256 minima then sets aside most candidates of similarity under 0.7 before their texts are read.

Every candidate link is confirmed on the full shingle sets of whole texts.  Texts with equal sets are one node,
so copies are never paired.  Inside a key, rounds of leaders link members to a few of them, and only pairs that
are still in different components are then enumerated, so groups of near copies do not give all their pairs
and no link between components is lost.  In keys of many members a pair must also share one of its rarest shingles (the
prefix filter of exact set joins), so texts that have only a common passage together are not read against each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from gridbrook.llm.shared import components, drop, free_name, in_batches, save, settings

CHUNKS, WIDTH, MAX_DISTANCE, LEADERS, ROUNDS = 8, 4, 16, 4, 2
#: The longer sketch: so many minima, two bits each; a pair of similarity 0.8 differs in more than the limit with probability 1e-5.
MINIMA, SKETCH_DISTANCE = 256, 64
SKETCH = [f"t{i}" for i in range(MINIMA // 32)]
SIG = [f"s{i}" for i in range(CHUNKS)] + SKETCH
#: Members of different components from which on a key's pairs are held against their rarest shingles first; slots of the shingle counts.
CROWD, RANKS = 32, 1 << 16
#: Pairs of one leader, and members of one key, that meet in one task; more are dealt out.
PART, TILE = 256, 512
#: The JVM does not compile methods of over 8000 bytes: the condition on pairs then goes into smaller ones.
SPLIT = {"spark.sql.codegen.hugeMethodLimit": "8000"}
_ODD = np.random.default_rng(20240611).integers(1, 2**63, MINIMA, dtype=np.uint64) | np.uint64(1)
_PAIR = np.arange(0, 64, 2, dtype=np.uint64)
#: Bits of the symbols of a chunk; one bit a lane stays free, and the sign.
_LANES = np.array([0x7FFF] * (WIDTH - 1) + [0x3FFF], np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: True for every id; the planner makes a Bloom filter only of a side that has a condition.
_ANY = "{} >= -9223372036854775808L"


def words(text: str | None) -> list[bytes]:
    """Runs of other than ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, size: int) -> set[tuple]:
    w = words(text)
    return set(zip(*(w[i:] for i in range(size)))) if len(w) >= size else {tuple(w)} if w else set()


def _mix(x):
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    """Word -> 64-bit hash; bounded."""

    def __missing__(self, word):
        if len(self) > 50_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: str | None, size: int, known: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    n = len(w) - size + 1
    take = size if n > 0 else len(w)
    out = np.full(max(n, 1), np.uint64(take))
    for i in range(take):
        out = _mix(out * _B + h[i : i + len(out)])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """CHUNKS integers of WIDTH symbols each, then the sketch: two bits of each of MINIMA minima."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        low = np.minimum(low, (hashes[at : at + 512][:, None] * _ODD).min(axis=0))
    low = _mix(low)
    symbols = low[: CHUNKS * WIDTH].reshape(CHUNKS, WIDTH) & _LANES
    chunks = sum(symbols[:, p] << np.uint64(16 * p) for p in range(WIDTH))
    pairs = ((low >> np.uint64(40)) & np.uint64(3)).reshape(len(SKETCH), 32) << _PAIR
    return np.concatenate([chunks, np.bitwise_or.reduce(pairs, axis=1)]).view(np.int64)


def describe(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, n (set size), f1, f2 (128-bit digest of the set) and the signature of each row with an id."""

    def run(batches):
        known = _Hashes()
        for batch in batches:
            n, f, s = [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text, shingle_words, known)
                n.append(len(h))
                f.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                s.append(signature(h))
            f = np.frombuffer(b"".join(f), np.int64).reshape(-1, 2)
            s = np.array(s, np.int64).reshape(-1, len(SIG))
            cols = {"doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "f1": pa.array(f[:, 0].copy()), "f2": pa.array(f[:, 1].copy())}
            yield pa.RecordBatch.from_pydict(cols | {c: pa.array(s[:, i].copy()) for i, c in enumerate(SIG)})

    schema = "doc_id long, n long, f1 long, f2 long, " + ", ".join(f"{c} long" for c in SIG)
    return in_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text").where("doc_id is not null"), run, schema)


def _differ(c: str) -> str:
    """Symbols of chunk ``c`` in which a and b differ: adding these masks carries into a lane's spare bit unless it is 0."""
    return f"bit_count(((a.{c} ^ b.{c}) + {0x3FFF7FFF7FFF7FFF}L) & {0x4000800080008000}L)"


def _first_shared():
    """Whether the join's key is the first that a and b share, so that a pair is made once, not once a key.

    They share a key of a chunk if they differ in at most one of its symbols, and all four if in none.
    """
    earlier = " or ".join(f"(a.j >= {(i + 1) * WIDTH} and {_differ(c)} <= 1)" for i, c in enumerate(SIG[:CHUNKS]) if i < CHUNKS - 1)
    return F.expr(f"(a.j % {WIDTH} = 0 or a.own <> b.own) and not ({earlier})")


def _near(percent: int):
    """Whether sizes, sketches and signatures of a and b allow a link; short enough for the JVM's compiler to take the join's loop."""
    sizes = F.expr(f"least(a.n, b.n) * 100 >= {percent} * greatest(a.n, b.n)")
    differ = " + ".join(f"bit_count(((a.{c} ^ b.{c}) | ((a.{c} ^ b.{c}) >>> 1)) & {0x5555555555555555}L)" for c in SKETCH)
    return sizes & F.expr(f"{differ} <= {SKETCH_DISTANCE}") & F.expr(f"{' + '.join(map(_differ, SIG[:CHUNKS]))} <= {MAX_DISTANCE}")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= ``percent`` * union."""

    def run(batches):
        last, kept = None, set()
        for batch in batches:
            ok = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if a != last:
                    last, kept = a, shingle_set(ta, shingle_words)
                other = shingle_set(tb, shingle_words)
                both = len(kept & other)
                ok.append(100 * both >= percent * (len(kept) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # the pairs of a leader are dealt out to parts of bounded size, each with a copy of its text
    parts = save(pairs.where(_ANY.format("a")).groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "parts")
    some = parts.where("parts > 1")
    told = pairs.where(_ANY.format("a") + " and " + _ANY.format("b")).join(some, "a", "left").selectExpr("a", "b", "cast(if(parts > 1, pmod(xxhash64(b), parts), 0) as int) part")
    held = texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).join(told, "b")
    first = texts.join(parts.withColumnRenamed("a", "node"), "node").select(F.col("node").alias("a"), F.col("text").alias("ta"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    return in_batches(held.join(first, ["a", "part"]).select("a", "b", "ta", "tb"), run, "a long, b long")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` with c, the component of their node so far."""
    if labels is None:
        return members.withColumn("c", F.col("node"))
    return members.join(labels, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: connected components of the texts with similarity >= percent / 100.

    Words are runs of other than ASCII white space with A-Z lower-cased; a set holds the distinct shingles of
    ``shingle_words`` words, the whole sequence where there are fewer; null, empty and blank texts have no set
    and are linked with nothing.  component_id is the smallest doc_id reachable, kept is doc_id = component_id.
    Rows without an id stand alone: component_id null, kept true.  Rows that share an id are judged each by its own
    text, so that repeated rows have equal results.  No rows give no rows; other columns are ignored.
    """
    out = _grouped(docs, shingle_words, percent)[0].select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.expr("doc_id = component_id")).unionByName(_without_id(docs, shingle_words))


def _grouped(docs: DataFrame, shingle_words: int, percent: int) -> tuple[DataFrame, bool]:
    """doc_id, n, f1, f2, group and its least doc_id (both null without a set) of each row with an id, and whether ids repeat."""
    rows = save(describe(docs, shingle_words), "sets")
    keys = ["f1", "f2"]
    repeats = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    sets = rows.where("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("doc"), *(F.min(c).alias(c) for c in ["n", *SIG]))
    # a node is known by its smallest doc_id, or by a number of its own where an id may stand before several texts
    nodes = save(sets.withColumn("node", F.monotonically_increasing_id() if repeats else F.col("doc")), "nodes")

    # keys with equal members say the same: one of them stays
    exploded = nodes.select("node", F.explode(F.array(*_keys())).alias("x")).select("node", "x.j", "x.k")
    groups = exploded.groupBy("j", "k").agg(F.count(F.lit(1)).alias("g"), F.bit_xor(F.xxhash64("node")).alias("m1"), F.sum(F.xxhash64("node", F.lit(1)).bitwiseAND((1 << 40) - 1)).alias("m2")).where("g > 1")
    kept = groups.groupBy("g", "m1", "m2").agg(F.min(F.struct("j", "k")).alias("x")).select("x.j", "x.k")
    members = save(exploded.join(kept, ["j", "k"]), "members")
    ends = save(members.select("node").distinct(), "ends")
    if repeats:
        texts = save(_text_of_node(docs, nodes.join(ends, "node", "left_semi"), shingle_words), "texts")
    else:
        texts = save(docs.selectExpr("cast(doc_id as long) node", "text").join(ends.where(_ANY.format("node")), "node", "left_semi"), "texts")

    links = labels = None
    for r in range(ROUNDS):
        now = _labelled(members, labels)
        best = [F.expr(f"min(struct(xxhash64(node, {r * LEADERS + s}) as h, node, c))").alias(f"l{s}") for s in range(LEADERS)]
        told = now.groupBy("j", "k").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), *best).where("c0 <> c1")
        some = f"array_distinct(transform(array({', '.join(f'l{s}' for s in range(LEADERS))}), x -> struct(x.node, x.c)))"
        # written first, so that the join has plain inputs and a crowded key's members can be split between tasks
        leaders = save(told.select("j", "k", F.explode(F.expr(some)).alias("x")).select("j", "k", F.col("x.node").alias("a"), F.col("x.c").alias("ca")), "leaders")
        pairs = leaders.join(now, ["j", "k"]).where("ca <> c").select("a", F.col("node").alias("b")).distinct()
        links, labels, new = _linked(_close(pairs, nodes, percent), texts, links, labels, shingle_words, percent)
        drop(leaders)
        if not new:
            break
    now = _labelled(members, labels)
    mixed = save(now.groupBy("j", "k").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("g")).where("c0 <> c1").select("j", "k", "g"), "mixed")
    own = F.element_at(F.array(*SIG[:CHUNKS]), F.expr(f"cast(j div {WIDTH} + 1 as int)"))
    rest = save(now.join(mixed, ["j", "k"]), "rest")
    crowd = save(rest.where(F.col("g") > CROWD).select("node").distinct(), "crowd")
    read = save(texts.join(crowd.where(_ANY.format("node")), "node", "left_semi").select("node", "text"), "crowd-texts")
    rare = save(_rare_first(read, shingle_words, percent), "rare")
    full = rest.join(nodes.select("node", "n", *SIG), "node").join(rare, "node", "left").withColumn("own", own).withColumn("rare", F.when(F.col("g") > CROWD, F.col("rare")))
    # members of a large key are dealt into tiles, and each two tiles meet by themselves
    tiled = full.withColumn("tiles", F.ceil(F.col("g") / TILE).cast("int")).withColumn("tile", F.expr("cast(pmod(xxhash64(node), tiles) as int)"))
    ours = tiled.withColumn("u", F.col("tile")).withColumn("v", F.explode(F.expr("sequence(0, tiles - 1)"))).alias("a")
    theirs = tiled.withColumn("u", F.explode(F.expr("sequence(0, tiles - 1)"))).withColumn("v", F.col("tile")).alias("b")
    same = "a.j = b.j and a.k = b.k and a.u = b.u and a.v = b.v and a.node < b.node and a.c <> b.c"
    pairs = ours.join(theirs, F.expr(same) & _near(percent) & _first_shared() & _may_overlap(percent))
    links, labels, _ = _linked(_ends(pairs), texts, links, labels, shingle_words, percent)

    found = nodes.select(*keys, "node", "doc", F.lit(None).cast("long").alias("component")) if labels is None else nodes.select(*keys, "node", "doc").join(labels, "node", "left")
    found = found.select(*keys, "doc", F.coalesce("component", "node").alias("group"))
    if repeats:
        found = found.join(found.groupBy("group").agg(F.min("doc").alias("least")), "group")
    else:
        found = found.withColumn("least", F.col("group"))
    out = rows.select("doc_id", "n", *keys).join(found.select(*keys, "group", "least"), keys, "left")
    drop(members, mixed, ends, texts, links, rest, crowd, read, rare)
    return out, repeats


def _keys() -> list:
    """(chunk and place left out, the other symbols of the chunk) for each chunk and place."""
    out = []
    for i, c in enumerate(SIG[:CHUNKS]):
        for p in range(WIDTH):
            mask = int(np.uint64(2**64 - 1 - (0xFFFF << 16 * p)).view(np.int64))
            out.append(F.struct(F.lit(i * WIDTH + p).alias("j"), F.col(c).bitwiseAND(F.lit(mask).cast("long")).alias("k")))
    return out


def _close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow a link."""
    sig = nodes.select("node", "n", *SIG)
    ends = pairs.select(F.col("a").alias("one"), F.col("b").alias("two"))
    found = ends.join(sig.alias("a"), F.expr("one = a.node")).join(sig.alias("b"), F.expr("two = b.node")).where(_near(percent))
    return found.select(F.col("one").alias("a"), F.col("two").alias("b"))


def _rare_first(texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """node, rare: as many of a set's shingles as can be missing from a partner's set and one more, rarest first.

    Shingles are put in order by how often their slot of RANKS is hit by all of ``texts``, then by hash: the same order
    for all sets, so no link is lost whatever the counts.  The counts are a table of fixed size.
    """

    def count(batches):
        known, hits = _Hashes(), np.zeros(RANKS, np.int64)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                hits += np.bincount((shingle_hashes(text, shingle_words, known) % np.uint64(RANKS)).astype(np.int64), minlength=RANKS)
        at = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(hits[at])], ["slot", "hits"])

    often = np.zeros(RANKS, np.int64)
    for slot, hits in in_batches(texts, count, "slot long, hits long").groupBy("slot").agg(F.sum("hits")).collect():
        often[slot] = hits

    def run(batches):
        known = _Hashes()
        for batch in batches:
            rare = []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text, shingle_words, known)
                order = np.lexsort((h, often[(h % np.uint64(RANKS)).astype(np.int64)]))
                rare.append((h[order[: len(h) - -(-percent * len(h) // 100) + 1]] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rare, pa.list_(pa.int32()))], ["node", "rare"])

    return in_batches(texts, run, "node long, rare array<int>")


def _may_overlap(percent: int):
    """False where the rarest shingles of a and b show that they have less in common than a link needs.

    Two sets that have at least c in common share one of the first n - c + 1 shingles of each, in any order that holds for both.
    """
    common = f"cast(ceil({percent} * (a.n + b.n) / {100 + percent}.0D - 1e-6D) as int)"
    return F.expr(f"a.rare is null or b.rare is null or arrays_overlap(slice(a.rare, 1, cast(a.n as int) - {common} + 1), slice(b.rare, 1, cast(b.n as int) - {common} + 1))")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.expr("a.node").alias("a"), F.expr("b.node").alias("b")).distinct()


def _without_id(docs: DataFrame, shingle_words: int) -> DataFrame:
    """Rows without an id, each alone."""
    marked = docs.where("cast(doc_id as long) is null").select(F.lit(0).alias("doc_id"), "text")
    return describe(marked, shingle_words).select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))


def _digested(docs: DataFrame, shingle_words: int) -> DataFrame:
    """The rows of ``docs``, all columns, then n, f1 and f2 of their texts."""
    at = docs.columns.index("text")

    def run(batches):
        known = _Hashes()
        for batch in batches:
            sets = [shingle_hashes(t, shingle_words, known) for t in batch.column(at).to_pylist()]
            f = np.frombuffer(b"".join(hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets), np.int64).reshape(-1, 2)
            more = [pa.array([len(h) for h in sets], pa.int64()), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [f"c{i}" for i in range(batch.num_columns + 3)])

    kinds = [f.dataType for f in docs.schema] + [LongType()] * 3
    return in_batches(docs, run, StructType([StructField(f"c{i}", t) for i, t in enumerate(kinds)]))


def _text_of_node(docs: DataFrame, nodes: DataFrame, shingle_words: int) -> DataFrame:
    """For ids that stand before several texts: one text of those whose digest the node has."""
    own = docs.selectExpr("cast(doc_id as long) doc", "text").join(nodes.select("doc").distinct(), "doc", "left_semi")
    told = _digested(own, shingle_words).toDF("doc", "text", "n", "f1", "f2")
    return told.join(nodes.select("node", "doc", "f1", "f2"), ["doc", "f1", "f2"]).groupBy("node").agg(F.min("text").alias("text"))


def _linked(pairs, texts, links, labels, shingle_words, percent):
    """Confirmed links joined to those so far, labels over all of them, and whether links were added."""
    with settings(texts.sparkSession, SPLIT):
        pairs = save(pairs, "pairs")
    found = save(_confirmed(pairs, texts, shingle_words, percent), "links")
    drop(pairs)
    if found.isEmpty():
        drop(found)
        return links, labels, False
    joined = found if links is None else save(links.union(found), "links")
    if joined is not found:
        drop(found, links)
    after = components(joined)
    drop(labels)
    return joined, after, True


def keep_one(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group, and all without a set or an id.

    Of a group stays the row of the smallest id, ties to the smaller digest of the set, then to the smaller text.
    Rows that share an id but not a group are judged apart.
    """
    told, repeats = _grouped(docs, shingle_words, percent)
    if not repeats:
        kept = free_name(docs, "kept_id")
        told = told.where("group is null or least = doc_id").select(F.col("doc_id").alias(kept))
        return docs.join(told, F.expr(f"cast(doc_id as long) = {kept}")).select(*docs.columns).unionByName(docs.where("cast(doc_id as long) is null"))
    first = told.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "f1", "f2")).alias("x")).select("x.*")
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    marked = _digested(docs, shingle_words).toDF(*names, "n_", "f1_", "f2_")
    alone = marked.where(f"n_ = 0 or cast({own} as long) is null")
    stay = marked.where("n_ > 0").join(first, F.expr(f"cast({own} as long) = doc_id and f1_ = f1 and f2_ = f2"))
    stay = stay.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "f1", "f2").orderBy(text))).where("place = 1")
    return stay.select(*names).unionByName(alone.select(*names)).toDF(*docs.columns)
