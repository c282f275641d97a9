"""Directed graphs as edge tables (src, dst): closures, components, levels and sub-graphs.

Where a graph has at most TASK_EDGES edges, which is counted first, one executor task walks it in memory; larger ones
go through rounds of joins with equal results.  src is upstream of dst; leaves have no sources, roots no targets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridbrook.operators.tables import drop, save

#: Edges that one task takes (a few arrays of 8 bytes an edge).
TASK_EDGES = 2_000_000


def from_down(down: DataFrame) -> DataFrame:
    """Edges of a branching (id, down), in which every node has at most one target; 0 and null stand for none."""
    return down.where("down is not null and down <> 0").select(F.col("id").alias("src"), F.col("down").alias("dst"))


def with_sources(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges with those of ``more`` (id, source) added; each is there once."""
    return edges.select("src", "dst").union(more.select(F.col("source").alias("src"), F.col("id").alias("dst"))).distinct()


def by_tag(edges: DataFrame, tags: DataFrame) -> DataFrame:
    """Edges between tags out of edges between ids, by the table (id, tag)."""
    return edges.join(tags.select(F.col("id").alias("src"), F.col("tag").alias("s")), "src").join(tags.select(F.col("id").alias("dst"), F.col("tag").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def upstream_lists(edges: DataFrame) -> DataFrame:
    """(id, sources): the sorted sources of each node that has some."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("sources"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_sources, n_targets) of every node."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("dst").alias("id"), F.lit(1).alias("s"), F.lit(0).alias("t")).unionAll(e.select("src", F.lit(0), F.lit(1)))
    counts = ends.groupBy("id").agg(F.sum("s").alias("n_sources"), F.sum("t").alias("n_targets"))
    return nodes.select("id").join(counts, "id", "left").fillna(0, ["n_sources", "n_targets"])


def sources(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, source) of the nodes ``ids``."""
    return edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("source")).distinct()


def targets(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, target) of the nodes ``ids``."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("target")).distinct()


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(row, column): the set cells of the matrix, with places of ids in ascending order from 1, row the target."""
    from gridbrook.operators.sequence import dense_rank

    place = dense_rank(nodes.select("id").distinct(), [], "id")
    own = lambda k, to: place.select(F.col("id").alias(k), F.col("rank").alias(to))
    return edges.select("src", "dst").distinct().join(own("src", "column"), "src").join(own("dst", "row"), "dst").select("row", "column")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a target."""
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a source."""
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def _arrays(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (a, b), b null for a row that marks a node: the edges' two columns and the marked nodes."""
    both = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1)) for b in batches]
    a = np.concatenate([x for x, _ in both]) if both else np.empty(0, np.int64)
    known = np.concatenate([~y.is_null().to_numpy(zero_copy_only=False) for _, y in both]) if both else np.empty(0, bool)
    b = np.concatenate([y.fill_null(0).to_numpy(zero_copy_only=False) for _, y in both]) if both else np.empty(0, np.int64)
    return a[known], b[known], a[~known]


def _heads(ids: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Edges as places in ``ids``, ordered by a: the starts of each node's edges and their ends."""
    x, y = np.searchsorted(ids, a), np.searchsorted(ids, b)
    order = np.argsort(x, kind="stable")
    return np.searchsorted(x[order], np.arange(len(ids) + 1)), y[order], x


def _next(starts, ends, front):
    counts = starts[front + 1] - starts[front]
    at = np.repeat(starts[front] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    return ends[at]


def _reached(batches):
    a, b, seeds = _arrays(batches)
    ids = np.unique(np.concatenate([a, b, seeds]))
    starts, ends, _ = _heads(ids, a, b)
    seen = np.zeros(len(ids), bool)
    front = np.unique(np.searchsorted(ids, seeds))
    while len(front):
        seen[front] = True
        front = np.unique(_next(starts, ends, front))
        front = front[~seen[front]]
    yield pa.RecordBatch.from_arrays([pa.array(ids[seen])], ["id"])


def _levelled(batches):
    a, b, nodes = _arrays(batches)
    ids = np.unique(np.concatenate([a, b, nodes]))
    starts, ends, _ = _heads(ids, a, b)
    wait = np.bincount(np.searchsorted(ids, b), minlength=len(ids))
    level, now = np.zeros(len(ids), np.int32), 1
    front = np.flatnonzero(wait == 0)
    while len(front):
        level[front] = now
        hit = _next(starts, ends, front)
        np.subtract.at(wait, hit, 1)
        front, now = np.unique(hit[wait[hit] == 0]), now + 1
    done = level > 0
    yield pa.RecordBatch.from_arrays([pa.array(ids[done]), pa.array(level[done])], ["id", "level"])


def _component(batches):
    a, b, _ = _arrays(batches)
    ids = np.unique(np.concatenate([a, b]))
    x, y = np.searchsorted(ids, a), np.searchsorted(ids, b)
    root = np.arange(len(ids))
    while True:  # hook the larger root under the smaller, then halve all paths
        rx, ry = root[x], root[y]
        off = rx != ry
        if not off.any():
            break
        np.minimum.at(root, np.maximum(rx, ry)[off], np.minimum(rx, ry)[off])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["node", "component"])


def _in_one_task(edges: DataFrame, marks: DataFrame | None, walk: Callable, schema: str) -> DataFrame:
    rows = edges.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))
    if marks is not None:
        rows = rows.unionByName(marks.select(F.col("id").cast("long").alias("a"), F.lit(None).cast("long").alias("b")))
    return rows.coalesce(1).mapInArrow(walk, schema)


def reach(edges: DataFrame, start: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """Ids that paths along the edges reach from ``start`` (itself included), breadth first."""
    e = save(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    seeds = save(start.select("id").where("id is not null").distinct(), "seeds")
    if e.count() + seeds.count() <= task_edges:
        return _in_one_task(e, seeds, _reached, "id long")
    parts, front = [seeds], seeds
    while True:  # a front is written by itself; the union of all is only read
        found = parts[0]
        for p in parts[1:]:
            found = found.union(p)
        new = save(e.join(front.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(found, "id", "left_anti"), "front")
        if new.isEmpty():
            drop(new)
            return found
        parts.append(new)
        if len(parts) == 64:
            parts = [save(found.union(new), "reached")]
        front = new


def dependents(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Ids downstream of ``start``, itself left out."""
    return reach(edges, start).join(start.select("id"), "id", "left_anti")


def dependencies(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Ids upstream of ``start``, itself left out."""
    return dependents(_turned(edges), start)


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def levels(nodes: DataFrame, edges: DataFrame, from_roots: bool = False, reverse: bool = False, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, level): the longest path from the nodes without sources (or targets); nodes on and behind cycles have no row.

    ``reverse`` counts levels from the other end of the same order.
    """
    e = save((_turned(edges) if from_roots else edges).select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    left = save(nodes.select(F.col("id").cast("long").alias("id")).union(e.select("src")).union(e.select("dst")).distinct(), "nodes")
    if e.count() + left.count() <= task_edges:
        out = _in_one_task(e, left, _levelled, "id long, level int")
    else:
        done, level = [], 1
        while True:
            ready = save(leaves(left, e).select("id", F.lit(level).alias("level")), "level")
            if ready.isEmpty():
                break
            done.append(ready)
            was = left, e
            left = save(left.join(ready, "id", "left_anti"), "nodes")
            e = save(e.join(ready.select(F.col("id").alias("src")), "src", "left_anti"), "edges")
            drop(*was)
            level += 1
            if len(done) == 64:
                done = [save(_union(done), "levels")]
        out = _union(done) if done else left.select("id", F.lit(1).alias("level")).limit(0)
    return out.crossJoin(F.broadcast(out.agg(F.max("level").alias("top")))).select("id", (F.col("top") + 1 - F.col("level")).cast("int").alias("level")) if reverse else out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def order(nodes: DataFrame, edges: DataFrame, reverse: bool = False) -> DataFrame:
    """Topological order as (id, level), sources first or with ``reverse`` last; raises where the graph has a cycle."""
    out = save(levels(nodes, edges, reverse=reverse), "order")
    if out.count() != nodes.select(F.col("id").cast("long")).union(edges.select("src")).union(edges.select("dst")).distinct().count():
        raise ValueError("the graph has a cycle")
    return out


def sorted_order(ordered: DataFrame) -> DataFrame:
    """(place, id): one row for each node, levels in turn and ids ascending within them, from 1."""
    before = F.coalesce(F.sum("n").over(_up_to("level")), F.lit(0))
    starts = ordered.groupBy("level").agg(F.count(F.lit(1)).alias("n")).select("level", before.alias("start"))
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("level").orderBy("id"))
    return ordered.withColumn("k", place).join(F.broadcast(starts), "level").select((F.col("k") + F.col("start")).alias("place"), "id")


def _up_to(c: str):
    from pyspark.sql.window import Window

    return Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)


def subgraph(edges: DataFrame, start: DataFrame, down: bool = False) -> DataFrame:
    """Edges among ``start`` and what lies upstream (or downstream) of it."""
    kept = reach(edges if down else _turned(edges), start)
    return edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")


#: What a visitor may answer: go on, leave out what lies behind the node, or end the walk.
CONTINUE, SKIP_CHILDREN, STOP_ALL = 0, 1, 2


def traverse(edges: DataFrame, start: list[int], visit: Callable[[int], int | None], down: bool = False, most: int = TASK_EDGES) -> list[int]:
    """Visit nodes depth first from ``start``, each once, upstream (or downstream), lowest ids first; returns those visited.

    The visitor is arbitrary code in sequence, so the walk is the driver's: what is reachable is cut out first and must
    have at most ``most`` edges.
    """
    spark = edges.sparkSession
    seeds = spark.createDataFrame([(int(s),) for s in start], "id long")
    own = subgraph(edges, seeds, down)
    rows = own.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges are reachable")
    behind: dict[int, list[int]] = {}
    for r in rows:
        a, b = (r["src"], r["dst"]) if down else (r["dst"], r["src"])
        behind.setdefault(a, []).append(b)
    seen, out, todo = set(), [], [int(s) for s in reversed(start)]
    while todo:
        node = todo.pop()
        if node in seen:
            continue
        seen.add(node)
        out.append(node)
        answer = visit(node)
        if answer == STOP_ALL:
            break
        if answer != SKIP_CHILDREN:
            todo += sorted(set(behind.get(node, ())) - seen, reverse=True)
    return out


def components(edges: DataFrame, max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (a, b), component its smallest reachable node.

    Up to ``task_edges`` edges, one executor task joins them.  Beyond, alternating large-star and small-star steps:
    O(log^2 n) rounds, each a few shuffles of the edges.  Hubs are pre-aggregated by the map side of ``min`` and split by
    the skew join of the adaptive planner.  Loops and nulls are ignored; no edges give no rows; raises if ``max_rounds``
    do not suffice.
    """
    now = save(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(),
        "edges",
    )
    digest = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first())
    seen = digest(now)
    if seen[0] <= task_edges:
        out = save(_in_one_task(now.select(F.col("x").alias("src"), F.col("y").alias("dst")), None, _component, "node long, component long"), "components")
        drop(now)
        return out
    for _ in range(max_rounds):
        both = now.union(now.select("y", "x"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        root = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(root, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(root).distinct()
        after = save(small, "edges")
        was, seen = seen, digest(after)
        drop(now)
        now = after
        if was == seen:
            break
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    ends = now.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()
    out = now.select(F.col("x").alias("node"), F.col("y").alias("component")).union(ends)
    out._saved_at = now._saved_at
    return out
