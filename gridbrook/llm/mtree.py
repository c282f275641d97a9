"""Exact top-k inner-product search by best-first search of M-trees.

Vectors become integers floor(scale * x).  With one more coordinate sqrt(R^2 - |x|^2), R the largest norm of all,
Euclidean distance orders rows as the inner product does: d(q, x)^2 = |q|^2 + R^2 - 2 q.x.  The uppermost page has a
bounded number of routing objects; every row goes to the nearest one, and the rows of one are dealt into trees of
bounded size.  A tree has pages of entries (routing object, covering radius, distance to the parent's object).  A
search takes pages in order of their lower bound and leaves out entries whose distance the triangle inequality bounds
from the stored parent distance.  A query first searches the trees of the routing object with the least bound; its
k-th best score there leaves out the objects that cannot do better, and bounds the search in the others.  Trees and
blocks of queries meet in groups of bounded size; the results of a query are merged by rank.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridbrook.llm.shared import in_batches, save

LEAF, FANOUT, TREE_ROWS, BLOCK = 256, 32, 16384, 2048
#: Routing objects of the uppermost page, one for so many rows.
MOST_ROUTES, ROUTE_ROWS = 1024, 4096
SLACK = 1e-6


class Page:
    """Entries of a node: objects (rows of ints), radii, distances to the parent's object, and row ids or child pages."""

    __slots__ = ("leaf", "objects", "last", "radii", "parents", "ids", "pages")

    def __init__(self, leaf, objects, last, radii, parents, ids, pages):
        self.leaf, self.objects, self.last, self.radii, self.parents, self.ids, self.pages = leaf, objects, last, radii, parents, ids, pages


def build(ids: np.ndarray, vectors: np.ndarray, top: float | None = None) -> tuple[list[Page], float]:
    """Bulk-load a tree, page 0 its root; returns its pages and R^2, which is that of its own rows where not given."""
    squares = (vectors * vectors).sum(axis=1)
    if top is None:
        top = float(squares.max()) if len(ids) else 0.0
    full = np.column_stack([vectors, np.sqrt(np.maximum(top - squares, 0))])
    pages: list[Page] = []

    def distance(rows, centre):
        return np.sqrt(np.maximum(((full[rows] - full[centre]) ** 2).sum(axis=1), 0))

    def load(rows: np.ndarray, parent: int | None) -> int:
        at = len(pages)
        pages.append(None)
        to_parent = distance(rows, parent) if parent is not None else np.zeros(len(rows))
        if len(rows) <= LEAF:
            order = np.argsort(ids[rows], kind="stable")
            rows, to_parent = rows[order], to_parent[order]
            pages[at] = Page(True, vectors[rows], full[rows, -1], np.zeros(len(rows)), to_parent, ids[rows], np.zeros(len(rows), np.int64))
            return at
        k = min(FANOUT, math.ceil(len(rows) / LEAF) + 1)
        chosen, near = [rows[0]], distance(rows, rows[0])
        while len(chosen) < k and near.max() > 0:  # farthest-first routing objects
            chosen.append(rows[int(near.argmax())])
            near = np.minimum(near, distance(rows, chosen[-1]))
        side = np.column_stack([distance(rows, c) for c in chosen])
        mine = side.argmin(axis=1)
        groups = [(c, rows[mine == g], side[mine == g, g]) for g, c in enumerate(chosen)]
        if len(chosen) == 1:  # equal vectors: split by count
            groups = [(rows[0], part, np.zeros(len(part))) for part in np.array_split(rows, min(FANOUT, math.ceil(len(rows) / LEAF)))]
        else:  # a group that took nearly all rows is cut in two by distance, so depth stays logarithmic
            cut = []
            for c, part, d in groups:
                if len(part) > 0.9 * len(rows):
                    order = np.argsort(d, kind="stable")
                    half = len(order) // 2
                    cut += [(c, part[order[:half]], d[order[:half]]), (c, part[order[half:]], d[order[half:]])]
                else:
                    cut.append((c, part, d))
            groups = [g for g in cut if len(g[1])]
        centres = np.array([c for c, _, _ in groups])
        up = distance(centres, parent) if parent is not None else np.zeros(len(groups))
        children = np.array([load(part, c) for c, part, _ in groups])
        pages[at] = Page(False, vectors[centres], full[centres, -1], np.array([d.max() for _, _, d in groups]), up, np.zeros(len(groups), np.int64), children)
        return at

    load(np.arange(len(ids)), None)
    return pages, top


def search(pages: list[Page], top: float, query: np.ndarray, own: int, k: int, least: int | None = None) -> list[tuple[int, int]]:
    """The (score, id) of the k best rows other than ``own``, best first, ties to smaller ids; only scores of ``least`` and more where given."""
    square = float(query @ query)
    best: list[tuple[int, int]] = []  # heap of (score, -id)
    reach = math.inf if least is None else math.sqrt(max(0.0, square + top - 2 * least))
    queue = [(0.0, 0, math.nan)]
    while queue:
        low, at, to_parent = heapq.heappop(queue)
        if low > reach + SLACK:
            break
        page = pages[at]
        if to_parent == to_parent and reach < math.inf:  # the stored distance bounds d without computing it
            use = np.flatnonzero(np.abs(to_parent - page.parents) - page.radii <= reach + SLACK)
            if not len(use):
                continue
        else:
            use = slice(None)
        scores = page.objects[use] @ query
        if page.leaf:
            ids = page.ids[use]
            floor = best[0][0] if len(best) == k else least
            if floor is not None:
                good = np.flatnonzero(scores >= floor)
                scores, ids = scores[good], ids[good]
            for s, i in zip(scores.astype(np.int64).tolist(), ids.tolist()):
                if i != own:
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                reach = min(reach, math.sqrt(max(0.0, square + top - 2 * best[0][0])))
        else:
            d = np.sqrt(np.maximum(square + top - 2 * scores, 0))
            lows = np.maximum(d - page.radii[use], low)
            for lo, dist, child in zip(lows.tolist(), d.tolist(), page.pages[use].tolist()):
                if lo <= reach + SLACK:
                    heapq.heappush(queue, (lo, child, dist))
    return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def integer_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, v) with v the array of floor(scale * x); rows whose vector or id is null, or has a null or non-finite part, left out."""
    own = rows.selectExpr(f"cast(`{id_column}` as long) as id", f"cast(`{vector_column}` as array<double>) as x")
    fine = own.where("id is not null and x is not null and forall(x, e -> e is not null and not isnan(e) and abs(e) < double('infinity'))")
    return fine.select("id", F.expr(f"transform(x, e -> floor(e * {scale}))").alias("v"))


def top_k(rows: DataFrame, every: int = 20, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of every query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with another id.  Vectors that
    are null or hold null or non-finite parts take no part; vectors of different lengths are compared only with
    their own length.  A repeated row is a candidate of its own; a repeated query is asked once.  No rows give no rows;
    other columns are ignored.  Scores are exact while all products of vectors stay below 2^53.
    """
    ready = save(integer_vectors(rows, id_column, vector_column, scale).withColumn("size", F.size("v")), "vectors")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda t, e: t + e * e)
    found = ready.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.expr(f"count_if(id % {every} = 0)").alias("q"), F.max(norm).cast("double").alias("top")).where("q > 0")
    layout = save(found.selectExpr("size", "n", "top", f"cast(ceil(q / {BLOCK}) as int) blocks", f"cast(least({MOST_ROUTES}, ceil(n / {ROUTE_ROWS})) as int) routes"), "layout")
    own = ready.join(F.broadcast(layout.limit(10_000)) if layout.limit(10_001).count() <= 10_000 else layout, "size")
    # routing objects: the rows with the least hashes, a bounded sample
    place = F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("id", F.lit(3)), "id", "v"))
    picked = own.withColumn("k", place).where(F.col("k") <= F.col("routes"))
    objects = save(picked.select("size", (F.col("k") - 1).cast("int").alias("route"), F.col("v").alias("object")), "objects")
    routed = save(_routed(own, objects), "routed")
    parts = routed.groupBy("size", "route").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    spread = save(parts.join(objects, ["size", "route"]).select("size", "route", "object", "radius", F.ceil(F.col("n") / TREE_ROWS).cast("int").alias("trees")), "routes")
    grown = routed.join(F.broadcast(spread.select("size", "route", "trees")), ["size", "route"]).withColumn("tree", F.expr("cast(pmod(xxhash64(id, 1), trees) as int)"))

    def build_pages(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1)
        pages, top = build(pdf["id"].to_numpy(np.int64), vectors, float(pdf["top"].iloc[0]))
        pack = lambda a, t: np.ascontiguousarray(a, t).tobytes()
        return pd.DataFrame([
            (*key, i, p.leaf, pack(p.ids, "<i8"), pack(p.objects, "<f8"), pack(p.last, "<f8"), pack(p.radii, "<f8"), pack(p.parents, "<f8"), pack(p.pages, "<i8"), top)
            for i, p in enumerate(pages)
        ], columns=["size", "route", "tree", "blocks", "page", "leaf", "ids", "objects", "last", "radii", "parents", "pages", "top"])

    schema = "size int, route int, tree int, blocks int, page int, leaf boolean, ids binary, objects binary, last binary, radii binary, parents binary, pages binary, top double"
    pages = save(grown.groupBy("size", "route", "tree", "blocks").applyInPandas(build_pages, schema), "pages")
    asked = own.where(f"id % {every} = 0").dropDuplicates(["size", "id"]).withColumn("block", F.expr("cast(pmod(xxhash64(id, 2), blocks) as int)"))
    bounds = save(_bounded(asked.select("size", "block", "id", "v", "top"), spread), "bounds")
    # the first routing object of each query, then those that may hold a score as good as its k-th best there
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = save(_searched(bounds.where("turn = 0").withColumn("least", F.lit(None).cast("long")), spread, pages, k), "first")
    kth = first.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("c"))
    kth = kth.select(F.col("query_id").alias("id"), F.when(F.col("c") == k, F.col("least")).alias("least"))
    rest = bounds.where("turn > 0").join(kth, "id", "left").where("least is null or best >= least")
    hits = first.unionByName(_searched(rest, spread, pages, k))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _augmented(v: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))])


def _routed(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """``rows`` with route, the nearest routing object, and far, the distance to it; the objects of a size are broadcast."""
    table: dict[int, np.ndarray] = {}
    for size, held in objects.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("route", "object"))).alias("o")).toLocalIterator():
        table[size] = np.array([o["object"] for o in held], np.float64)  # at most MOST_ROUTES vectors a size
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            size, top = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            route, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            vectors = batch.column(2).to_pylist()
            for z in np.unique(size).tolist():
                at = np.flatnonzero(size == z)
                r2 = float(top[at[0]])
                own = _augmented(np.array([vectors[i] for i in at], np.float64).reshape(len(at), z), r2)
                them = _augmented(sent.value[z].reshape(-1, z), r2)
                near = (own * own).sum(axis=1)[:, None] - 2 * own @ them.T + (them * them).sum(axis=1)
                route[at] = near.argmin(axis=1)
                far[at] = np.sqrt(((own - them[route[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(route), pa.array(far)], ["id", "size", "v", "top", "blocks", "route", "far"])

    return in_batches(rows.select("id", "size", "v", "top", "blocks"), run, "id long, size int, v array<long>, top double, blocks int, route int, far double")


def _bounded(asked: DataFrame, spread: DataFrame) -> DataFrame:
    """Each query beside each routing object: best, the highest score that a row of it may have, and turn, its place by that from 0."""
    table: dict[int, tuple] = {}
    for size, held in spread.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("route", "object", "radius"))).alias("o")).toLocalIterator():
        table[size] = (np.array([o["route"] for o in held], np.int32), np.array([o["object"] for o in held], np.float64), np.array([o["radius"] for o in held]))
    sent = asked.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            for i, (size, block, q, v, r2) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                routes, objects, radius = sent.value[size]
                own, them = np.array(v, np.float64), _augmented(objects.reshape(-1, size), r2)
                square = float(own @ own)
                # the query has 0 as its last coordinate
                d = np.sqrt(np.maximum(square + (them * them).sum(axis=1) - 2 * them[:, :size] @ own, 0))
                low = np.maximum(d - radius - SLACK, 0)
                best = np.ceil((square + r2 - low * low) / 2 + SLACK).astype(np.int64)
                turn = np.empty(len(routes), np.int32)
                turn[np.lexsort((routes, low))] = np.arange(len(routes), dtype=np.int32)
                n = len(routes)
                yield pa.RecordBatch.from_pydict({
                    "size": pa.array([size] * n, pa.int32()), "block": pa.array([block] * n, pa.int32()), "id": pa.array([q] * n, pa.int64()),
                    "v": batch.column(3).take(pa.array([i] * n)), "route": pa.array(routes), "best": pa.array(best), "turn": pa.array(turn),
                })

    return in_batches(asked, run, "size int, block int, id long, v array<long>, route int, best long, turn int")


def _searched(pairs: DataFrame, spread: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best rows (of ``least`` and more) of each pair of a query and a routing object, by its trees."""
    queries = pairs.join(F.broadcast(spread.select("size", "route", "trees")), ["size", "route"]).select("size", "route", "block", "id", "v", "least", F.explode(F.expr("sequence(0, trees - 1)")).alias("tree"))
    by = ["size", "route", "tree", "block"]
    used = queries.select(*by).distinct()
    trees = pages.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).join(used, by, "left_semi")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("page")
            size, top = int(left["size"].iloc[0]), float(left["top"].iloc[0])
            tree = [
                Page(leaf, np.frombuffer(o, "<f8").reshape(-1, size), np.frombuffer(z, "<f8"), np.frombuffer(r, "<f8"), np.frombuffer(p, "<f8"), np.frombuffer(i, "<i8"), np.frombuffer(c, "<i8"))
                for leaf, o, z, r, p, i, c in zip(left["leaf"], left["objects"], left["last"], left["radii"], left["parents"], left["ids"], left["pages"])
            ]
            for q, v, least in zip(right["id"], right["v"], right["least"]):
                out += [(q, i, s) for s, i in search(tree, top, np.array(v, np.float64), q, k, None if pd.isna(least) else int(least))]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return trees.groupBy(*by).cogroup(queries.groupBy(*by)).applyInPandas(run, "query_id long, vec_id long, score long")
