"""Nearest-neighbour joins: cartesian in any number of dimensions, and on the sphere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridbrook.operators.grid import GridSpec, border_mask, pack_ids
from gridbrook.operators.tables import save

EARTH_RADIUS = 6371228.0
#: Source points that are broadcast (24 to 40 bytes each); more are joined by cells.
MOST_POINTS = 200_000


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in metres on the sphere; the cosine is kept at 1 or below."""
    a, b = F.radians(lat1), F.radians(lat2)
    return EARTH_RADIUS * F.acos(F.least(F.lit(1.0), F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon2 - lon1))))


class _Tree:
    """Points cut at medians into cells of up to 64; a search takes cells in order of their boxes' distance."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        todo, cells = [np.arange(len(ids))], []
        while todo:
            rows = todo.pop()
            if len(rows) <= 64:
                cells.append(rows)
                continue
            axis = int(np.ptp(points[rows], axis=0).argmax())
            cut = np.argsort(points[rows, axis], kind="stable")
            todo += [rows[cut[: len(rows) // 2]], rows[cut[len(rows) // 2 :]]]
        self.cells = [(ids[c], points[c]) for c in cells if len(c)]
        self.low = np.array([p.min(axis=0) for _, p in self.cells])
        self.high = np.array([p.max(axis=0) for _, p in self.cells])

    def nearest(self, q: np.ndarray) -> tuple[int, float]:
        gap = np.maximum(0, np.maximum(self.low - q, q - self.high))
        box = (gap * gap).sum(axis=1)
        best = (np.inf, 0)
        for c in np.argsort(box, kind="stable"):
            if box[c] > best[0]:
                break
            ids, points = self.cells[c]
            d = ((points - q) ** 2).sum(axis=1)
            low = d.min()
            if low <= best[0]:
                best = min(best, (float(low), int(ids[d == low].min())))
        return best[1], best[0]


def nearest(targets: DataFrame, sources: DataFrame, coords: list[str], lonlat: bool = False, target_id: str = "target_id", source_id: str = "source_id", most: int = MOST_POINTS) -> DataFrame:
    """(target_id, source_id, d2) of the closest source of each target, ties to the smaller id.

    d2 is the squared distance (of unit vectors for lon, lat).  Up to ``most`` sources, which are counted first, are
    broadcast as a search tree and targets stay where they are; more are joined by cells.  Sources without a place
    take no part; targets without one, and all where there is no source, have a null source.
    """
    spark = targets.sparkSession
    own = [F.col(c).cast("double") for c in coords]
    xyz = _unit_columns(*own) if lonlat else own
    axes = [f"__x{k}" for k in range(len(xyz))]
    place = lambda df, i: df.select(F.col(i).cast("long").alias(i), *(v.alias(c) for c, v in zip(axes, xyz)))
    finite = " and ".join(f"{c} is not null and not isnan({c})" for c in axes)
    known, asked = place(sources, source_id).where(f"{finite} and {source_id} is not null"), place(targets, target_id)
    if known.limit(most + 1).count() <= most:
        part = known.toPandas()
        sent = spark.sparkContext.broadcast(_Tree(part[source_id].to_numpy(), part[axes].to_numpy(float)) if len(part) else None)

        def run(batches):
            tree = sent.value
            for batch in batches:
                q = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(axes))]) if batch.num_rows else np.empty((0, len(axes)))
                hits = [tree.nearest(x) if tree is not None and not np.isnan(x).any() else (None, None) for x in q.astype(float)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.float64())], [target_id, source_id, "d2"])

        return asked.mapInArrow(run, f"{target_id} long, {source_id} long, d2 double")
    found = _by_cells(asked.where(finite), known, axes, target_id, source_id)
    lost = asked.where(f"not coalesce({finite}, false)").select(target_id, F.lit(None).cast("long").alias(source_id), F.lit(None).cast("double").alias("d2"))
    return found.unionByName(lost)


def _unit_columns(lon: Column, lat: Column) -> list[Column]:
    a, b = F.radians(lon), F.radians(lat)
    return [F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)]


def _by_cells(asked: DataFrame, known: DataFrame, axes: list[str], target_id: str, source_id: str) -> DataFrame:
    """Nearest sources by rounds of joins on ever larger cells, for targets that no smaller cells have settled.

    A target looks from the point of the sources' box that is nearest to it, which is D away, into its cell of width h
    there and those around.  What lies outside is at least sqrt(D^2 + h^2) away, so a source within that is the
    nearest.  Cells start so small that few sources share one; equal places are one source.
    """
    points = save(known.groupBy(*axes).agg(F.min(source_id).alias(source_id)), "points")
    ends = points.agg(*(f(c) for c in axes for f in (F.min, F.max)), F.count(F.lit(1))).first()
    low, high = [ends[2 * k] for k in range(len(axes))], [ends[2 * k + 1] for k in range(len(axes))]
    extent = max(b - a for a, b in zip(low, high)) or 1.0
    cell = lambda c, lo, h: F.floor((F.col(c) - lo) / h).cast("long")
    width = extent / max(1.0, (ends[-1] / 4) ** (1 / len(axes)))
    for _ in range(20):
        used = points.groupBy(*(cell(c, lo, width).alias(f"c{k}") for k, (c, lo) in enumerate(zip(axes, low)))).count().agg(F.avg("count"), F.percentile_approx("count", 0.999)).first()
        if used[1] > 256:
            width /= 2
        elif used[0] < 1.5 and width < extent:
            width *= 2
        else:
            break
    names = [f"c{k}" for k in range(len(axes))]
    # the nearest point of the box, and the squared distance to it
    inner = [F.least(F.greatest(F.col(c), F.lit(a)), F.lit(b)) for c, a, b in zip(axes, low, high)]
    left = asked.select(target_id, *axes, *(v.alias(f"p{k}") for k, v in enumerate(inner))).withColumn("D2", sum((F.pow(F.col(c) - F.col(f"p{k}"), 2) for k, c in enumerate(axes)), F.lit(0.0)))
    left, out = save(left, "asked"), None
    while True:
        step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        near = left.select(target_id, *axes, "D2", *(cell(f"p{k}", lo, width).alias(n) for k, (n, lo) in enumerate(zip(names, low))))
        for n in names:
            near = near.select("*", step.alias("__s")).withColumn(n, F.col(n) + F.col("__s")).drop("__s")
        held = points.select(source_id, *(F.col(c).alias(f"s{k}") for k, c in enumerate(axes)), *(cell(c, lo, width).alias(n) for n, c, lo in zip(names, axes, low)))
        d2 = sum((F.pow(F.col(c) - F.col(f"s{k}"), 2) for k, c in enumerate(axes)), F.lit(0.0))
        best = near.join(held, names).groupBy(target_id, "D2").agg(F.min(F.struct(d2.alias("d2"), F.col(source_id))).alias("b"))
        last = width > extent  # every source is in reach
        sure = best.where(F.lit(last) | (F.col("b.d2") <= F.col("D2") + width * width * (1 - 1e-9))).select(target_id, f"b.{source_id}", "b.d2")
        sure = save(sure, "nearest")
        out = sure if out is None else out.unionByName(sure)
        if last:
            return out
        rest = save(left.join(sure.select(target_id), target_id, "left_anti"), "asked")
        if rest.isEmpty():
            return out
        left, width = rest, width * 3


def fill_ids(cells: DataFrame, target: DataFrame, spec: GridSpec, target_spec: GridSpec | None = None, index_distance: bool = False) -> DataFrame:
    """(i, j, source_id): packed id of the same cell of ``cells``, else of their nearest border cell, for each cell of ``target``.

    Both grids have the same cells, perhaps with rows in the other direction (i, j are those of the target).  Distance
    is between centres, on the sphere for spherical grids; with ``index_distance`` between places, across the seam of
    periodic grids.  Ties go to the smaller id.
    """
    other = target_spec or spec
    if not spec.matches(other, direction=False):
        raise ValueError("the grids have different cells")
    turned = spec.top_down != other.top_down
    row = (spec.ny + 1 - F.col("j")).cast("int") if turned else F.col("j")
    asked = target.select("i", "j", row.alias("sj"), other.cell_id().alias("target_id"))
    ids = pack_ids(cells.select("i", "j")).select("i", F.col("j").alias("sj"), F.col("packed_id").alias("source_id"))
    same = asked.join(ids, ["i", "sj"])
    empty = asked.join(ids, ["i", "sj"], "left_anti")
    border = border_mask(cells, spec).select("i", F.col("j").alias("sj")).join(ids, ["i", "sj"])
    if index_distance:
        if spec.periodic:  # the border is seen again on both sides of the seam
            border = border.select((F.col("i") + F.explode(F.array(*(F.lit(k * spec.nx) for k in (-1, 0, 1))))).alias("i"), "sj", "source_id")
        found = nearest(empty, border, ["i", "sj"])
    else:
        centre = lambda df: df.withColumn("x", spec.x("i")).withColumn("y", spec.y("sj"))
        found = nearest(centre(empty), centre(border), ["x", "y"], lonlat=spec.spherical)
    drawn = empty.join(found.select("target_id", "source_id"), "target_id")
    return same.select("i", "j", "source_id").unionByName(drawn.select("i", "j", "source_id"))


def regrid(source: DataFrame, source_spec: GridSpec, target: DataFrame, target_spec: GridSpec, value: str = "value", derive_mask: bool = False) -> DataFrame:
    """(i, j, value) on the cells of ``target``, each from the source cell with the nearest centre, ties to the smaller id.

    With ``derive_mask`` only targets whose centre lies in an active source cell stay, an equi-join on the cell.
    """
    x, y = target_spec.x(), target_spec.y()
    if derive_mask:
        si, sj = source_spec.cell_at(x, y)
        rows = target.select("i", "j", x.alias("x"), y.alias("y"), si.alias("si"), sj.alias("sj"))
        held = rows.join(source.select(F.col("i").alias("si"), F.col("j").alias("sj"), value), ["si", "sj"])
        return held.where(source_spec.contains(F.col("x"), F.col("y"), "si", "sj")).select("i", "j", value)
    asked = target.select("i", "j", target_spec.cell_id().alias("target_id"), x.alias("x"), y.alias("y"))
    known = source.select(source_spec.cell_id().alias("source_id"), source_spec.x().alias("x"), source_spec.y().alias("y"), value)
    found = nearest(asked, known, ["x", "y"], lonlat=source_spec.spherical)
    return asked.join(found, "target_id").join(known.select("source_id", value), "source_id").select("i", "j", value)


def grid_to_points(source: DataFrame, spec: GridSpec, points: DataFrame, value: str = "value") -> DataFrame:
    """(point_id, value): each point's nearest cell."""
    known = source.select(spec.cell_id().alias("source_id"), spec.x().alias("x"), spec.y().alias("y"), value)
    found = nearest(points.withColumnRenamed("point_id", "target_id"), known, ["x", "y"], lonlat=spec.spherical)
    return found.join(known.select("source_id", value), "source_id").select(F.col("target_id").alias("point_id"), value)


def points_to_grid(points: DataFrame, cells: DataFrame, spec: GridSpec, value: str = "value") -> DataFrame:
    """(i, j, value): each cell's nearest point."""
    asked = cells.select("i", "j", spec.cell_id().alias("target_id"), spec.x().alias("x"), spec.y().alias("y"))
    found = nearest(asked, points.withColumnRenamed("point_id", "source_id"), ["x", "y"], lonlat=spec.spherical)
    values = points.select(F.col("point_id").alias("source_id"), value)
    return asked.join(found, "target_id").join(values, "source_id").select("i", "j", value)


def fill_missing(cells: DataFrame, filled: DataFrame, value: str = "value") -> DataFrame:
    """(i, j, value) of all ``cells``: own values, else those of the nearest filled cell by index distance."""
    key = lambda c: (F.col("j").cast("long") * (1 << 31) + F.col("i")).alias(c)
    empty = cells.select("i", "j").join(filled, ["i", "j"], "left_anti").select(key("target_id"), "i", "j")
    found = nearest(empty, filled.select(key("source_id"), "i", "j"), ["i", "j"])
    values = filled.select(key("source_id"), value)
    drawn = found.join(values, "source_id").select((F.col("target_id") % (1 << 31)).cast("int").alias("i"), F.floor(F.col("target_id") / (1 << 31)).cast("int").alias("j"), value)
    return filled.select("i", "j", value).unionByName(drawn)
