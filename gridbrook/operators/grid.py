"""Masked uniform grids: cells, masks and scaling between resolutions.

A grid is a ``GridSpec`` and a DataFrame of its active cells with 1-based integer columns ``i`` and ``j``.
Scaling joins nothing: the coarse cell of a fine one is integer arithmetic, so up-scaling is one shuffle by the
coarse key with partial aggregation, and down-scaling is an equi-join on it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EARTH_RADIUS = 6371228.0
TOLERANCE = 1e-7


@dataclass(frozen=True)
class GridSpec:
    nx: int
    ny: int
    xll: float = 0.0
    yll: float = 0.0
    cellsize: float = 1.0
    spherical: bool = False
    top_down: bool = False

    @property
    def extent(self) -> tuple[float, float, float, float]:
        return self.xll, self.yll, self.xll + self.nx * self.cellsize, self.yll + self.ny * self.cellsize

    @property
    def periodic(self) -> bool:
        return self.spherical and math.isclose(self.nx * self.cellsize, 360.0, rel_tol=1e-5)

    def x(self, i: Column | str = "i") -> Column:
        return self.xll + (F.col(i) if isinstance(i, str) else i) * self.cellsize - 0.5 * self.cellsize

    def y(self, j: Column | str = "j") -> Column:
        j = F.col(j) if isinstance(j, str) else j
        j = (self.ny + 1) - j if self.top_down else j
        return self.yll + j * self.cellsize - 0.5 * self.cellsize

    def area(self, j: Column | str = "j") -> Column:
        """Cell area: the squared size, or on the sphere the band between the cell's parallels."""
        if not self.spherical:
            return F.lit(self.cellsize**2)
        step = math.radians(self.cellsize)
        return F.lit(EARTH_RADIUS**2 * step * 2 * math.sin(step / 2)) * F.cos(F.radians(self.y(j)))

    def axes(self) -> dict[str, list[float]]:
        """Centres and vertices along x and y, in the order of i and j."""
        x = [self.xll + (i + 0.5) * self.cellsize for i in range(self.nx)]
        y = [self.yll + (j + 0.5) * self.cellsize for j in range(self.ny)]
        xv = [self.xll + i * self.cellsize for i in range(self.nx + 1)]
        yv = [self.yll + j * self.cellsize for j in range(self.ny + 1)]
        return {"x": x, "y": y[::-1] if self.top_down else y, "x_vertices": xv, "y_vertices": yv[::-1] if self.top_down else yv}

    def bounds(self, i: Column | str = "i", j: Column | str = "j") -> Column:
        """struct(west, east, south, north) of a cell."""
        half = 0.5 * self.cellsize
        return F.struct((self.x(i) - half).alias("west"), (self.x(i) + half).alias("east"), (self.y(j) - half).alias("south"), (self.y(j) + half).alias("north"))

    def matches(self, other: GridSpec, tolerance: float = TOLERANCE, direction: bool = True) -> bool:
        """Whether both grids have the same cells (and, with ``direction``, the same order of rows)."""
        near = all(math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance) for a, b in ((self.xll, other.xll), (self.yll, other.yll), (self.cellsize, other.cellsize)))
        return near and (self.nx, self.ny, self.spherical) == (other.nx, other.ny, other.spherical) and (not direction or self.top_down == other.top_down)

    def normalized_longitude(self, x: Column) -> Column:
        """The longitude turned by full circles to within 180 degrees of the grid's centre."""
        centre = self.xll + 0.5 * self.nx * self.cellsize
        return F.pmod(x - centre + 180.0, F.lit(360.0)) - 180.0 + centre

    def mapped_longitude(self, x: Column) -> Column:
        """As ``normalized_longitude``; on periodic grids whole circles east of the western edge are put on the eastern edge."""
        out = self.normalized_longitude(x)
        if not self.periodic:
            return out
        delta = x - self.xll
        turns = F.round(delta / 360.0)
        on_edge = (x > self.xll) & (turns >= 1) & (F.abs(delta - turns * 360.0) <= F.greatest(1e-5 * F.greatest(F.abs(delta), turns * 360.0), F.lit(1e-8)))
        return F.when(on_edge, F.lit(self.xll + self.nx * self.cellsize)).otherwise(out)

    def contains(self, x: Column, y: Column, i: Column | str = "i", j: Column | str = "j") -> Column:
        """Whether a point lies in a cell or on its edge."""
        x = self.mapped_longitude(x) if self.spherical else x
        b = self.bounds(i, j)
        return _within(x, b["west"], b["east"]) & _within(y, b["south"], b["north"])

    def cell_at(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(i, j) of the cell at a point, clamped to the grid."""
        x = self.mapped_longitude(x) if self.spherical else x
        i = F.ceil((x - self.xll) / self.cellsize)
        rows = (y - self.yll) / self.cellsize
        j = self.ny - F.floor(rows) if self.top_down else F.ceil(rows)
        return F.least(F.greatest(i, F.lit(1)), F.lit(self.nx)).cast("int"), F.least(F.greatest(j, F.lit(1)), F.lit(self.ny)).cast("int")

    def cell_id(self) -> Column:
        """Place of (i, j) in the full grid, columns of j one after another."""
        return ((F.col("j") - 1) * self.nx + F.col("i")).cast("long")

    def factor_to(self, cellsize: float) -> int:
        """How many of the finer cells make a side of the coarser one; raises unless whole."""
        ratio = max(cellsize, self.cellsize) / min(cellsize, self.cellsize)
        if abs(ratio - round(ratio)) > TOLERANCE * ratio:
            raise ValueError(f"cell sizes {self.cellsize} and {cellsize} have no whole ratio")
        return round(ratio)

    def coarse(self, factor: int) -> GridSpec:
        nx, ny = -(-self.nx // factor), -(-self.ny // factor)
        return replace(self, nx=nx, ny=ny, cellsize=self.cellsize * factor)

    def fine(self, factor: int) -> GridSpec:
        return replace(self, nx=self.nx * factor, ny=self.ny * factor, cellsize=self.cellsize / factor)

    def coarse_key(self, factor: int) -> tuple[Column, Column]:
        """(ci, cj) of the coarse cell over a fine cell; rows are counted from the bottom in either direction."""
        ci = F.floor((F.col("i") - 1) / factor) + 1
        rows = (self.ny + 1) - F.col("j") if self.top_down else F.col("j")
        cj = F.floor((rows - 1) / factor) + 1
        return ci.cast("int"), (self.coarse(factor).ny + 1 - cj if self.top_down else cj).cast("int")


def _near(a: Column, b) -> Column:
    return F.abs(a - b) <= F.greatest(1e-5 * F.greatest(F.abs(a), F.abs(b) if isinstance(b, Column) else F.lit(abs(b))), F.lit(1e-8))


def _within(v: Column, low: Column, high: Column) -> Column:
    """In the closed interval, its ends with tolerance."""
    return ((v > low) | _near(v, low)) & ((v < high) | _near(v, high))


def orientation(a: Column, b: Column, p: Column) -> Column:
    """Twice the signed area of three points, structs of x and y."""
    return (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)


def in_triangle(p: Column, a: Column, b: Column, c: Column) -> Column:
    """Whether the point is in the triangle or on its edge, whichever way that turns."""
    turns = [orientation(a, b, p), orientation(b, c, p), orientation(c, a, p)]
    zero = [F.abs(t) <= 1e-8 for t in turns]
    left, right = [(t > 0) | z for t, z in zip(turns, zero)], [(t < 0) | z for t, z in zip(turns, zero)]
    return (left[0] & left[1] & left[2]) | (right[0] & right[1] & right[2])


def in_quad(p: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the point is in the quadrilateral with corners in this order, or on its edge."""
    return in_triangle(p, a, b, c) | in_triangle(p, a, c, d)


def crossing(p1: Column, p2: Column, q1: Column, q2: Column) -> Column:
    """struct(x, y) where two infinite lines cross; null where they are parallel."""
    d = F.nullif((p1.x - p2.x) * (q1.y - q2.y) - (p1.y - p2.y) * (q1.x - q2.x), F.lit(0.0))
    p, q = p1.x * p2.y - p1.y * p2.x, q1.x * q2.y - q1.y * q2.x
    return F.struct(((p * (q1.x - q2.x) - q * (p1.x - p2.x)) / d).alias("x"), ((p * (q1.y - q2.y) - q * (p1.y - p2.y)) / d).alias("y"))


def has_mask(cells: DataFrame, spec: GridSpec) -> bool:
    """Whether some cell of the grid is not active."""
    return cells.select("i", "j").distinct().count() < spec.nx * spec.ny


def any_missing(cells: DataFrame, value: str = "value") -> bool:
    """Whether some active cell has no value."""
    return not cells.where(F.col(value).isNull() | F.isnan(F.col(value).cast("double"))).isEmpty()


def same_mask(a: DataFrame, b: DataFrame) -> bool:
    """Whether both grids have the same active cells."""
    keys = ["i", "j"]
    return a.join(b, keys, "left_anti").isEmpty() and b.join(a, keys, "left_anti").isEmpty()


def _checked(problem: DataFrame, what: str) -> None:
    if not problem.isEmpty():
        raise ValueError(what)


def _covers(fine_spec: GridSpec, coarse_spec: GridSpec) -> int:
    factor = fine_spec.factor_to(coarse_spec.cellsize)
    if not fine_spec.coarse(factor).matches(coarse_spec, direction=False):
        raise ValueError("the coarse grid does not cover the fine one")
    return factor


def check_covered(fine: DataFrame, fine_spec: GridSpec, coarse: DataFrame, coarse_spec: GridSpec) -> None:
    """Raise unless every active fine cell lies in an active coarse cell."""
    _checked(uncovered(fine, fine_spec, _covers(fine_spec, coarse_spec), coarse), "active fine cells lie in inactive coarse ones")


def check_filled(fine: DataFrame, fine_spec: GridSpec, coarse: DataFrame, coarse_spec: GridSpec) -> None:
    """Raise unless every active coarse cell holds an active fine cell."""
    _checked(unfilled(fine, fine_spec, _covers(fine_spec, coarse_spec), coarse), "active coarse cells hold no active fine one")


def flip(cells: DataFrame, spec: GridSpec, axis: str = "j") -> tuple[DataFrame, GridSpec]:
    """Cells renumbered from the other end of an axis; a flip of j turns the direction of the rows, so centres stay."""
    size = spec.ny if axis == "j" else spec.nx
    return cells.withColumn(axis, (size + 1 - F.col(axis)).cast("int")), (replace(spec, top_down=not spec.top_down) if axis == "j" else spec)


def swap(df: DataFrame, key: str, a, b) -> DataFrame:
    """The rows at the places ``a`` and ``b`` of ``key`` change places."""
    return df.withColumn(key, F.when(F.col(key) == a, F.lit(b)).when(F.col(key) == b, F.lit(a)).otherwise(F.col(key)))


def crop(cells: DataFrame, spec: GridSpec, west: float, east: float, south: float, north: float) -> tuple[DataFrame, GridSpec]:
    """The grid of the cells with centres in the closed box: cells renumbered from 1, and their own spec."""
    inside_x = [i for i, x in enumerate(spec.axes()["x"], 1) if west <= x <= east]
    inside_y = [j for j, y in enumerate(spec.axes()["y"], 1) if south <= y <= north]
    if not inside_x or not inside_y:
        raise ValueError("no cell has its centre in the box")
    i0, j0 = inside_x[0], inside_y[0]
    low = spec.ny - inside_y[-1] if spec.top_down else j0 - 1
    part = replace(spec, nx=len(inside_x), ny=len(inside_y), xll=spec.xll + (i0 - 1) * spec.cellsize, yll=spec.yll + low * spec.cellsize)
    rows = cells.where(F.col("i").between(i0, inside_x[-1]) & F.col("j").between(j0, inside_y[-1]))
    return rows.withColumn("i", (F.col("i") - (i0 - 1)).cast("int")).withColumn("j", (F.col("j") - (j0 - 1)).cast("int")), part


def crop_points(points: DataFrame, west: float, east: float, south: float, north: float, x: str = "x", y: str = "y") -> DataFrame:
    """Points in the closed box."""
    return points.where(F.col(x).between(west, east) & F.col(y).between(south, north))


def points_in_polygon(points: DataFrame, polygon: list[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """Points in the polygon or on its edge; its box is filtered first."""
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    return crop_points(points, min(xs), max(xs), min(ys), max(ys), x, y).where(inside(F.col(x), F.col(y), polygon) >= 0)


def cells_at(points: DataFrame, cells: DataFrame, spec: GridSpec, x: str = "x", y: str = "y") -> DataFrame:
    """``points`` with packed_id of the active cell at each, null where that cell is not active: an equi-join on (i, j)."""
    i, j = spec.cell_at(F.col(x), F.col(y))
    return points.withColumn("__i", i).withColumn("__j", j).join(pack_ids(cells).select(F.col("i").alias("__i"), F.col("j").alias("__j"), "packed_id"), ["__i", "__j"], "left").drop("__i", "__j")


def total_area(cells: DataFrame, spec: GridSpec) -> DataFrame:
    """(area): of all active cells."""
    return cells.agg(F.sum(spec.area()).alias("area"))


def derive_coarse(cells: DataFrame, spec: GridSpec, factor: int, area: str = "sum") -> tuple[DataFrame, GridSpec]:
    """(i, j, cell_area, n): coarse cells with an active fine one; areas are summed over those, whole cells', or counts."""
    ci, cj = spec.coarse_key(factor)
    coarse = spec.coarse(factor)
    out = cells.groupBy(ci.alias("i"), cj.alias("j")).agg(F.sum(spec.area()).alias("cell_area"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("cell_area", {"sum": F.col("cell_area"), "full": coarse.area(), "count": F.col("n").cast("double")}[area]), coarse


def derive_fine(cells: DataFrame, spec: GridSpec, factor: int) -> tuple[DataFrame, GridSpec]:
    """(i, j) of the fine cells of all active cells, and their spec."""
    k = F.explode(F.sequence(F.lit(1), F.lit(factor)))
    rows = cells.select("i", "j", k.alias("a")).select("i", "j", "a", k.alias("b"))
    return rows.select(((F.col("i") - 1) * factor + F.col("a")).cast("int").alias("i"), ((F.col("j") - 1) * factor + F.col("b")).cast("int").alias("j")), spec.fine(factor)


def upscale_coords(fine: DataFrame, spec: GridSpec, factor: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(ci, cj, lon, lat): means over the fine cells of each coarse one."""
    ci, cj = spec.coarse_key(factor)
    return fine.groupBy(ci.alias("ci"), cj.alias("cj")).agg(F.avg(lon).alias("lon"), F.avg(lat).alias("lat"))


def corner_coords(cells: DataFrame, spec: GridSpec, names: tuple[str, ...] = ("lon", "lat")) -> DataFrame:
    """(a, b, lon, lat) of the cells' corners, a and b from 1 to nx + 1 and ny + 1, for a full grid of at least 2 x 2 cells.

    Inner corners are means of the four centres around them.  An outer one lies as far beyond the mean of the two
    centres next to it as the inner one lies before it; the four outermost take lat from their neighbour along x and
    lon from that along y.
    """
    step = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (0, 1) for q in (0, 1))))
    around = cells.select("i", "j", *names, step.alias("s")).select((F.col("i") + F.col("s.p")).alias("a"), (F.col("j") + F.col("s.q")).alias("b"), *names)
    means = around.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in names), F.count(F.lit(1)).alias("n"))
    inner = means.where("n = 4").select("a", "b", *((F.col(c) / 4).alias(c) for c in names))
    # a side: the sum of its two centres minus the inner corner next to it
    beside_a = F.when(F.col("a") == 1, 2).when(F.col("a") == spec.nx + 1, spec.nx).otherwise(F.col("a"))
    beside_b = F.when(F.col("b") == 1, 2).when(F.col("b") == spec.ny + 1, spec.ny).otherwise(F.col("b"))
    near = inner.select(F.col("a").alias("na"), F.col("b").alias("nb"), *(F.col(c).alias(f"n_{c}") for c in names))
    sides = means.where("n = 2").withColumn("na", beside_a.cast("int")).withColumn("nb", beside_b.cast("int")).join(near, ["na", "nb"])
    sides = sides.select("a", "b", *((F.col(c) - F.col(f"n_{c}")).alias(c) for c in names))
    corners = means.where("n = 1").select("a", "b", beside_a.cast("int").alias("na"), beside_b.cast("int").alias("nb"))
    take = lambda c, other: sides.select(F.col("a").alias("ta"), F.col("b").alias("tb"), F.col(c).alias(other))
    found = corners.join(take(names[1], "v"), (F.col("ta") == F.col("na")) & (F.col("tb") == F.col("b"))).drop("ta", "tb")
    found = found.join(take(names[0], "u"), (F.col("ta") == F.col("a")) & (F.col("tb") == F.col("nb"))).select("a", "b", F.col("u").alias(names[0]), F.col("v").alias(names[1]))
    return inner.unionByName(sides).unionByName(found)


def downscale_coords(cells: DataFrame, spec: GridSpec, factor: int, names: tuple[str, str] = ("lon", "lat")) -> DataFrame:
    """(i, j, lon, lat) of the fine cells: lines between opposite sides of a coarse cell, each cut in equal parts, cross there."""
    corners = corner_coords(cells, spec, names)
    pick = lambda p, q, k: corners.select((F.col("a") - p).alias("ci"), (F.col("b") - q).alias("cj"), F.struct(F.col(names[0]).alias("x"), F.col(names[1]).alias("y")).alias(k))
    box = cells.select(F.col("i").alias("ci"), F.col("j").alias("cj"))
    for p, q, k in ((0, 0, "c00"), (1, 0, "c10"), (0, 1, "c01"), (1, 1, "c11")):
        box = box.join(pick(p, q, k), ["ci", "cj"])
    part = F.explode(F.sequence(F.lit(1), F.lit(factor)))
    box = box.select("*", part.alias("p")).select("*", part.alias("q"))
    on = lambda a, b, t: F.struct((a.x + (b.x - a.x) * (t - 0.5) / factor).alias("x"), (a.y + (b.y - a.y) * (t - 0.5) / factor).alias("y"))
    c = {k: F.col(k) for k in ("c00", "c10", "c01", "c11")}
    at = crossing(on(c["c00"], c["c10"], F.col("p")), on(c["c01"], c["c11"], F.col("p")), on(c["c00"], c["c01"], F.col("q")), on(c["c10"], c["c11"], F.col("q")))
    out = box.select(((F.col("ci") - 1) * factor + F.col("p")).cast("int").alias("i"), ((F.col("cj") - 1) * factor + F.col("q")).cast("int").alias("j"), at.alias("at"))
    return out.select("i", "j", F.col("at.x").alias(names[0]), F.col("at.y").alias(names[1]))


def full_index(spark, spec: GridSpec) -> DataFrame:
    """Every (i, j) of the grid, made in parallel."""
    return spark.range(spec.nx * spec.ny).select((F.col("id") % spec.nx + 1).cast("int").alias("i"), (F.floor(F.col("id") / spec.nx) + 1).cast("int").alias("j"))


def pack_ids(cells: DataFrame) -> DataFrame:
    """``cells`` with packed_id, 1.. over active cells ordered by (j, i): counts a row of j, then places within it."""
    before = Window.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.groupBy("j").count().select("j", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("j").orderBy("i"))
    return cells.withColumn("packed_id", within).join(starts, "j").withColumn("packed_id", (F.col("packed_id") + F.col("start")).cast("long")).drop("start")


def unpack(cells: DataFrame, spec: GridSpec, value: str = "value", missing=None) -> DataFrame:
    """(i, j, value) over the full grid, ``missing`` where the cell is not active."""
    out = full_index(cells.sparkSession, spec).join(cells.select("i", "j", value), ["i", "j"], "left")
    return out if missing is None else out.withColumn(value, F.coalesce(value, F.lit(missing)))


def upscale(cells: DataFrame, spec: GridSpec, factor: int, op: str = "a_mean", value: str = "value", weight: str = "area", p: float = 1.0, class_id: int | None = None, back: bool = False) -> DataFrame:
    """(ci, cj, value) of each coarse cell with an active fine cell.

    op: a_mean, g_mean, h_mean, p_mean, min, max, sum, var, std, median, laf (most frequent class, ties to the
    smaller), fraction (of ``class_id``), maxloc, minloc (fine cell id, ties to the first, or with ``back`` to the last).
    Weights are shares of area or of count over active cells; whole numbers are averaged as floating ones.  With factor
    1 nothing is shuffled.  ``with_empty`` adds coarse cells without active ones.
    """
    if factor == 1:
        same = {"var": F.lit(0.0), "std": F.lit(0.0), "fraction": (F.col(value) == class_id).cast("double"), "maxloc": spec.cell_id(), "minloc": spec.cell_id()}
        return cells.where(F.col(value).isNotNull()).select(F.col("i").alias("ci"), F.col("j").alias("cj"), same.get(op, F.col(value)).alias("value"))
    ci, cj = spec.coarse_key(factor)
    x = F.col(value)
    rows = cells.where(x.isNotNull()).select(ci.alias("ci"), cj.alias("cj"), "i", "j", x.alias("x"), (spec.area() if weight == "area" else F.lit(1.0)).alias("w"))
    x, w, by = F.col("x"), F.col("w"), ["ci", "cj"]
    if op == "p_mean":
        op = {0.0: "g_mean", 1.0: "a_mean", -1.0: "h_mean", math.inf: "max", -math.inf: "min"}.get(p, op)
        if math.isnan(p):
            raise ValueError("p is not a number")
    total = F.sum("w")
    if op in ("var", "std"):
        mean = F.sum(w * x).over(Window.partitionBy(*by)) / F.sum("w").over(Window.partitionBy(*by))
        agg = F.sum(w * F.pow(x - F.col("m"), 2)) / total
        return rows.withColumn("m", mean).groupBy(*by).agg((agg if op == "var" else F.sqrt(agg)).alias("value"))
    if op == "laf":
        counts = rows.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "x")).alias("b")).select(*by, F.col("b.x").alias("value"))
    fine_id = spec.cell_id()
    aggs = {
        "a_mean": lambda: F.sum(w * x) / total,
        "p_mean": lambda: F.pow(F.sum(w * F.pow(x, F.lit(p))) / total, F.lit(1 / p)),
        "g_mean": lambda: F.when(F.max((x == 0).cast("int")) == 1, F.lit(0.0)).otherwise(F.exp(F.sum(w * F.ln(F.when(x > 0, x))) / total)),
        "h_mean": lambda: F.when(F.max((x == 0).cast("int")) == 1, F.lit(0.0)).otherwise(total / F.sum(w / F.when(x != 0, x))),
        "min": lambda: F.min(x), "max": lambda: F.max(x), "sum": lambda: F.sum(x), "median": lambda: F.percentile(x, F.lit(0.5)),
        "fraction": lambda: F.sum(F.when(x == class_id, w).otherwise(0.0)) / total,
        "maxloc": lambda: F.max(F.struct(x, (fine_id if back else -fine_id).alias("k"))).getField("k") * (1 if back else -1),
        "minloc": lambda: F.min(F.struct(x, (-fine_id if back else fine_id).alias("k"))).getField("k") * (-1 if back else 1),
    }
    return rows.groupBy(*by).agg(aggs[op]().alias("value"))


def cell_fraction(cells: DataFrame, spec: GridSpec, factor: int, i: int, j: int, class_id: int, value: str = "value", weight: str = "area") -> DataFrame:
    """(value): share of a class in one coarse cell; the cell's rows are filtered before anything is grouped."""
    ci, cj = spec.coarse_key(factor)
    return upscale(cells.where((ci == i) & (cj == j)), spec, factor, "fraction", value, weight, class_id=class_id).select("value")


def with_empty(coarse: DataFrame, active: DataFrame, empty=0.0) -> DataFrame:
    """Values on all active coarse cells (ci, cj): ``empty`` (0, or None for null) where no fine cell was active."""
    out = active.select("ci", "cj").join(coarse, ["ci", "cj"], "left")
    return out if empty is None else out.withColumn("value", F.coalesce("value", F.lit(empty)))


def downscale(fine: DataFrame, spec: GridSpec, factor: int, coarse: DataFrame, op: str = "nearest") -> DataFrame:
    """(i, j, value) on active fine cells: the coarse cell's value, or its equal share over active fine cells."""
    ci, cj = spec.coarse_key(factor)
    rows = fine.select("i", "j", ci.alias("ci"), cj.alias("cj"))
    if op == "split":
        n = rows.groupBy("ci", "cj").agg(F.count(F.lit(1)).alias("n"))
        coarse = coarse.join(n, ["ci", "cj"]).select("ci", "cj", (F.col("value") / F.col("n")).alias("value"))
    return rows.join(coarse.select("ci", "cj", "value"), ["ci", "cj"]).select("i", "j", "value")


def uncovered(fine: DataFrame, spec: GridSpec, factor: int, coarse: DataFrame) -> DataFrame:
    """Active fine cells whose coarse cell is not active."""
    ci, cj = spec.coarse_key(factor)
    return fine.select("i", "j", ci.alias("ci"), cj.alias("cj")).join(coarse, ["ci", "cj"], "left_anti").select("i", "j")


def unfilled(fine: DataFrame, spec: GridSpec, factor: int, coarse: DataFrame) -> DataFrame:
    """Active coarse cells without an active fine cell."""
    ci, cj = spec.coarse_key(factor)
    return coarse.select("ci", "cj").join(fine.select(ci.alias("ci"), cj.alias("cj")), ["ci", "cj"], "left_anti")


def border_mask(cells: DataFrame, spec: GridSpec) -> DataFrame:
    """Active cells with an inactive or outer one among their 8 neighbours; x wraps on periodic grids."""
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)))
    near = cells.select("i", "j", steps.alias("s")).select((F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"))
    if spec.periodic:
        near = near.withColumn("i", F.pmod(F.col("i") - 1, F.lit(spec.nx)) + 1)
    counts = near.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    return cells.select("i", "j").join(counts, ["i", "j"], "left").where(F.coalesce("n", F.lit(0)) < 8).select("i", "j")


def select_box(cells: DataFrame, spec: GridSpec, west: float, east: float, south: float, north: float) -> DataFrame:
    """Cells whose centre lies in the closed box."""
    return cells.where(spec.x().between(west, east) & spec.y().between(south, north))


def inside(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """1 in the polygon, 0 on its edge, -1 outside; crossings of a ray, built into the plan."""
    edge, crossings = F.lit(False), F.lit(0)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        on = (F.abs(cross) <= 1e-12) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by))
        edge = edge | on
        if ay != by:
            hit = ((y >= min(ay, by)) & (y < max(ay, by))) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            crossings = crossings + hit.cast("int")
    return F.when(edge, 0).when(crossings % 2 == 1, 1).otherwise(-1)


def polygon_mask(cells: DataFrame, spec: GridSpec, polygon: list[tuple[float, float]]) -> DataFrame:
    """Cells with their centre in the polygon or on its edge; its box is filtered first."""
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    return select_box(cells, spec, min(xs), max(xs), min(ys), max(ys)).where(inside(spec.x(), spec.y(), polygon) >= 0)


def connected_mask(cells: DataFrame, i: int, j: int) -> DataFrame:
    """Active cells that 8-neighbour steps reach from (i, j): the seed's component, found by runs of cells.

    Neighbouring cells of a row of j form a run, found by a window over the row; only runs and their contacts with runs
    of the next row go through the components, so the rounds don't grow with the cells on a path.
    """
    from gridbrook.operators.graph import components

    row = Window.partitionBy("j").orderBy("i")
    starts = cells.select("i", "j").distinct().withColumn("new", F.coalesce((F.col("i") - F.lag("i").over(row) > 1).cast("int"), F.lit(0)))
    runs = starts.withColumn("k", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0))).groupBy("j", "k").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    runs = runs.withColumn("id", F.col("j").cast("long") * (1 << 31) + F.col("a"))
    # runs of one row are dealt into stretches of the row, so contacts are an equi-join
    width = 256
    spans = lambda df, lo, hi: df.withColumn("s", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    low = spans(runs, F.col("a") - 1, F.col("b") + 1).select("j", "s", "a", "b", "id")
    high = spans(runs, F.col("a"), F.col("b")).select((F.col("j") - 1).alias("j"), "s", F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("id").alias("id2"))
    touch = low.join(high, ["j", "s"]).where("a2 <= b + 1 and b2 >= a - 1").select(F.col("id").alias("a"), F.col("id2").alias("b"))
    found = components(touch)
    own = runs.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    seed = own.where((F.col("j") == j) & (F.col("a") <= i) & (F.col("b") >= i)).select("component").limit(1)
    kept = own.join(F.broadcast(seed), "component", "left_semi")
    return kept.select(F.explode(F.sequence("a", "b")).alias("i"), "j")


def connected_mask_at(cells: DataFrame, spec: GridSpec, x: float, y: float) -> DataFrame:
    """Active cells connected with the active cell nearest to a point, ties to the smaller cell id."""
    d2 = F.pow(spec.x() - x, 2) + F.pow(spec.y() - y, 2)
    if spec.spherical:
        from gridbrook.operators.nearest import great_circle

        d2 = great_circle(spec.x(), spec.y(), F.lit(x), F.lit(y))
    seed = cells.select("i", "j", d2.alias("d2"), spec.cell_id().alias("id")).orderBy("d2", "id").first()
    return cells.limit(0).select("i", "j") if seed is None else connected_mask(cells, seed["i"], seed["j"])


def similarity(cells: DataFrame, kind: str = "pd", a: str = "a", b: str = "b", mask: str | None = None) -> DataFrame:
    """Agreement of two fields from their 8-neighbour patterns (which neighbours are larger).

    pd: share of neighbours whose pattern differs; nndv: the same from numbers of larger neighbours over 8.
    """
    rows = cells if mask is None else cells.where(mask)
    steps = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1) if p or q)))
    near = rows.select(F.col("i").alias("ci"), F.col("j").alias("cj"), F.col(a).alias("ca"), F.col(b).alias("cb"), steps.alias("s"))
    near = near.select("ci", "cj", "ca", "cb", (F.col("ci") + F.col("s.p")).alias("i"), (F.col("cj") + F.col("s.q")).alias("j"))
    pairs = near.join(rows.select("i", "j", a, b), ["i", "j"])
    ga, gb = (F.col(a) > F.col("ca")).cast("int"), (F.col(b) > F.col("cb")).cast("int")
    per = pairs.groupBy("ci", "cj").agg(F.count(F.lit(1)).alias("n"), F.sum(ga).alias("na"), F.sum(gb).alias("nb"), F.sum((ga != gb).cast("int")).alias("d"))
    one = F.col("d") / F.col("n") if kind == "pd" else F.abs(F.col("na") - F.col("nb")) / F.col("n")
    return per.agg(F.coalesce(1 - F.avg(one), F.lit(0.0)).alias("value"))
