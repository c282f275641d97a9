"""Scalar columns: tolerant comparison, strings, dates and calendars, polygons and polynomials."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    near = F.abs(a - b) <= F.greatest(rtol * F.greatest(F.abs(a), F.abs(b)), F.lit(atol))
    some = F.isnan(a) | F.isnan(b)
    return F.when(some, F.lit(equal_nan)).otherwise((a == b) | near)


def eq(a: Column, b: Column) -> Column:
    """Equal within the tolerance of ``is_close``."""
    return is_close(a, b)


def ne(a: Column, b: Column) -> Column:
    return ~is_close(a, b)


def ge(a: Column, b: Column) -> Column:
    return (a > b) | is_close(a, b)


def le(a: Column, b: Column) -> Column:
    return (a < b) | is_close(a, b)


def is_nan(x: Column) -> Column:
    return F.isnan(x)


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))


def is_normal(x: Column) -> Column:
    """Finite, and zero or not too small for full precision."""
    return is_finite(x) & ((x == 0) | (F.abs(x) >= F.lit(2.2250738585072014e-308)))


SPECIAL = {"nan": math.nan, "inf": math.inf, "-inf": -math.inf, "subnormal": 5e-324, "-subnormal": -5e-324, "0": 0.0, "-0": -0.0}


def special_value(name: str) -> Column:
    return F.lit(SPECIAL[name.lower()])


def optval(x: Column, default) -> Column:
    return F.coalesce(x, F.lit(default))


def to_null(x: Column, missing=-9999) -> Column:
    """Null for the missing value and for NaN."""
    return F.when(~F.isnan(x.cast("double")), F.nullif(x, F.lit(missing)))


def from_null(x: Column, missing=-9999) -> Column:
    return F.coalesce(x, F.lit(missing))


def linspace(low: float, high: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(low) + k * ((high - low) / max(1, n - 1)))


def arange(low: float, high: float, step: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(max(0, math.ceil((high - low) / step) - 1))), lambda k: F.lit(low) + k * step)


def locate(xs: Column, y: Column) -> Column:
    """Last place (from 1, clamped) of a sorted array whose value is at most ``y``."""
    return F.greatest(F.lit(1), F.size(F.filter(xs, lambda v: v <= y)))


# strings

def compress(s: Column) -> Column:
    return F.regexp_replace(s, "[ \t]", "")


def replace_word(s: Column, word: str, by: str) -> Column:
    """Whole words (letters, digits and underscores) replaced."""
    return F.regexp_replace(s, f"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])", by.replace("\\", "\\\\").replace("$", "\\$"))


def index_word(s: Column, word: str) -> Column:
    return F.regexp_instr(s, F.lit(f"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])"))


def divide_string(s: Column, delimiter: str) -> Column:
    return F.split(s, re.escape(delimiter))


def glob_match(s: Column, pattern: str) -> Column:
    """* for any run and ? for one character."""
    return s.rlike("(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")


def starts_with(s: Column, head: str, strip: bool = False) -> Column:
    return F.startswith(F.trim(s) if strip else s, F.lit(head))


def ends_with(s: Column, tail: str, strip: bool = False) -> Column:
    return F.endswith(F.trim(s) if strip else s, F.lit(tail))


def is_blank(s: Column) -> Column:
    return F.trim(s) == ""


def to_lower(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def to_upper(s: Column) -> Column:
    return F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def to_text(x: Column, digits: int | None = None) -> Column:
    """A number as text, with ``digits`` decimals where given; T and F for booleans."""
    return x.cast("string") if digits is None else F.format_string(f"%.{digits}f", x.cast("double"))


def truth_to_text(x: Column) -> Column:
    return F.when(x, "T").when(~x, "F")


def to_codes(s: Column) -> Column:
    """Character codes of a string."""
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))


def from_codes(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.char(c)), "")


def equal_strings(a: Column, b: Column) -> Column:
    """Equal but for blanks at the end."""
    return F.rtrim(a) == F.rtrim(b)


def no_null(s: Column) -> Column:
    """Whether the string holds no zero character."""
    return F.instr(s, "\0") == 0


# dates

def is_leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def days_in_month(d: Column) -> Column:
    return F.day(F.last_day(d))


def days_in_year(d: Column) -> Column:
    return F.when(is_leap_year(F.year(d)), 366).otherwise(365)


def week_day(d: Column) -> Column:
    """1 Monday to 7 Sunday."""
    return F.weekday(d) + 1


def ordinal(d: Column) -> Column:
    """Days with 0001-01-01 as 1, proleptic Gregorian."""
    return F.datediff(d, F.lit("0001-01-01").cast("date")) + 1


def is_new(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz") == ts


def previous_new(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def next_new(ts: Column, unit: str) -> Column:
    """Start of the unit after the one that holds ``ts``."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz") + F.expr(f"interval 1 {unit}")


def replace_parts(ts: Column, **parts) -> Column:
    """The timestamp with some of year, month, day, hour, minute, second replaced."""
    own = {"year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "second": F.second}
    return F.make_timestamp_ntz(*(F.lit(parts[k]) if k in parts else f(ts) for k, f in own.items()))


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in whole seconds; timestamps without zone."""
    return F.unix_timestamp(b.cast("timestamp")) - F.unix_timestamp(a.cast("timestamp"))


def delta(seconds: Column) -> Column:
    """A span as struct(days, seconds) with 0 <= seconds < 86400, whatever its sign."""
    return F.struct(F.floor(seconds / 86400).cast("int").alias("days"), F.pmod(seconds, F.lit(86400)).cast("int").alias("seconds"))


def delta_seconds(span: Column) -> Column:
    return span["days"].cast("long") * 86400 + span["seconds"]


def add_delta(ts: Column, span: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), delta_seconds(span).cast("decimal(18,6)"))


def scale_delta(span: Column, factor) -> Column:
    """The span times a number, rounded to seconds."""
    return delta(F.round(delta_seconds(span) * factor).cast("long"))


def divide_deltas(a: Column, b: Column) -> Column:
    return delta_seconds(a) / F.nullif(delta_seconds(b), F.lit(0))


def fractional_day(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, calendar: str = "standard") -> Column:
    """Day number as a fraction, a day starting at noon."""
    return julian_day(year, month, day, calendar).cast("double") + hour / 24 + minute / 1440 + second / 86400 - 0.5


def from_fractional_day(number: Column, calendar: str = "standard") -> Column:
    """struct(year, month, day, hour, minute, second) of a fractional day number, to the nearest second."""
    total = F.round((number + 0.5) * 86400).cast("long")
    both = _let(total, lambda t: F.struct(calendar_date(F.floor(t / 86400).cast("long"), calendar).alias("date"), F.pmod(t, F.lit(86400)).alias("rest")))
    return _let(both, lambda k: F.struct(
        k["date"]["year"].alias("year"), k["date"]["month"].alias("month"), k["date"]["day"].alias("day"), F.floor(k["rest"] / 3600).cast("int").alias("hour"),
        F.floor(F.pmod(k["rest"], F.lit(3600)) / 60).cast("int").alias("minute"), F.pmod(k["rest"], F.lit(60)).cast("int").alias("second"),
    ))


#: Day number of 1 January 1900, from which ``days_since_1900`` counts.
DAY_1900 = 2415021


def days_since_1900(year: Column, month: Column, day: Column) -> Column:
    return julian_day(year, month, day) - DAY_1900


def from_days_since_1900(days: Column) -> Column:
    return calendar_date(days + DAY_1900)


def julian_day(year: Column, month: Column, day: Column, calendar: str = "standard") -> Column:
    """Day number: standard (Julian before 15 October 1582), 365_day or 360_day (from year 0)."""
    if calendar == "360_day":
        return _signed(year, F.abs(year) * 360 + (month - 1) * 30 + day - 1)
    if calendar == "365_day":
        starts = F.array(*map(F.lit, (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)))
        return _signed(year, F.abs(year) * 365 + F.element_at(starts, month.cast("int")) + day - 1)
    a = F.floor((14 - month) / 12)
    y, m = year + 4800 - a, month + 12 * a - 3
    core = day + F.floor((153 * m + 2) / 5) + 365 * y + F.floor(y / 4)
    gregorian = core - F.floor(y / 100) + F.floor(y / 400) - 32045
    return F.when(year * 10000 + month * 100 + day >= 15821015, gregorian).otherwise(core - 32083).cast("long")


def _signed(year: Column, number: Column) -> Column:
    """In the 365- and 360-day calendars a day of a negative year has the negative number of that of the positive year."""
    return F.when(year < 0, -number).otherwise(number)


def calendar_date(number: Column, calendar: str = "standard") -> Column:
    """struct(year, month, day) of a day number of ``julian_day``."""
    if calendar in ("360_day", "365_day"):
        sign, number = F.when(number < 0, -1).otherwise(1), F.abs(number)
    if calendar == "360_day":
        rest = F.pmod(number, F.lit(360))
        return F.struct((sign * F.floor(number / 360)).cast("int").alias("year"), (F.floor(rest / 30) + 1).cast("int").alias("month"), (rest % 30 + 1).cast("int").alias("day"))
    if calendar == "365_day":
        rest = F.pmod(number, F.lit(365))
        starts = F.array(*map(F.lit, (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)))
        month = F.size(F.filter(starts, lambda s: s <= rest))
        return F.struct((sign * F.floor(number / 365)).cast("int").alias("year"), month.alias("month"), (rest - F.element_at(starts, month) + 1).cast("int").alias("day"))
    century = _let(number, lambda n: F.struct(F.when(n >= 2299161, n + 32044).otherwise(n + 32082).alias("a"), (n >= 2299161).alias("new")))
    cycle = _let(century, lambda k: F.struct(k["a"].alias("a"), F.when(k["new"], F.floor((4 * k["a"] + 3) / 146097)).otherwise(0).alias("b"), k["new"].alias("new")))
    left = _let(cycle, lambda k: F.struct(k["b"].alias("b"), F.when(k["new"], k["a"] - F.floor(146097 * k["b"] / 4)).otherwise(k["a"]).alias("c")))
    year = _let(left, lambda k: F.struct(k["b"].alias("b"), k["c"].alias("c"), F.floor((4 * k["c"] + 3) / 1461).alias("d")))
    rest = _let(year, lambda k: F.struct(k["b"].alias("b"), k["d"].alias("d"), (k["c"] - F.floor(1461 * k["d"] / 4)).alias("e")))
    month = _let(rest, lambda k: F.struct(k["b"].alias("b"), k["d"].alias("d"), k["e"].alias("e"), F.floor((5 * k["e"] + 2) / 153).alias("m")))
    return _let(month, lambda k: F.struct(
        (100 * k["b"] + k["d"] - 4800 + F.floor(k["m"] / 10)).cast("int").alias("year"), (k["m"] + 3 - 12 * F.floor(k["m"] / 10)).cast("int").alias("month"), (k["e"] - F.floor((153 * k["m"] + 2) / 5) + 1).cast("int").alias("day"),
    ))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


# polygons: arrays of struct(x, y); polynomials: arrays of coefficients, constant first

def polygon_area(points: Column) -> Column:
    """Signed area, positive counter-clockwise."""
    return _edges(points, lambda a, b: a.x * b.y - b.x * a.y) / 2


def _edges(points, f):
    n = F.size(points)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, k: s + f(F.element_at(points, k), F.element_at(points, k % n + 1)).cast("double"))


def polygon_orientation(points: Column) -> Column:
    """1 clockwise, -1 counter-clockwise, 0 for a flat line."""
    return -F.signum(polygon_area(points)).cast("int")


def shifted_longitude(x: Column, meridian: float = 180.0) -> Column:
    """The longitude seen from the opposite meridian."""
    return F.when(x > 0, F.abs(x) - meridian).otherwise(meridian - F.abs(x))


def with_pole(points: Column, meridian: float = 180.0) -> Column:
    """A polygon around a pole as one that a longitude-latitude plane can show: closed along the meridian over the pole.

    Between the point of the largest and that of the smallest longitude (which must follow each other) come the
    crossings of the meridian, where not there yet, and the pole's corners; null where they don't follow each other.
    """
    n = F.size(points)
    xs = F.transform(points, lambda p: p.x)
    i, j = F.array_position(xs, F.array_max(xs)).cast("int"), F.array_position(xs, F.array_min(xs)).cast("int")
    east, west = F.element_at(points, i), F.element_at(points, j)
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    m, none = F.lit(float(meridian)), F.array().cast("array<struct<x:double,y:double>>")
    to_east, to_west = m - east.x, F.abs(m + west.x)
    cut = east.y + to_east / (to_east + to_west) * (west.y - east.y)
    at_east = F.when(F.abs(east.x - m) > 1e-8, F.array(corner(m, cut))).otherwise(none)
    at_west = F.when(F.abs(west.x + m) > 1e-8, F.array(corner(-m, cut))).otherwise(none)
    part = lambda a, b: F.when(b >= a, F.slice(points, a, F.greatest(b - a + 1, F.lit(0)))).otherwise(none)
    one = F.lit(1)
    north = F.concat(part(one, i), at_east, F.array(corner(m, F.lit(90)), corner(-m, F.lit(90))), at_west, F.when(j > 1, part(j, n)).otherwise(none))
    south = F.concat(part(one, j), at_west, F.array(corner(-m, F.lit(-90)), corner(m, F.lit(-90))), at_east, F.when(i > 1, part(i, n)).otherwise(none))
    return F.when(i % n + 1 == j, north).when(j % n + 1 == i, south)


def polygon_centre(points: Column) -> Column:
    area = polygon_area(points)
    cx = _edges(points, lambda a, b: (a.x + b.x) * (a.x * b.y - b.x * a.y))
    cy = _edges(points, lambda a, b: (a.y + b.y) * (a.x * b.y - b.x * a.y))
    return F.struct((cx / (6 * area)).alias("x"), (cy / (6 * area)).alias("y"))


def polynomial(coefficients: Column, x: Column) -> Column:
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda s, c: s * x + c)


def derivative(coefficients: Column) -> Column:
    return F.transform(F.slice(coefficients, 2, F.greatest(F.lit(0), F.size(coefficients) - 1)), lambda c, k: c * (k + 1))


def order(coefficients: Column) -> Column:
    """Largest power with a coefficient other than 0; 0 for a constant."""
    return F.greatest(F.lit(0), F.array_max(F.transform(coefficients, lambda c, k: F.when(c != 0, k).otherwise(0))))


def _derivatives(c: np.ndarray, x: np.ndarray, n: int) -> list[np.ndarray]:
    """The value and the first derivatives over 1, 1, 2 and 6 (``n`` of them) of polynomials in rows, constants first."""
    v = [np.zeros(len(x)) for _ in range(n)]
    for k in range(c.shape[1] - 1, -1, -1):
        for i in range(n - 1, 0, -1):
            v[i] = v[i] * x + v[i - 1]
        v[0] = v[0] * x + c[:, k]
    return v


def _search(c: np.ndarray, x: np.ndarray, steps: int, method: str, delta: float | None) -> np.ndarray:
    """Roots of polynomials of one length: rows whose step changes nothing rest, the others go on."""
    x, at = x.copy(), np.arange(len(x))
    n = {"newton": 2, "halley": 3}.get(method, 4)
    for _ in range(steps):
        if not len(at):
            break
        old, ok = x[at], np.ones(len(at), bool)

        def over(p, q):
            ok[:] &= q != 0
            return p / np.where(q == 0, 1.0, q)

        v = _derivatives(c[at], old, n)
        r = over(v[0], v[1])
        if n == 3:
            r = over(r, 1 - r * over(v[2], v[1]))
        elif n == 4:
            bend = over(2 * v[2], v[1])
            r = over(r * (1 - r * bend / 2), 1 - bend * r + over(v[3], v[1]) * r * r)
        new = np.where(ok, old - r, old)
        if delta is not None:
            new = np.where(np.abs(v[0]) < delta, old, new)
        x[at] = new
        at = at[(new != old) & ~np.isnan(new)]
    return x if delta is None else np.where(np.abs(_derivatives(c, x, 1)[0]) < delta, x, np.nan)


def root(coefficients: Column, start: Column, steps: int = 50, method: str = "newton", delta: float | None = None) -> Column:
    """A root from ``start`` by Newton's, Halley's or the cubic Householder step (method "newton", "halley", "cubic").

    With ``delta`` the search ends where the value is below it and gives null if that isn't reached in ``steps``.
    A step whose divisor is 0 isn't taken, nor is one out of null coefficients.  Steps are taken for a batch of rows at
    once in Python workers: as nested array functions they cost milliseconds a row.
    """
    @F.arrow_udf("double")
    def found(c: pa.Array, x: pa.Array) -> pa.Array:
        size = c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, first = c.flatten(), np.cumsum(size) - size
        values, lost = flat.to_numpy(zero_copy_only=False).astype(float), flat.is_null().to_numpy(zero_copy_only=False)
        out = x.to_numpy(zero_copy_only=False).astype(float)
        none = x.is_null().to_numpy(zero_copy_only=False).copy()
        unknown = c.is_null().to_numpy(zero_copy_only=False).copy()
        unknown[np.repeat(np.arange(len(size)), size)[lost]] = True
        if delta is not None:
            none |= unknown
        with np.errstate(all="ignore"):
            for k in np.unique(size):
                own = np.flatnonzero((size == k) & ~unknown & ~none)
                out[own] = _search(values[first[own][:, None] + np.arange(k)], out[own], steps, method, delta)
        return pa.array(out, mask=none | (np.isnan(out) if delta is not None else False))

    return found(coefficients.cast("array<double>"), start.cast("double"))


# analytic test functions of optimizers, over lists of columns

def sphere(xs):
    return sum((x * x for x in xs), F.lit(0.0))


def rosenbrock(xs):
    return sum((100 * F.pow(b - a * a, F.lit(2)) + F.pow(1 - a, F.lit(2)) for a, b in zip(xs, xs[1:])), F.lit(0.0))


def rastrigin(xs):
    return 10.0 * len(xs) + sum((x * x - 10 * F.cos(2 * math.pi * x) for x in xs), F.lit(0.0))


def griewank(xs):
    product = F.lit(1.0)
    for i, x in enumerate(xs, 1):
        product = product * F.cos(x / math.sqrt(i))
    return 1 + sum((x * x / 4000 for x in xs), F.lit(0.0)) - product


def ackley(xs):
    n = len(xs)
    return -20 * F.exp(-0.2 * F.sqrt(sphere(xs) / n)) - F.exp(sum((F.cos(2 * math.pi * x) for x in xs), F.lit(0.0)) / n) + 20 + math.e


def booth(xs):
    a, b = xs
    return F.pow(a + 2 * b - 7, F.lit(2)) + F.pow(2 * a + b - 5, F.lit(2))


def himmelblau(xs):
    a, b = xs
    return F.pow(a * a + b - 11, F.lit(2)) + F.pow(a + b * b - 7, F.lit(2))


def goldstein_price(xs):
    a, b = xs
    left = 1 + F.pow(a + b + 1, F.lit(2)) * (19 - 14 * a + 3 * a * a - 14 * b + 6 * a * b + 3 * b * b)
    return left * (30 + F.pow(2 * a - 3 * b, F.lit(2)) * (18 - 32 * a + 12 * a * a + 48 * b - 36 * a * b + 27 * b * b))


def six_hump_camel(xs):
    a, b = xs
    return (4 - 2.1 * a * a + F.pow(a, F.lit(4)) / 3) * a * a + a * b + (4 * b * b - 4) * b * b


def beale(xs):
    a, b = xs
    return F.pow(1.5 - a + a * b, F.lit(2)) + F.pow(2.25 - a + a * b * b, F.lit(2)) + F.pow(2.625 - a + a * b * b * b, F.lit(2))


def easom(xs):
    a, b = xs
    return -F.cos(a) * F.cos(b) * F.exp(-F.pow(a - math.pi, F.lit(2)) - F.pow(b - math.pi, F.lit(2)))


def branin(xs):
    a, b = xs
    return F.pow(b - 5.1 / (4 * math.pi**2) * a * a + 5 / math.pi * a - 6, F.lit(2)) + 10 * (1 - 1 / (8 * math.pi)) * F.cos(a) + 10


TEST_FUNCTIONS = {f.__name__: f for f in (sphere, rosenbrock, rastrigin, griewank, ackley, booth, himmelblau, goldstein_price, six_hump_camel, beale, easom, branin)}


# random numbers

def uniform(seed: int) -> Column:
    """Uniform on [0, 1), a stream of its own for each seed; repeatable for equal partitions."""
    return F.rand(seed)


def gaussian_noise(seed: int) -> Column:
    return F.randn(seed)


def hashed_uniform(key: Column, seed: int) -> Column:
    """Uniform on [0, 1) out of a row's key and a seed: the same number wherever the row is."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / float(1 << 53)


def hashed_gaussian(key: Column, seed: int) -> Column:
    """Standard normal out of a row's key and a seed (Box and Muller)."""
    return F.sqrt(-2 * F.ln(1 - hashed_uniform(key, 2 * seed))) * F.cos(2 * math.pi * hashed_uniform(key, 2 * seed + 1))
