"""Analytic test functions of optimizers as expressions of a list of columns; most are shifted so that their least value is 0."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi
ALL: dict = {}


def _known(f):
    ALL[f.__name__] = f
    return f


def _sum(parts) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def _sq(c):
    return c * c


def _pow(c, p):
    return F.pow(c, F.lit(float(p)))


def _one(name: str, f) -> None:
    """A function of one variable."""
    f.__name__ = name
    ALL[name] = lambda xs: f(xs[0])


_one("quadratic", lambda x: _sq(x - 2) + 1)
_one("quadratic_exponential", lambda x: _sq(x) + F.exp(-x))
_one("quartic", lambda x: _pow(x, 4) + 2 * _sq(x) + x + 3)
_one("steep_valley", lambda x: F.exp(x) + 0.01 / x + 0.0009877013)
_one("steep_valley2", lambda x: F.exp(x) - 2 * x + 0.01 / x - 0.000001 / _sq(x))
_one("dying_snake", lambda x: (x + F.sin(x)) * F.exp(-_sq(x)) + 0.8242393985)
_one("thin_pole", lambda x: F.when(F.abs(x - PI) < 1e-12, -10000.0).otherwise(3 * _sq(x) + 1 + F.ln(_sq(x - PI)) / PI**4))
_one("oscillatory_parabola", lambda x: _sq(x) - 10 * F.sin(_sq(x) - 3 * x + 2) + 9.9779149346)
_one("cosine_combo", lambda x: _sum(a * F.cos(w * x) for a, w in ((1, 1), (5, 1.6), (-2, 2), (5, 4.5), (7, 9))) + 14.6771885214)
_one("abs1", lambda x: 1 + F.abs(3 * x - 1))


@_known
def fletcher_powell_helical_valley(xs):
    a, b, c = xs
    turn = F.when(a > 0, F.atan(b / a) / (2 * PI)).when(a < 0, F.atan(b / a) / (2 * PI) + 0.5).otherwise(F.signum(b) / 4)
    return 100 * _sq(c - 10 * turn) + 100 * _sq(F.sqrt(_sq(a) + _sq(b)) - 1) + _sq(c)


@_known
def biggs_exp6(xs):
    a, b, c, d, e, f = xs
    at = [k / 10 for k in range(1, 14)]
    return _sum(_sq(c * F.exp(-t * a) - d * F.exp(-t * b) + f * F.exp(-t * e) - (math.exp(-t) - 5 * math.exp(-10 * t) + 3 * math.exp(-4 * t))) for t in at)


@_known
def gaussian(xs):
    half = [0.0009, 0.0044, 0.0175, 0.0540, 0.1295, 0.2420, 0.3521]  # fixed values, mirrored at 0.3989
    y = [*half, 0.3989, *reversed(half)]
    return _sum(_sq(xs[0] * F.exp(-xs[1] * _sq(3.5 - k / 2 - xs[2]) / 2) - v) for k, v in enumerate(y))


@_known
def powell_badly_scaled(xs):
    a, b = xs
    return _sq(1e4 * a * b - 1) + _sq(F.exp(-a) + F.exp(-b) - 1.0001)


@_known
def box_3dimensional(xs):
    a, b, c = xs
    return _sum(_sq(F.exp(-t * a) - F.exp(-t * b) - c * (math.exp(-t) - math.exp(-10 * t))) for t in (k / 10 for k in range(1, 11)))


@_known
def variably_dimensioned(xs):
    f = _sum(k * (x - 1) for k, x in enumerate(xs, 1))
    return _sq(f) * (1 + _sq(f)) + _sum(_sq(x - 1) for x in xs)


@_known
def watson(xs):
    def slope(t):
        return _sum(k * t ** (k - 1) * x for k, x in enumerate(xs) if k)

    def value(t):
        return _sum(t**k * x for k, x in enumerate(xs))

    at = [k / 29 for k in range(1, 30)]
    return _sum(_sq(slope(t) - _sq(value(t)) - 1) for t in at) + _sq(xs[0]) + _sq(xs[1] - _sq(xs[0]) - 1)


@_known
def penalty1(xs):
    return 1e-5 * _sum(_sq(x - 1) for x in xs) + _sq(_sum(map(_sq, xs)) - 0.25)


@_known
def penalty2(xs):
    n, e = len(xs), [F.exp(x / 10) for x in xs]
    step = [_sq(b + a - (math.exp(k / 10) + math.exp((k + 1) / 10))) for k, (a, b) in enumerate(zip(e, e[1:]), 1)]
    return 1e-5 * (_sum(step) + _sum(_sq(v - math.exp(-0.1)) for v in e[1:])) + _sq(_sum((n - k) * _sq(x) for k, x in enumerate(xs)) - 1) + _sq(xs[0] - 0.2)


@_known
def brown_badly_scaled(xs):
    a, b = xs
    return _sq(a - 1e6) + _sq(b - 2e-6) + _sq(a * b - 2)


@_known
def brown_dennis(xs):
    a, b, c, d = xs
    return _sum(_sq(_sq(a + t * b - math.exp(t)) + _sq(c + math.sin(t) * d - math.cos(t))) for t in (k / 5 for k in range(1, 21))) - 85822.2016263563


@_known
def trigonometric(xs):
    n, all_cos = len(xs), _sum(map(F.cos, xs))
    return _sum(_sq(n + k - F.sin(x) - all_cos - k * F.cos(x)) for k, x in enumerate(xs, 1))


@_known
def ext_rosenbrock_parabolic_valley(xs):
    return _sum(_sq(1 - a) for a in xs[::2]) + _sum(100 * _sq(b - _sq(a)) for a, b in zip(xs[::2], xs[1::2]))


@_known
def ext_powell_singular_quartic(xs):
    """Of groups of four variables."""
    groups = zip(*(xs[k::4] for k in range(4)))
    return _sum(_sq(a + 10 * b) + 5 * _sq(c - d) + _pow(b - 2 * c, 4) + 10 * _pow(a - d, 4) for a, b, c, d in groups)


@_known
def beale(xs):
    a, b = xs
    return _sum(_sq(v - a * (1 - _pow(b, k))) for k, v in ((1, 1.5), (2, 2.25), (3, 2.625)))


@_known
def wood(xs):
    a, b, c, d = xs
    return 100 * _sq(b - _sq(a)) + _sq(1 - a) + 90 * _sq(d - _sq(c)) + _sq(1 - c) + 10 * _sq(b + d - 2) + 0.1 * _sq(b - d)


@_known
def chebyquad(xs):
    """Means of shifted Chebyshev polynomials against their integrals."""
    n = len(xs)
    rows = [[F.lit(1.0), 2 * x - 1] for x in xs]
    for r in rows:
        for _ in range(n - 1):
            r.append(2 * r[1] * r[-1] - r[-2])
    return _sum(_sq(_sum(r[k] for r in rows) / n + (1 / (k * k - 1) if k % 2 == 0 else 0.0)) for k in range(1, n + 1))


@_known
def leon_cubic_valley(xs):
    a, b = xs
    return 100 * _sq(b - _pow(a, 3)) + _sq(1 - a)


@_known
def gregory_karney_tridia_matrix(xs):
    return _sq(xs[0]) + 2 * _sum(map(_sq, xs[1:])) - 2 * _sum(a * b for a, b in zip(xs, xs[1:])) - 2 * xs[0] + len(xs)


@_known
def hilbert(xs):
    return _sum(a * b / (i + j + 1) for i, a in enumerate(xs) for j, b in enumerate(xs))


@_known
def de_jong_f1(xs):
    return _sum(map(_sq, xs))


@_known
def de_jong_f2(xs):
    a, b = xs
    return 100 * _sq(_sq(a) - b) + _sq(1 - a)


@_known
def de_jong_f3(xs):
    return _sum(F.signum(x) * F.floor(F.abs(x)) for x in xs)


@_known
def de_jong_f4(xs):
    """Without its noise; add ``gaussian_noise`` where that is wanted."""
    return _sum(k * _pow(x, 4) for k, x in enumerate(xs, 1))


@_known
def de_jong_f5(xs):
    a, b = xs
    holes = [(16 * i - 32, 16 * j - 32) for j in range(5) for i in range(1, 6)]
    return 1 / (500 + _sum(1 / (k + _pow(a - p, 6) + _pow(b - q, 6)) for k, (p, q) in enumerate(holes, 1))) - 0.0019996667


@_known
def schaffer_f6(xs):
    r2 = _sum(map(_sq, xs))
    return 0.5 + (_sq(F.sin(F.sqrt(r2))) - 0.5) / _sq(1 + 0.001 * r2)


@_known
def schaffer_f7(xs):
    r = F.sqrt(_sum(map(_sq, xs)))
    return F.sqrt(r) * (1 + _sq(F.sin(50 * _pow(r, 0.2))))


@_known
def goldstein_price_polynomial(xs):
    from gridbrook.functions.scalars import goldstein_price

    return goldstein_price(xs) - 3


@_known
def branin_rcos(xs):
    from gridbrook.functions.scalars import branin

    return branin(xs) - 0.3978873577


#: Places and depths of Shekel's foxholes.
FOXHOLES = [
    (4, 4, 4, 4), (1, 1, 1, 1), (8, 8, 8, 8), (6, 6, 6, 6), (3, 7, 3, 7),
    (2, 9, 2, 9), (5, 5, 3, 3), (8, 1, 8, 1), (6, 2, 6, 2), (7, 3.6, 7, 3.6),
]
DEPTHS = [0.1, 0.2, 0.2, 0.4, 0.6, 0.6, 0.3, 0.7, 0.5, 0.5]


def _shekel(m: int, shift: float):
    def f(xs):
        return shift - _sum(1 / (c + _sum(_sq(x - p) for x, p in zip(xs, hole))) for hole, c in zip(FOXHOLES[:m], DEPTHS))

    return f


ALL |= {"shekel_sqrn5": _shekel(5, 10.1527236935), "shekel_sqrn7": _shekel(7, 10.4024645722), "shekel_sqrn10": _shekel(10, 10.5359339075)}


@_known
def six_hump_camel_back_polynomial(xs):
    from gridbrook.functions.scalars import six_hump_camel

    return six_hump_camel(xs) + 1.0316284229


@_known
def shubert(xs):
    parts = [_sum(k * F.cos((k + 1) * x + k) for k in range(1, 6)) for x in xs]
    return reduce(lambda a, b: a * b, parts) + 186.7309088310


@_known
def easom(xs):
    from gridbrook.functions import scalars

    return scalars.easom(xs) + 1


@_known
def bohachevsky1(xs):
    a, b = xs
    return _sq(a) + 2 * _sq(b) - 0.3 * F.cos(3 * PI * a) - 0.4 * F.cos(4 * PI * b) + 0.7


@_known
def bohachevsky2(xs):
    a, b = xs
    return _sq(a) + 2 * _sq(b) - 0.3 * F.cos(3 * PI * a) * F.cos(4 * PI * b) + 0.3


@_known
def bohachevsky3(xs):
    a, b = xs
    return _sq(a) + 2 * _sq(b) - 0.3 * F.cos(3 * PI * a + 4 * PI * b) + 0.3


@_known
def colville_polynomial(xs):
    a, b, c, d = xs
    return 100 * _sq(b - _sq(a)) + _sq(1 - a) + 90 * _sq(d - _sq(c)) + _sq(1 - c) + 10.1 * (_sq(b - 1) + _sq(d - 1)) + 19.8 * (b - 1) * (d - 1)


@_known
def powell3d(xs):
    a, b, c = xs
    return 3 - 1 / (1 + _sq(a - b)) - F.sin(PI * b * c / 2) - F.when(b == 0, 0.0).otherwise(F.exp(-_sq((a + c) / F.nullif(b, F.lit(0.0)) - 2)))


@_known
def griewank(xs):
    waves = reduce(lambda a, b: a * b, (F.cos(x / math.sqrt(k)) for k, x in enumerate(xs, 1)))
    return _sum(map(_sq, xs)) / (200 if len(xs) == 2 else 4000) - waves + 1


@_known
def schwefel(xs):
    return _sum(-x * F.sin(F.sqrt(F.abs(x))) for x in xs) + 418.9828872724338 * len(xs)


@_known
def michalewicz(xs, p: int = 20):
    shift = {2: 1.8013033793, 5: 4.6876581791}.get(len(xs), 0.0)
    return shift - _sum(F.sin(x) * _pow(F.sin(_sq(x) * k / PI), p) for k, x in enumerate(xs, 1))


@_known
def hump(xs):
    a, b = xs
    return 1.0316285 + 4 * _sq(a) - 2.1 * _pow(a, 4) + _pow(a, 6) / 3 + a * b - 4 * _sq(b) + 4 * _pow(b, 4)


@_known
def levy(xs):
    z = [1 + (x - 1) / 4 for x in xs]
    return _sq(F.sin(PI * z[0])) + _sum(_sq(v - 1) * (1 + 10 * _sq(F.sin(PI * v + 1))) for v in z[:-1]) + _sq(z[-1] - 1) * (1 + _sq(F.sin(2 * PI * z[-1])))


@_known
def matyas(xs):
    a, b = xs
    return 0.26 * (_sq(a) + _sq(b)) - 0.48 * a * b


@_known
def perm(xs):
    return _sum(_sq(_sum((j**k + 0.5) * (_pow(x / j, k) - 1) for j, x in enumerate(xs, 1))) for k in range(1, len(xs) + 1))


@_known
def power_sum(xs):
    return _sum(_sq(_sum(_pow(x, k) for x in xs) - b) for k, b in zip(range(1, 5), (8, 18, 44, 114)))


# sums over any number of variables

@_known
def shifted_sphere(xs):
    return _sum(_sq(x - 1) for x in xs)


@_known
def axis_parallel_hyper_ellips(xs):
    return _sum(k * _sq(x) for k, x in enumerate(xs, 1))


@_known
def rotated_hyper_ellipsoid(xs):
    return _sum(_sq(_sum(xs[:k])) for k in range(1, len(xs) + 1))


@_known
def different_powers(xs):
    return _sum(_pow(F.abs(x), k) for k, x in enumerate(xs, 2))


@_known
def drop_wave(xs):
    r2 = _sum(map(_sq, xs))
    return -(1 + F.cos(12 * F.sqrt(r2))) / (0.5 * r2 + 2)


@_known
def deceptive(xs):
    n = len(xs)

    def height(x, a):
        return (
            F.when(x <= 0, x).when(x <= 0.8 * a, 0.8 - x / a).when(x <= a, 5 * x / a - 4).when(x <= (1 + 4 * a) / 5, 1 + 5 * (x - a) / (a - 1))
            .when(x <= 1, 0.8 + (x - 1) / (1 - a)).otherwise(x - 1)
        )

    return -_sq(_sum(height(x, k / (n + 1)) for k, x in enumerate(xs, 1)) / n)


def register() -> dict:
    """All of them, and those of ``scalars``, by name."""
    from gridbrook.functions import scalars

    return {k: f for k, f in scalars.TEST_FUNCTIONS.items() if k not in ALL} | ALL
