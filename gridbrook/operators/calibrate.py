"""Calibration: searches on the driver that evaluate batches of parameter sets, one DataFrame a batch.

An objective takes an array (sets x parameters) and returns a cost for each set; ``spark_objective`` makes one that
evaluates all sets of a batch against data in one grouped aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Objective = Callable[[np.ndarray], np.ndarray]


def spark_objective(data: DataFrame, model: Callable[[list[Column]], Column], observed: str, metric: Callable[[Column, Column], Column]) -> Objective:
    """Costs of all parameter sets of a batch: sets are few and put beside each row, metrics in one aggregation."""
    def evaluate(sets: np.ndarray) -> np.ndarray:
        costs = [metric(F.col(observed), model([F.lit(float(v)) for v in row])).alias(f"c{i}") for i, row in enumerate(sets)]
        return np.array(list(data.agg(*costs).first()), float)

    return evaluate


def _bounds(low, high):
    return np.asarray(low, float), np.asarray(high, float)


def dds(objective: Objective, start, low, high, evaluations: int = 1000, r: float = 0.2, seed: int = 1) -> tuple[np.ndarray, float]:
    """Dynamically dimensioned search: fewer and fewer parameters are moved, reflected at the bounds."""
    low, high = _bounds(low, high)
    rng, best = np.random.default_rng(seed), np.array(start, float)
    cost = float(objective(best[None])[0])
    for i in range(1, evaluations):
        move = rng.random(len(best)) < 1 - math.log(i) / math.log(evaluations)
        if not move.any():
            move[rng.integers(len(best))] = True
        new = best + move * rng.normal(size=len(best)) * r * (high - low)
        new = _reflected(new, low, high)
        now = float(objective(new[None])[0])
        if now <= cost:
            best, cost = new, now
    return best, cost


def summary_objective(data: DataFrame, features: list[str], observed: str, model: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = 1_000_000) -> Objective:
    """Root mean square errors without a pass over the data for each batch, for models of a bounded set of feature values.

    Rows are reduced once to counts, means and variances for each distinct set of features, which raise beyond
    ``most``; the mean square error is that of the means plus the variances, weighted.  ``model`` takes a parameter set
    and the array of features.
    """
    rows = data.groupBy(*features).agg(F.count(observed).alias("n"), F.avg(observed).alias("m"), F.var_pop(observed).alias("v")).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct sets of features")
    x, n, m, v = rows[features].to_numpy(float), rows["n"].to_numpy(float), rows["m"].to_numpy(float), rows["v"].to_numpy(float)
    return lambda sets: np.array([math.sqrt(float((n * ((model(p, x) - m) ** 2 + v)).sum() / n.sum())) for p in sets])


def mdds(objective: Objective, start, low, high, evaluations: int = 1000, r: float = 0.2, seed: int = 1) -> tuple[np.ndarray, float]:
    """DDS whose step size adapts: it grows after steps that better the cost and shrinks after a row of those that don't."""
    low, high = _bounds(low, high)
    rng, best = np.random.default_rng(seed), np.array(start, float)
    cost, failed = float(objective(best[None])[0]), 0
    for i in range(1, evaluations):
        move = rng.random(len(best)) < 1 - math.log(i) / math.log(evaluations)
        if not move.any():
            move[rng.integers(len(best))] = True
        new = _reflected(best + move * rng.normal(size=len(best)) * r * (high - low), low, high)
        now = float(objective(new[None])[0])
        if now <= cost:
            best, cost, r, failed = new, now, min(1.0, r * 1.3), 0
        else:
            failed += 1
            if failed % (5 * len(best)) == 0:
                r = max(1e-4, r * 0.7)
    return best, cost


def _reflected(new, low, high):
    """A step over a bound is reflected; one that then passes the other bound ends at the bound it stepped over."""
    below, above = new < low, new > high
    new = np.where(below, 2 * low - new, np.where(above, 2 * high - new, new))
    return np.where(below & (new > high), low, np.where(above & (new < low), high, new))


def nelder_mead_xy(objective, x, y, start, **options) -> tuple[np.ndarray, float]:
    """Downhill simplex of an objective that takes a parameter set and the data x and y."""
    return nelder_mead(lambda sets: np.array([objective(p, x, y) for p in sets]), start, **options)


def initial_temperature(objective: Objective, start, low, high, acceptance: float = 0.95, samples: int = 500, seed: int = 1, tolerance: float = 1e-3) -> float:
    """The temperature at which worsening steps between sampled neighbours are accepted with the wanted share."""
    low, high = _bounds(low, high)
    rng = np.random.default_rng(seed)
    points = np.clip(np.asarray(start, float) + rng.normal(size=(samples, len(low))) * 0.2 * (high - low), low, high)
    costs = objective(points)
    a, b = costs[:-1], costs[1:]
    lower, upper = np.minimum(a, b), np.maximum(a, b)
    worse = upper > lower
    if not worse.any():
        return 1.0
    lower, upper = lower[worse], upper[worse]
    t = float((upper - lower).mean() / math.log(1 / acceptance))
    for _ in range(200):
        share = float(np.exp(-upper / t + upper.min() / t).sum() / np.exp(-lower / t + upper.min() / t).sum())
        if abs(share - acceptance) < tolerance:
            break
        t *= math.log(max(share, 1e-12)) / math.log(acceptance)
    return t


def cubic_cost(sets: np.ndarray) -> np.ndarray:
    """Mean absolute error of cubics p0 x^3 + p1 x^2 + p2 x + p3 against six measured points."""
    x = np.array([0.5, 1.0, 1.5, 2.0, 2.5, 3.0])  # fixed values
    y = np.array([5.725, 21.7, 49.175, 88.9, 141.625, 208.1])
    p = np.atleast_2d(sets)
    return np.abs(y - (p[:, :1] * x**3 + p[:, 1:2] * x**2 + p[:, 2:3] * x + p[:, 3:4])).mean(axis=1)


def cubic_range(parameters, k: int) -> tuple[float, float]:
    """Bounds of parameter ``k`` (from 0) of ``cubic_cost``, the first two depending on each other."""
    return [(0.025 * parameters[1], 10.0), (0.0, 40.0 * parameters[0]), (0.0, 10.0), (0.0, 5.0)][k]


def nelder_mead(objective: Objective, start, step=0.1, tolerance: float = 1e-10, evaluations: int = 2000, low=None, high=None) -> tuple[np.ndarray, float]:
    """Downhill simplex; points are kept within the bounds where given."""
    inside = lambda x: x if low is None else np.clip(x, low, high)
    start = np.array(start, float)
    points = np.array([inside(start)] + [inside(start + np.eye(len(start))[k] * (step if np.isscalar(step) else step[k])) for k in range(len(start))])
    costs, used = objective(points), len(points)
    # equal costs on both sides of a valley are no end: the simplex must be small too
    while used < evaluations and (costs.max() - costs.min() > tolerance or (np.ptp(points, axis=0) > math.sqrt(tolerance) * (1 + np.abs(points[0]))).any()):
        order = np.argsort(costs)
        points, costs = points[order], costs[order]
        centre, worst = points[:-1].mean(axis=0), points[-1]
        tries = np.array([inside(centre + f * (centre - worst)) for f in (1.0, 2.0, 0.5, -0.5)])
        c = objective(tries)  # one batch: reflection, expansion and both contractions
        used += 4
        pick = int(np.argmin(c))
        if c[pick] < costs[-1]:
            points[-1], costs[-1] = tries[pick], c[pick]
        else:
            points[1:] = points[0] + 0.5 * (points[1:] - points[0])
            costs[1:] = objective(points[1:])
            used += len(points) - 1
    k = int(np.argmin(costs))
    return points[k], float(costs[k])


def anneal(objective: Objective, start, low, high, evaluations: int = 3000, temperature: float | None = None, cooling: float = 0.95, chain: int = 50, seed: int = 1) -> tuple[np.ndarray, float]:
    """Simulated annealing with chains of equal temperature; the first temperature accepts most worsening steps."""
    low, high = _bounds(low, high)
    rng = np.random.default_rng(seed)
    now = best = np.array(start, float)
    cost = least = float(objective(now[None])[0])
    if temperature is None:
        probe = objective(rng.uniform(low, high, (50, len(now))))
        temperature = float(np.abs(np.diff(probe)).mean() / math.log(1 / 0.8))
    for i in range(evaluations):
        scale = max(0.01, min(1.0, 1 - i / evaluations)) ** 2
        new = np.clip(now + rng.normal(size=len(now)) * 0.2 * scale * (high - low), low, high)
        c = float(objective(new[None])[0])
        if c < cost or rng.random() < math.exp(-(c - cost) / max(temperature, 1e-300)):
            now, cost = new, c
            if c < least:
                best, least = new, c
        if i % chain == chain - 1:
            temperature *= cooling
    return best, least


def sce(objective: Objective, low, high, complexes: int = 4, loops: int = 60, seed: int = 1, spark=None, state: str | None = None) -> tuple[np.ndarray, float]:
    """Shuffled complex evolution; the offspring of all complexes are one batch.

    With ``state``, a folder of tables, the population is written after each loop, and a search that was broken off
    goes on from the last one there.
    """
    low, high = _bounds(low, high)
    n, rng = len(low), np.random.default_rng(seed)
    m = 2 * n + 1
    points = rng.uniform(low, high, (complexes * m, n))
    first = 0
    if state and (found := _last_population(spark, state)):
        first, points, costs = found
        rng = np.random.default_rng([seed, first])
    else:
        costs = objective(points)
    for loop in range(first, loops):
        order = np.argsort(costs)
        points, costs = points[order], costs[order]
        for _ in range(m):
            picks = []
            for k in range(complexes):
                members = np.arange(k, len(points), complexes)
                members = members[np.argsort(costs[members])]
                weights = np.arange(len(members), 0, -1.0)
                chosen = members[np.sort(rng.choice(len(members), n + 1, False, weights / weights.sum()))]
                picks.append((chosen, points[chosen[:-1]].mean(axis=0)))
            offers = []
            for chosen, centre in picks:
                up = 2 * centre - points[chosen[-1]]
                if ((up < low) | (up > high)).any():
                    up = rng.uniform(low, high)
                offers += [up, (centre + points[chosen[-1]]) / 2, rng.uniform(low, high)]
            got = objective(np.array(offers))
            for k, (chosen, _) in enumerate(picks):
                worst = chosen[-1]
                for o in range(3):
                    if got[3 * k + o] < costs[worst] or o == 2:
                        points[worst], costs[worst] = offers[3 * k + o], got[3 * k + o]
                        break
        if state:
            rows = [(loop + 1, i, p.tolist(), float(c)) for i, (p, c) in enumerate(zip(points, costs))]
            spark.createDataFrame(rows, "loop int, i int, parameters array<double>, cost double").coalesce(1).write.mode("append").parquet(state)
        if np.ptp(points, axis=0).max() < 1e-8:
            break
    k = int(np.argmin(costs))
    return points[k], float(costs[k])


def _last_population(spark, state: str):
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema("loop int, i int, parameters array<double>, cost double").parquet(state)
    except AnalysisException:  # nothing was written yet
        return None
    last = rows.agg(F.max("loop")).first()[0]
    if last is None:
        return None
    found = rows.where(F.col("loop") == last).orderBy("i").collect()
    return last, np.array([r.parameters for r in found], float), np.array([r.cost for r in found], float)


def mcmc_stddev(spark, residuals: Callable[[np.ndarray], np.ndarray], start, low, high, **options) -> DataFrame:
    """Metropolis chains for errors of unknown deviation: the parameters' likelihood with the errors' own standard deviation."""
    def value(p):
        e = residuals(p)
        return -0.5 * len(e) * math.log(max(float((e * e).mean()), 1e-300))

    return mcmc(spark, value, start, low, high, **options)


def mcmc(spark, loglikelihood: Callable[[np.ndarray], float], start, low, high, chains: int = 4, burn_in: int = 1000, samples: int = 2000, seed: int = 1) -> DataFrame:
    """(chain, step, parameters, value): Metropolis chains, one a task; the step is tuned in the burn-in to accept about 0.3."""
    low, high = _bounds(low, high)
    start = np.asarray(start, float)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for chain in pdf["chain"]:
                rng = np.random.default_rng([seed, int(chain)])
                now, step, taken = start.copy(), 0.1, 0
                value = loglikelihood(now)
                rows = []
                for i in range(burn_in + samples):
                    new = now + rng.normal(size=len(now)) * step * (high - low)
                    if ((new >= low) & (new <= high)).all():
                        v = loglikelihood(new)
                        if math.log(rng.random() + 1e-300) < v - value:
                            now, value, taken = new, v, taken + 1
                    if i < burn_in and i % 50 == 49:
                        step, taken = step * (1.3 if taken > 15 else 0.75), 0
                    if i >= burn_in:
                        rows.append((int(chain), i - burn_in, now.tolist(), float(value)))
                yield pd.DataFrame(rows, columns=["chain", "step", "parameters", "value"])

    return spark.range(0, chains, 1, chains).withColumnRenamed("id", "chain").mapInPandas(run, "chain long, step long, parameters array<double>, value double")


def convergence(samples: DataFrame, dims: int) -> DataFrame:
    """(parameter, r): ratio of the variance over all chains to that within them, near 1 when they agree."""
    rows = samples.select("chain", F.posexplode("parameters").alias("parameter", "v"))
    per = rows.groupBy("parameter", "chain").agg(F.avg("v").alias("m"), F.var_samp("v").alias("w"), F.count("v").alias("n"))
    return per.groupBy("parameter").agg(F.sqrt((F.avg("w") * (F.avg("n") - 1) / F.avg("n") + F.var_samp("m")) / F.avg("w")).alias("r"))
