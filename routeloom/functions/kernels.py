"""Array kernels for what built-in functions can't express: composing, merging and thinning
travel-time functions, speed profiles, and fitting the speed model.

Functions are (at, val) float arrays over one period that begin at 0 and end at the period
with their first value; times between points are interpolated. Each kernel works on one row,
so that it can be called in Arrow batches and loses nothing with an executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DAY_S = 86_400.0

Points = tuple[np.ndarray, np.ndarray]


def value(f: Points, t: np.ndarray, period: float = DAY_S) -> np.ndarray:
    return np.interp(np.mod(t, period), f[0], f[1]) if len(f[0]) > 1 else np.full(np.shape(t), f[1][0])


def _spread(f: Points, period: float) -> Points:
    return f if len(f[0]) > 1 else (np.array([0.0, period]), np.repeat(f[1], 2))


def _tidy(at: np.ndarray, val: np.ndarray, eps: float = 1e-9) -> Points:
    """Without repeated times and without points on the line between their neighbours."""
    keep = np.concatenate([[True], np.diff(at) > eps])
    at, val = at[keep], val[keep]
    if len(at) < 3:
        return at, val
    line = val[:-2] + (val[2:] - val[:-2]) * (at[1:-1] - at[:-2]) / (at[2:] - at[:-2])
    bend = np.concatenate([[True], np.abs(line - val[1:-1]) > eps, [True]])
    return at[bend], val[bend]


def link(f: Points, g: Points, period: float = DAY_S) -> Points:
    """f then g: h(t) = f(t) + g(t + f(t)). Breaks where f breaks, or where f arrives at a break of g.

    f is first-in-first-out, so its arrivals rise and are inverted by interpolation.
    """
    f, g = _spread(f, period), _spread(g, period)
    arrive = f[0] + f[1]
    first, last = arrive[0], arrive[-1]
    shifts = np.arange(np.floor(first / period), np.floor(last / period) + 1)
    breaks = (g[0][:-1][None] + shifts[:, None] * period).ravel()
    breaks = breaks[(breaks > first) & (breaks < last)]
    # Where arrivals stand still, both ends of the stretch are breaks of f already.
    at = np.unique(np.concatenate([f[0], np.interp(breaks, np.maximum.accumulate(arrive), f[0])]))
    val = value(f, np.minimum(at, np.nextafter(period, 0)), period)
    val[at >= period] = f[1][0]
    return _tidy(at, val + value(g, at + val, period))


def merge(f: Points, g: Points, period: float = DAY_S) -> tuple[Points, list[tuple[float, bool]]]:
    """The pointwise minimum, and from when on which is better: (time, f is no worse)."""
    f, g = _spread(f, period), _spread(g, period)
    at = np.unique(np.concatenate([f[0], g[0]]))
    a, b = np.interp(at, *f), np.interp(at, *g)
    d = a - b
    cross = np.flatnonzero(d[:-1] * d[1:] < 0)
    more = at[cross] + (at[cross + 1] - at[cross]) * d[cross] / (d[cross] - d[cross + 1])
    at = np.unique(np.concatenate([at, more]))
    a, b = np.interp(at, *f), np.interp(at, *g)
    switches: list[tuple[float, bool]] = []
    for k in range(len(at) - 1):
        middle = (at[k] + at[k + 1]) / 2
        better = bool(np.interp(middle, *f) <= np.interp(middle, *g) + 1e-9)
        if not switches or switches[-1][1] != better:
            switches.append((float(at[k]), better))
    return _tidy(at, np.minimum(a, b)), switches


def thin(f: Points, error: float) -> Points:
    """Fewer points, nowhere off by more than ``error`` (recursive splitting at the farthest point)."""
    at, val = f
    keep = np.zeros(len(at), bool)
    keep[[0, -1]] = True
    todo = [(0, len(at) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        line = val[i] + (val[j] - val[i]) * (at[i + 1 : j] - at[i]) / (at[j] - at[i])
        k = int(np.argmax(np.abs(line - val[i + 1 : j])))
        if abs(line[k] - val[i + 1 + k]) > error:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return at[keep], val[keep]


def bounds(f: Points, error: float) -> tuple[Points, Points]:
    """A lower and an upper function of few points, within twice the error of each other."""
    at, val = thin(f, error)
    off = np.interp(f[0], at, val) - f[1]
    return (at, val - max(0.0, off.max())), (at, val - min(0.0, off.min()))


def profile_to_ttf(starts: list[int], speeds_kmh: list[int], length_m: int, period: int = 86_400) -> Points:
    """Travel times of a vehicle that drives each moment at its interval's speed.

    The distance driven since time 0 is piecewise linear in time; who enters at t leaves when
    it has grown by the length. Exact where it bends: at interval starts, and at the times
    from which an interval's start is reached.
    """
    at = np.array([*starts, period], float)
    v = np.maximum(np.array(speeds_kmh, float), 1e-6) / 3.6
    laps = int(np.ceil(length_m / max(1e-9, float((np.diff(at) * v).sum())))) + 1
    times = np.concatenate([[0.0], *[at[1:] + k * period for k in range(laps + 1)]])
    driven = np.concatenate([[0.0], np.cumsum(np.tile(np.diff(at) * v, laps + 1))])
    enter = np.concatenate([at, np.interp(driven - length_m, driven, times)])
    enter = np.unique(enter[(enter >= 0) & (enter <= period)])
    leave = np.interp(np.interp(enter, times, driven) + length_m, driven, times)
    return _tidy(enter, leave - enter, 1e-7)


# Ranges of the speed model's parameters, fixed values of this model.
RANGES = {"a": (1.0, 10.0), "e": (0.0, 10.0), "theta": (0.0, 10.0)}
MIN_JAM, MAX_JAM = 50.0, 250.0


def lee_speed(density: np.ndarray, free_flow: float, p: np.ndarray) -> np.ndarray:
    a, e, theta, jam = p
    d = np.maximum(density, 0) / jam
    return free_flow * (1 - d**a) / (1 + e * d**theta)


def _feasible(p: np.ndarray, jam_min: float) -> np.ndarray:
    lo, hi = np.array([r[0] for r in RANGES.values()] + [jam_min]), np.array([r[1] for r in RANGES.values()] + [MAX_JAM])
    p = np.clip(p, lo, hi)
    # Stable shock waves: 2 e theta / (e + 1) - a + 1 <= 0; a is raised, else theta lowered.
    need = 2 * p[1] * p[2] / (p[1] + 1) + 1
    p[0] = min(hi[0], max(p[0], need))
    if need > hi[0] and p[1] > 0:
        p[2] = (p[0] - 1) * (p[1] + 1) / (2 * p[1])
    return p


def fit_speed_model(density: np.ndarray, speed: np.ndarray, free_flow: float, jam_min: float = MIN_JAM, steps: int = 200) -> np.ndarray:
    """Least squares for (a, e, theta, jam) within their ranges, by damped Gauss-Newton steps.

    The result is feasible and never worse than the start, the middle of the ranges.
    """
    jam_min = max(jam_min, MIN_JAM)
    p = _feasible(np.array([sum(r) / 2 for r in RANGES.values()] + [(jam_min + MAX_JAM) / 2]), jam_min)
    loss = lambda q: float(((lee_speed(density, free_flow, q) - speed) ** 2).sum())
    best, damp = loss(p), 1.0
    for _ in range(steps):
        r = lee_speed(density, free_flow, p) - speed
        h = 1e-5 * np.maximum(1, np.abs(p))
        jac = np.stack([(lee_speed(density, free_flow, p + h * (np.arange(4) == k)) - speed - r) / h[k] for k in range(4)], axis=1)
        g = jac.T @ r
        step = np.linalg.lstsq(jac.T @ jac + damp * np.eye(4), -g, rcond=None)[0]
        q = _feasible(p + step, jam_min)
        new = loss(q)
        if new < best - 1e-12:
            gain, p, best, damp = best - new, q, new, damp / 3
            if gain < 1e-5:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p


def _arrays(column: pa.Array) -> list[Points]:
    return [None if v is None else (np.array([p["at"] for p in v], float), np.array([p["val"] for p in v], float)) for v in column.to_pylist()]


FUNCTION = "array<struct<at:double,val:double>>"
_KIND = pa.list_(pa.struct([("at", pa.float64()), ("val", pa.float64())]))


def _listed(f: Points | None) -> list[dict] | None:
    return None if f is None else [{"at": float(a), "val": float(v)} for a, v in zip(*f, strict=True)]


def combined(pairs: DataFrame, key: str, how: str, period: float = DAY_S) -> DataFrame:
    """Rows (key, f, g) to (key, h): 'link' composes, 'merge' takes the minimum. Null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for f, g in zip(_arrays(b.column("f")), _arrays(b.column("g")), strict=True):
                h = None if f is None or g is None else link(f, g, period) if how == "link" else merge(f, g, period)[0]
                out.append(_listed(h))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, _KIND)], names=[key, "h"])

    return pairs.select(key, "f", "g").mapInArrow(run, f"{key} {pairs.schema[key].dataType.simpleString()}, h {FUNCTION}")


def calibrated(observations: DataFrame, key: str) -> DataFrame:
    """One fitted model per edge from rows (key, density, speed, free_flow): a, e, theta, jam, sse.

    A group is one edge's observations, which calibration bounds (1000 by default).
    """
    import pandas as pd

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d, s, v = rows["density"].to_numpy(float), rows["speed"].to_numpy(float), float(rows["free_flow"].iloc[0])
        p = fit_speed_model(d, s, v)
        sse = float(((lee_speed(d, v, p) - s) ** 2).sum())
        return pd.DataFrame([[keys[0], *map(float, p), sse]], columns=[key, "a", "e", "theta", "jam", "sse"])

    schema = f"{key} {observations.schema[key].dataType.simpleString()}, a double, e double, theta double, jam double, sse double"
    return observations.select(key, "density", "speed", "free_flow").groupBy(key).applyInPandas(run, schema)
