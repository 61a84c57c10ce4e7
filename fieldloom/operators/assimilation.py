"""Variational analysis of snapshots: cost terms, a limited-memory quasi-Newton minimiser, and its three forms.

A snapshot is a row with its background, sensors and observations; snapshots are independent, so rows are
analysed where they lie, those of a batch together. Gradients are closed forms.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from types import EllipsisType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.operators.batch import map_fields
from fieldloom.operators.covariance import correlation_spectrum
from fieldloom.operators.sensors import disk, local_sum
from fieldloom.sources.tables import total

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]
Rows = np.ndarray | EllipsisType
Objectives = Callable[..., tuple[np.ndarray, np.ndarray]]  # of fields (rows, cells) and, if these are some of all rows, their numbers
TOGETHER = 1 << 14  # cells of the fields that are minimised together


def background_term(pairs: DataFrame, spectrum: np.ndarray, eps: float = 1e-8, x: str = "x_est", x_b: str = "x_b") -> DataFrame:
    """Adds j_b, half the squared distance of two fields in a stationary covariance's metric."""
    weight = 1 / (spectrum + eps * spectrum.max())

    def compute(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        return (0.5 * (np.abs(np.fft.fft2(a - b)) ** 2 * weight).sum((1, 2)) / n**2,)

    return map_fields(pairs, [x, x_b], {"j_b": "double"}, compute)


def observation_term(y: str, hx: str, std: float):
    """Half the squared misfit over the error variance, as a column."""
    return 0.5 * total(F.zip_with(y, hx, lambda a, b: (a - b) * (a - b))) / (std**2 + 1e-12)


def minimised(objective: Objectives, x: np.ndarray, rounds: int = 200, tolerance: float = 1e-6, relative: float = 2.2e-9, memory: int = 10) -> tuple[np.ndarray, np.ndarray, list[list[float]]]:
    """(x, iterations, costs at every evaluation) of the rows of ``x``, each minimised on its own: all step together, and those that are done drop out.

    A row stops at a small gradient, a small relative decrease, or after ``rounds``. ``objective`` gets fields and the numbers of their rows.
    """
    ids, out, iterations = np.arange(len(x)), x.copy(), np.full(len(x), rounds)
    cost, gradient = objective(x, ids)
    history, kept = [[c] for c in cost.tolist()], deque(maxlen=memory)  # kept: s, y, both over their product, and the step's size, of all rows; zeros where a row has none

    def settle(rows: np.ndarray, done: int | np.ndarray) -> None:
        """Notes down ``rows`` and goes on with the others."""
        nonlocal ids, x, cost, gradient
        out[ids[rows]], iterations[ids[rows]] = x[rows], done
        ids, x, cost, gradient = (v[~rows] for v in (ids, x, cost, gradient))
        for k, pair in enumerate(kept):
            kept[k] = tuple(v[~rows] for v in pair)

    for done in range(rounds):
        if (small := np.abs(gradient).max(1) <= tolerance).any():
            settle(small, done)
        if not len(ids):
            break
        # Two-loop recursion over the kept steps.
        d, alphas, part = -gradient, [], np.empty_like(gradient)
        for _, y, over_s, _, _ in reversed(kept):
            alphas.append(_dot(over_s, d))
            d -= np.multiply(alphas[-1][:, None], y, out=part)
        size = 1 / np.maximum(1.0, np.sqrt(_dot(gradient, gradient)))
        d *= (np.where(kept[-1][4] > 0, kept[-1][4], size) if kept else size)[:, None]
        for (s, _, _, over_y, _), alpha in zip(kept, reversed(alphas), strict=True):
            d += np.multiply((alpha - _dot(over_y, d))[:, None], s, out=part)
        slope = _dot(gradient, d)
        if (up := slope >= 0).any():
            for pair in kept:
                for v in pair:
                    v[up] = 0
            d[up], slope[up] = -gradient[up], -_dot(gradient[up], gradient[up])
        step, low, high, left = np.ones(len(ids)), np.zeros(len(ids)), np.full(len(ids), np.inf), np.arange(len(ids))
        tried, new_cost, new_gradient = step.copy(), cost.copy(), gradient.copy()
        for _ in range(40):  # bisection for the weak Wolfe conditions
            tried[left] = step[left]
            c, g = objective(x[left] + step[left, None] * d[left], ids[left])
            new_cost[left], new_gradient[left] = c, g
            for k, v in zip(ids[left].tolist(), c.tolist(), strict=True):
                history[k].append(v)
            far = ~np.isfinite(c) | (c > cost[left] + 1e-4 * step[left] * slope[left])
            near = ~far & (_dot(g, d[left]) < 0.9 * slope[left])
            high[left[far]], low[left[near]] = step[left[far]], step[left[near]]
            left = left[far | near]
            if not len(left):
                break
            step[left] = np.where(np.isfinite(high[left]), (low[left] + high[left]) / 2, 2 * step[left])
        s, y = tried[:, None] * d, new_gradient - gradient
        sy, yy = _dot(s, y), _dot(y, y)
        curved = sy > 1e-12 * yy
        rho, size = (np.divide(a, b, out=np.zeros_like(sy), where=curved) for a, b in ((1.0, sy), (sy, yy)))
        new = (s, y, rho[:, None] * s, rho[:, None] * y, size)
        if curved.all():
            kept.append(new)
        else:  # a row without a new step keeps all it has
            kept.extendleft([tuple(np.zeros_like(v) for v in new)] * (memory - len(kept)))
            later = [*list(kept)[1:], new]
            kept.extend([tuple(np.where(curved if a.ndim == 1 else curved[:, None], b, a) for a, b in zip(*both, strict=True)) for both in zip(list(kept), later, strict=True)])
        decrease = (cost - new_cost) / np.maximum(np.maximum(np.abs(cost), np.abs(new_cost)), 1.0)
        risen = new_cost > cost
        x, cost, gradient = np.where(risen[:, None], x, x + s), new_cost, new_gradient
        if (over := risen | (decrease <= relative)).any():
            settle(over, np.where(risen, done, done + 1)[over])
    out[ids] = x
    return out, iterations, history


def minimise(objective: Objective, x: np.ndarray, rounds: int = 200, tolerance: float = 1e-6, relative: float = 2.2e-9, memory: int = 10) -> tuple[np.ndarray, int, list[float]]:
    """The same for a single field."""

    def one(fields: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cost, gradient = objective(fields[0])
        return np.array([cost]), gradient[None]

    found, iterations, history = minimised(one, x[None], rounds, tolerance, relative, memory)
    return found[0], int(iterations[0]), history[0]


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, each to the bit what ``@`` gives for it alone: rounds that end before the minimum carry a last bit's difference far."""
    return (a[..., None, :] @ b[..., None])[..., 0, 0]


def quadratic(centre: np.ndarray, weight: np.ndarray) -> Objectives:
    """Half the squared distance to a field in a metric that Fourier modes diagonalise."""
    n = len(weight)

    def term(x: np.ndarray, rows: Rows = ...) -> tuple[np.ndarray, np.ndarray]:
        d = x - centre[rows]
        g = np.fft.ifft2(np.fft.fft2(d.reshape(*d.shape[:-1], n, n)) * weight).real.reshape(d.shape)
        return 0.5 * (d * g).sum(-1), g

    return term


def dense(centre: np.ndarray, inverse: np.ndarray) -> Objectives:
    """The same in the metric of a matrix."""
    even = 0.5 * (inverse + inverse.T)

    def term(x: np.ndarray, rows: Rows = ...) -> tuple[np.ndarray, np.ndarray]:
        d = x - centre[rows]
        g = (even @ d[..., None])[..., 0]
        return 0.5 * _dot(d, g), g

    return term


def observation(n: int, at: np.ndarray, y: np.ndarray, std: float, nonlinear: bool) -> Objectives:
    """Half the squared misfit at sensors ``at``, of the field itself or of its local sums of squares."""
    kernel, scale = 0.5 * disk(n, 3.0) + disk(n, 1.5), std**2 + 1e-12

    def near(x: np.ndarray) -> np.ndarray:
        return local_sum(x.reshape(*x.shape[:-1], n, n), kernel).reshape(x.shape)

    def term(x: np.ndarray, rows: Rows = ...) -> tuple[np.ndarray, np.ndarray]:
        seen, here = near(x * x) if nonlinear else x, at[rows]
        miss = y[rows] - np.take_along_axis(seen, here, -1)
        cells = here + n * n * np.arange(x.size // (n * n)).reshape(*x.shape[:-1], 1)
        back = np.bincount(cells.ravel(), (miss / scale).ravel(), x.size).reshape(x.shape)
        return 0.5 * _dot(miss, miss) / scale, -(2 * x * near(back) if nonlinear else back)

    return term


def added(*terms: Objectives) -> Objectives:
    def both(x: np.ndarray, rows: Rows = ...) -> tuple[np.ndarray, np.ndarray]:
        found = [f(x, rows) for f in terms]
        return sum(f[0] for f in found), sum(f[1] for f in found)

    return both


def _solve(rows: DataFrame, inputs: list[str], solver: Callable[..., tuple[np.ndarray, np.ndarray, list[list[float]]]], name: str) -> DataFrame:
    """``rows`` with name, name_iterations and name_cost (the cost at every evaluation); ``solver`` gets the side and stacks of rows with as many sensors each."""
    added_fields = [T.StructField(name, T.ArrayType(T.DoubleType())), T.StructField(f"{name}_iterations", T.IntegerType()), T.StructField(f"{name}_cost", T.ArrayType(T.DoubleType()))]
    schema, names = T.StructType([*rows.schema.fields, *added_fields]), rows.columns

    def solved(b: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
        """Rows' places in the batch and what is found for them, in no order."""
        alike = defaultdict(list)
        for k, (n, sensors) in enumerate(zip(b.column(names.index("n")).to_pylist(), b.column(names.index("si")).value_lengths().to_pylist(), strict=True)):
            alike[n, sensors].append(k)
        for (n, _), places in alike.items():
            part = b.take(pa.array(places))
            stacks = [np.array(part.column(names.index(c)).to_pylist(), np.int64 if c in ("si", "sj") else np.float64) for c in inputs]
            yield from zip(places, zip(*solver(n, *stacks), strict=True), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            a = 0
            while a < whole.num_rows:
                b = whole.slice(a, max(1, TOGETHER // whole.column(names.index("n"))[a].as_py() ** 2))
                a += b.num_rows
                found = [f for _, f in sorted(solved(b), key=lambda x: x[0])]
                out = [pa.array([f[0] for f in found], pa.list_(pa.float64())), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *out], [*names, *[f.name for f in added_fields]])

    return rows.mapInArrow(run, schema)


def analysed(rows: DataFrame, length: float, std_b: float, std_o: float, nonlinear: bool = False, rounds: int = 200, name: str = "x_da") -> DataFrame:
    """Adds the two-term analysis of x_b with observations y at sensors si, sj, starting at x_b."""

    def solver(n: int, x_b: np.ndarray, si: np.ndarray, sj: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[float]]]:
        s = correlation_spectrum(n, length) * std_b**2
        return minimised(added(quadratic(x_b, 1 / (s + 1e-8 * s.max())), observation(n, si * n + sj, y, std_o, nonlinear)), x_b, rounds)

    return _solve(rows, ["x_b", "si", "sj", "y"], solver, name)


def analysed_with_inverse(rows: DataFrame, length: float, std_b: float, std_o: float, p_inverse: np.ndarray | None = None, p_spectrum: np.ndarray | None = None, nonlinear: bool = False, rounds: int = 200, name: str = "x_3") -> DataFrame:
    """Adds the three-term analysis with the inverse operator's x_v, its error a matrix's inverse or a stationary spectrum; starts midway."""

    def solver(n: int, x_b: np.ndarray, x_v: np.ndarray, si: np.ndarray, sj: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[float]]]:
        s = correlation_spectrum(n, length) * std_b**2
        third = dense(x_v, p_inverse) if p_inverse is not None else quadratic(x_v, 1 / (p_spectrum + 1e-8 * p_spectrum.max()))
        terms = added(quadratic(x_b, 1 / (s + 1e-8 * s.max())), third, observation(n, si * n + sj, y, std_o, nonlinear))
        return minimised(terms, 0.5 * (x_b + x_v), rounds)

    return _solve(rows, ["x_b", "x_v", "si", "sj", "y"], solver, name)


def analysed_reduced(rows: DataFrame, basis: np.ndarray, var_b: np.ndarray, var_v: np.ndarray, std_o: float, name: str = "x_r") -> DataFrame:
    """Adds the analysis in a reduced basis with diagonal covariances; the cost is quadratic, so its minimum is solved for directly."""

    def solver(n: int, x_b: np.ndarray, x_v: np.ndarray, si: np.ndarray, sj: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[int], list[list[float]]]:
        h, b, v, scale = basis[si * n + sj], x_b @ basis, x_v @ basis, std_o**2 + 1e-12
        wb, wv, back = 1 / (var_b + 1e-12), 1 / (var_v + 1e-12), h.swapaxes(1, 2)

        def cost(z: np.ndarray) -> np.ndarray:
            miss = y - (h @ z[..., None])[..., 0]
            return 0.5 * (wb * (z - b) ** 2).sum(1) + 0.5 * (wv * (z - v) ** 2).sum(1) + 0.5 * (miss**2).sum(1) / scale

        z = np.linalg.solve(np.diag(wb + wv) + back @ h / scale, (wb * b + wv * v)[..., None] + back @ y[..., None] / scale)[..., 0]
        return z @ basis.T, [1] * len(z), np.stack([cost(0.5 * (b + v)), cost(z)], 1).tolist()

    return _solve(rows, ["x_b", "x_v", "si", "sj", "y"], solver, name)
