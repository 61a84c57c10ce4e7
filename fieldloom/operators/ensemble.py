"""Ensembles of vorticity runs as a source of field stacks: a row for each run in, a row for each snapshot out.

A run is advanced by an additive Runge-Kutta method, damping implicit and all else explicit, under step
control; its states are interpolated to a uniform time grid once the spin-up is over. Runs are
independent rows, so an ensemble is as parallel as it has runs; ``stepped`` advances every
snapshot of a stack by one step instead.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from fractions import Fraction as R

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldloom.functions.grids import ORDER, hyperviscosity
from fieldloom.operators.batch import map_fields
from fieldloom.operators.spectral import waves

# The published additive Runge-Kutta pair of order 4 with 6 stages (explicit and implicit rows, weights, weights of order 3).
EXPLICIT = [
    [],
    [R(1, 2)],
    [R(13861, 62500), R(6889, 62500)],
    [R(-116923316275, 2393684061468), R(-2731218467317, 15368042101831), R(9408046702089, 11113171139209)],
    [R(-451086348788, 2902428689909), R(-2682348792572, 7519795681897), R(12662868775082, 11960479115383), R(3355817975965, 11060851509271)],
    [R(647845179188, 3216320057751), R(73281519250, 8382639484533), R(552539513391, 3454668386233), R(3354512671639, 8306763924573), R(4040, 17871)],
]
IMPLICIT = [
    [],
    [R(1, 4)],
    [R(8611, 62500), R(-1743, 31250)],
    [R(5012029, 34652500), R(-654441, 2922500), R(174375, 388108)],
    [R(15267082809, 155376265600), R(-71443401, 120774400), R(730878875, 902184768), R(2285395, 8070912)],
    [R(82889, 524892), R(0), R(15625, 83664), R(69875, 102672), R(-2260, 8211)],
]
WEIGHTS = [R(82889, 524892), R(0), R(15625, 83664), R(69875, 102672), R(-2260, 8211), R(1, 4)]
LOWER = [R(4586570599, 29645900160), R(0), R(178811875, 945068544), R(814220225, 1159782912), R(-3700637, 11593932), R(61727, 225920)]
DIAGONAL = 0.25

TOLERANCE, FIRST_STEP, LIMIT = 0.1, 1e-5, 1.5e5


class Dynamics:
    """Tendency, damping and wind forcing of one grid size and set of parameters, on stacks (..., n, n) of spectral fields."""

    def __init__(self, n: int, beta: float, drag: float, tau0: float, nu: float | None = None) -> None:
        self.n, self.beta, self.drag = n, beta, drag
        k = waves(n)
        k2 = k[:, None] ** 2 + k[None, :] ** 2
        self.inverse = np.divide(-1.0, k2, out=np.zeros_like(k2), where=k2 > 0)
        self.damping = -(hyperviscosity(n, tau0=tau0) if nu is None else nu) * k2**ORDER
        y = -np.pi + np.arange(n) * 2 * np.pi / n
        self.wind = -1j * k[:, None] * np.fft.fft2(np.repeat(tau0 * np.sin(y)[:, None] ** 2, n, axis=1))
        self.dx = 1j * waves(n, derivative=True)
        h, m = n // 2, 3 * n // 2
        self.at = np.ix_(np.r_[0 : h + 1, m - h + 1 : m], np.r_[0 : h + 1, m - h + 1 : m])
        self.wide, self.m = 1j * waves(m, derivative=True), m

    def _physical(self, spectral: np.ndarray, factor: np.ndarray) -> np.ndarray:
        out = np.zeros((*spectral.shape[:-2], self.m, self.m), dtype=complex)
        out[(..., *self.at)] = spectral * 9 / 4
        return np.fft.ifft2(out * factor).real

    def tendency(self, q: np.ndarray) -> np.ndarray:
        psi, dx, dy = self.inverse * q, self.wide[None, :], self.wide[:, None]
        product = self._physical(psi, -dy) * self._physical(q, dx) + self._physical(psi, dx) * self._physical(q, dy)
        return -self.beta * self.dx * psi - self.drag * q - np.fft.fft2(product)[(..., *self.at)] * 4 / 9 + self.wind

    def step(self, q: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
        """(state after dt, error estimate of each field of the stack)."""
        solve = 1 / (1 - DIAGONAL * dt * self.damping)
        explicit, implicit = [], []
        for row_e, row_i in zip(EXPLICIT, IMPLICIT, strict=True):
            stage = q + dt * sum((float(a) * k for a, k in zip(row_e, explicit, strict=True)), start=np.zeros_like(q)) + dt * sum((float(a) * k for a, k in zip(row_i, implicit, strict=True)), start=np.zeros_like(q))
            stage = stage if not explicit else solve * stage
            explicit.append(self.tendency(stage))
            implicit.append(self.damping * stage)
        slopes = [a + b for a, b in zip(explicit, implicit, strict=True)]
        error = np.fft.ifft2(sum(float(w - v) * s for w, v, s in zip(WEIGHTS, LOWER, slopes, strict=True)))
        new = q + dt * sum(float(w) * s for w, s in zip(WEIGHTS, slopes, strict=True))
        return np.fft.fft2(np.fft.ifft2(new).real), dt * np.abs(error).max((-2, -1))


def stepped(fields: DataFrame, dt: float, beta: float = 1.0, drag: float = 0.1, tau0: float = 0.1, nu: float = 0.0) -> DataFrame:
    """Adds next, each field advanced by dt, and error, its estimate."""

    def compute(n: int, x: np.ndarray) -> tuple[np.ndarray, ...]:
        new, error = Dynamics(n, beta, drag, tau0, nu).step(np.fft.fft2(x), dt)
        return np.fft.ifft2(new).real, error

    return map_fields(fields, ["field"], {"next": "array", "error": "double"}, compute)


def snapshots(dynamics: Dynamics, seed: int, spinup: float, interval: float, count: int, most_steps: int) -> Generator[tuple[float, np.ndarray], None, str]:
    """(time, field) of ``count`` uniform times after the spin-up; fewer if the run diverges or ``most_steps`` pass. Returns how it ended: complete, diverged or steps."""
    n = dynamics.n
    field = 0.01 * np.random.default_rng(seed).standard_normal((n, n))
    q, t, dt, before = np.fft.fft2(field - field.mean()), 0.0, FIRST_STEP, 0.8 * TOLERANCE
    tick, given = None, 0
    for _ in range(most_steps):
        new, r = dynamics.step(q, dt)
        r = float(r)
        if not np.isfinite(r):
            return "diverged"
        if r > TOLERANCE:
            dt *= 0.75
            continue
        then = t + dt
        if tick is None and (spinup <= 0 or then > spinup):
            tick = 0 if spinup <= 0 else int(np.ceil(then / interval))
        while tick is not None and tick * interval <= then and given < count:
            if tick * interval >= t:
                alpha = (tick * interval - t) / (then - t)
                yield tick * interval, np.fft.ifft2((1 - alpha) * q + alpha * new).real
                given += 1
            tick += 1
        dt *= (0.75 * TOLERANCE / max(r, 1e-300)) ** (0.3 / 4) * (before / max(r, 1e-300)) ** (0.4 / 4)
        q, t, before = new, then, max(r, 1e-300)
        if given >= count:
            return "complete"
        if np.abs(np.fft.ifft2(q).real).max() > LIMIT:
            return "diverged"
    return "steps"


def simulated(manifest: DataFrame, spinup: float, interval: float, count: int, beta: float = 1.0, drag: float = 0.1, nu: float | None = None, seed: int = 0, most_steps: int = 2_000_000) -> DataFrame:
    """run, t, time, n, field, status: the snapshots of each row (run, n, tau0) of a manifest.

    A run that gives fewer than ``count`` ends with a row without time and field whose status says why, diverged or steps; in all other rows it is null.
    """
    kinds = [manifest.schema["run"].dataType.simpleString(), "int", "double", "int", "array<double>", "string"]
    names = ["run", "t", "time", "n", "field", "status"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (n, tau0) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                own, dynamics = b.column(0).slice(k, 1), Dynamics(n, beta, drag, tau0, nu)
                row = lambda t, time, field, status: pa.RecordBatch.from_arrays([own, pa.array([t], pa.int32()), pa.array([time], pa.float64()), pa.array([n], pa.int32()), pa.array([field], pa.list_(pa.float64())), pa.array([status], pa.string())], names)
                found, t = snapshots(dynamics, seed, spinup, interval, count, most_steps), 0
                while True:
                    try:
                        time, field = next(found)
                    except StopIteration as end:
                        if end.value != "complete":
                            yield row(t, None, None, end.value)
                        break
                    yield row(t, time, field.ravel(), None)
                    t += 1

    rows = manifest.select("run", "n", "tau0")
    runs = rows.repartition(max(1, manifest.count()), "run")
    return runs.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(names, kinds, strict=True)))
