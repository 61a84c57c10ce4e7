"""Column expressions: kernels, tapers, distances, complex pairs, seeded uniforms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaspari_cohn(rho: Column) -> Column:
    """The fifth-order compactly supported taper: 1 at 0, 0 from 2 on. The coefficients are fixed values of the published function."""
    near = 1 - 5 / 3 * rho**2 + 5 / 8 * rho**3 + 1 / 2 * rho**4 - 1 / 4 * rho**5
    far = 4 - 5 * rho + 5 / 3 * rho**2 + 5 / 8 * rho**3 - 1 / 2 * rho**4 + 1 / 12 * rho**5 - 2 / 3 / rho
    return F.when(rho < 1, near).when(rho < 2, far).otherwise(0.0)


def matern32(r: Column, length: Column | float) -> Column:
    """Matern correlation of order 3/2."""
    return (1 + r / length) * F.exp(-r / length)


def sech2(x: Column) -> Column:
    return 1 / (F.cosh(x) * F.cosh(x))


def wrapped(d: Column, n: Column | int) -> Column:
    """Distance along a periodic axis of n cells."""
    return F.least(F.pmod(d, F.lit(n)), F.lit(n) - F.pmod(d, F.lit(n)))


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def abs2(re: Column, im: Column) -> Column:
    return re * re + im * im


def times(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """Product of two complex numbers, each a pair (re, im)."""
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def direction(y: Column, x: Column) -> Column:
    """atan(y / x), 0 where both are 0."""
    return F.when((x == 0) & (y == 0), 0.0).when(x == 0, F.signum(y) * (math.pi / 2)).otherwise(F.atan(y / x))


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) fixed by the keys: 52 bits of the MD5 of their text, so that other engines agree."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def wave(index: Column, n: Column | int) -> Column:
    """Wavenumber of a position in transform order: 0 .. n/2, then -n/2+1 .. -1."""
    return F.when(2 * index <= F.lit(n), index).otherwise(index - F.lit(n))


def wave_derivative(index: Column, n: Column | int) -> Column:
    """The same with 0 at n/2, where a real field's odd derivative has no partner."""
    return F.when(2 * index == F.lit(n), 0).otherwise(wave(index, n))
