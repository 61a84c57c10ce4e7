"""Pieces of DuckDB SQL that the registered queries' SQL is made of."""

from __future__ import annotations

CELLS = "cells AS (SELECT label AS run, vec_id AS t, CAST((p - 1) // 8 AS INTEGER) AS i, CAST((p - 1) % 8 AS INTEGER) AS j, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS p))"
TWIDDLES = "tw AS (SELECT CAST(a.k AS INTEGER) AS k, CAST(b.m AS INTEGER) AS m, cos(2 * pi() * ((a.k * b.m) % 8) / 8) AS c, -sin(2 * pi() * ((a.k * b.m) % 8) / 8) AS s FROM range(8) a(k), range(8) b(m))"
WAVES = """ax AS (SELECT CAST(x AS INTEGER) AS x, CASE WHEN x <= 4 THEN x ELSE x - 8 END AS k, CASE WHEN x = 4 THEN 0 WHEN x < 4 THEN x ELSE x - 8 END AS d FROM range(8) r(x)),
wg AS (SELECT a.x AS ki, b.x AS kj, CAST(a.k AS DOUBLE) AS ky, CAST(b.k AS DOUBLE) AS kx, CAST(a.d AS DOUBLE) AS dky, CAST(b.d AS DOUBLE) AS dkx, sqrt(CAST(a.k * a.k + b.k * b.k AS DOUBLE)) AS k FROM ax a, ax b)"""
GRID = "grid AS (SELECT CAST(p // 8 AS INTEGER) AS i, CAST(p % 8 AS INTEGER) AS j FROM range(64) r(p))"
MANIFEST = "manifest AS (SELECT label AS run, 0.1::DOUBLE + 0.05::DOUBLE * label AS tau0, CASE WHEN label = (SELECT max(label) FROM embeddings) THEN 'test' ELSE 'train' END AS split, 8 AS n, count(*) AS snapshots FROM embeddings GROUP BY label)"
SERIES = "series AS (SELECT event_type AS run, epoch_us(ts) AS us, event_id AS id, value AS v FROM events)"
#: Estimates by cell: truth, the run's snapshot before, and fields between them.
PAIRS = """prev AS (SELECT run, t, i, j, v AS x_true, lag(v) OVER (PARTITION BY run, i, j ORDER BY t) AS x_b FROM cells),
pairs AS (SELECT *, 0.25::DOUBLE * x_true + 0.75::DOUBLE * x_b AS x_v, 0.5::DOUBLE * x_true + 0.5::DOUBLE * x_b AS x_da, 0.75::DOUBLE * x_true + 0.25::DOUBLE * x_b AS x_3 FROM prev WHERE x_b IS NOT NULL),
est AS (SELECT run, t, i, j, x_true, method, x_est FROM (SELECT run, t, i, j, x_true, x_b AS background, x_v AS inverse, x_3 AS three_term, x_da AS variational FROM pairs) UNPIVOT (x_est FOR method IN (background, inverse, three_term, variational)))"""
RRMSE = "scores AS (SELECT run, t, method, sqrt(sum((x_est - x_true) ** 2)) / nullif(sqrt(sum(x_true ** 2)), 0) AS rrmse FROM est GROUP BY ALL)"
WIDE = "wide AS (SELECT run, t, max(rrmse) FILTER (WHERE method = 'background') AS background, max(rrmse) FILTER (WHERE method = 'inverse') AS inverse, max(rrmse) FILTER (WHERE method = 'three_term') AS three_term FROM scores GROUP BY run, t)"


def dft(source: str, out: str) -> str:
    """CTEs: ``out`` (run, t, ki, kj, re, im) of ``source`` (run, t, i, j, v)."""
    return f"""{out}_rows AS (SELECT run, t, i, tw.k AS kj, sum(v * c) AS a, sum(v * s) AS b FROM {source} JOIN tw ON j = m GROUP BY ALL),
{out} AS (SELECT run, t, tw.k AS ki, kj, sum(a * c - b * s) AS re, sum(a * s + b * c) AS im FROM {out}_rows JOIN tw ON i = m GROUP BY ALL)"""


def idft(source: str, out: str) -> str:
    """CTEs: ``out`` (run, t, i, j, v), the real part of the inverse transform of ``source``."""
    return f"""{out}_rows AS (SELECT run, t, ki, tw.k AS j, sum(re * c + im * s) AS a, sum(im * c - re * s) AS b FROM {source} JOIN tw ON kj = m GROUP BY ALL),
{out} AS (SELECT run, t, tw.k AS i, j, sum(a * c + b * s) / 64 AS v FROM {out}_rows JOIN tw ON ki = m GROUP BY ALL)"""


def shells(source: str, keys: str, values: dict[str, str], scale: str, digits: int = 8) -> str:
    """SELECT of keys, k and shell sums; ``source`` has k and what ``values`` (name: expression) names."""
    sums = ", ".join(f"round({scale} * sum(w * {x}), {digits}) + 0.0 AS {name}" for name, x in values.items())
    inside = f"SELECT *, floor(k) AS shell, 1 - (k - floor(k)) AS w FROM {source} WHERE ceil(k) <= 4 UNION ALL SELECT *, ceil(k) AS shell, k - floor(k) AS w FROM {source} WHERE ceil(k) <= 4"
    return f"SELECT {keys}, CAST(shell AS INTEGER) AS k, {sums} FROM ({inside}) GROUP BY {keys}, shell"


def uniform(*keys: str) -> str:
    text = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"((CAST(concat('0x', substr(md5({text}), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def sensors(per_side: int, radius: float) -> str:
    """CTE sensors (run, t, sid, si, sj) of every snapshot on the 8 by 8 grid."""
    u = lambda salt: uniform("label", "vec_id", "sid", "0", str(salt))
    step = f"(7::DOUBLE / {per_side - 1})"
    at = lambda lattice, turn: f"CAST(greatest(0.0, least(7.0, round_even({lattice} * {step} + {radius}::DOUBLE * sqrt({u(1)}) * {turn}(2 * pi() * {u(0)}), 0))) AS INTEGER)"
    return f"sensors AS (SELECT label AS run, vec_id AS t, CAST(sid AS INTEGER) AS sid, {at(f'(sid // {per_side})', 'cos')} AS si, {at(f'(sid % {per_side})', 'sin')} AS sj FROM embeddings CROSS JOIN (SELECT unnest(range({per_side * per_side})) AS sid))"


#: Matern spectrum on the 8 by 8 grid with length 2 (CTE sk: ki, kj, sk).
SK = f"""kern AS (SELECT 0 AS run, 0 AS t, i, j, (1 + r / 2) * exp(-r / 2) AS v FROM (SELECT i, j, sqrt(CAST(least(i, 8 - i) ** 2 + least(j, 8 - j) ** 2 AS DOUBLE)) AS r FROM grid)),
{dft("kern", "kern_hat")},
sk AS (SELECT ki, kj, greatest(re, 0) AS sk FROM kern_hat)"""
TAPER = "CASE WHEN {r} < 1 THEN 1 - 5.0::DOUBLE / 3 * {r} ** 2 + 5.0::DOUBLE / 8 * {r} ** 3 + 0.5::DOUBLE * {r} ** 4 - 0.25::DOUBLE * {r} ** 5 WHEN {r} < 2 THEN 4 - 5 * {r} + 5.0::DOUBLE / 3 * {r} ** 2 + 5.0::DOUBLE / 8 * {r} ** 3 - 0.5::DOUBLE * {r} ** 4 + 1.0::DOUBLE / 12 * {r} ** 5 - 2.0::DOUBLE / 3 / {r} ELSE 0 END"


def taper(r: str) -> str:
    return TAPER.format(r=f"({r})")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
