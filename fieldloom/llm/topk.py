"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are rows of integer term weights, a term being a component. Candidates are
ordered by the nearest of ``PIVOTS`` sampled vectors, then by id, and cut into blocks of a range of that order, so that a
block holds similar vectors where there are any; a block holds its
forward index (the rows' weights) and, for each term, the largest and the smallest
weight in it. For a query the sum over terms of weight times largest (or smallest, where
the query's weight is negative) bounds every score in a block. Blocks are visited in order
of that bound and scored through their forward index until a bound falls below the
k-th score; a block whose bound equals it is still visited, for ties.

Queries and blocks are dealt over a grid of shards and query groups, each cell being one
task's work; every shard returns its k best of each query and the best of those are
kept. Neither side is broadcast, and no pair of rows becomes a row. With n candidates and m queries a candidate is sent to
m / ``GROUP`` cells and a query to n / ``SHARD_ROWS``; only where there are fewer cells than tasks are groups smaller.

Defined results: ids or vectors that are null, and vectors with null or non-finite components
take no part; a shorter vector counts as padded with 0; ties go to the smaller id; candidates of
the query's own id are left out; repeated query rows each get their own ranks; with
fewer than k candidates all are returned; other columns are not read. Scores are exact while weights times weights
summed stay below 2**53; beyond that they are rounded, and beyond a long they are the largest or smallest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.shared import returning, shuffle_tasks

BLOCK = 128  # rows of a candidate block
GROUP = 8192  # queries of a group at most
SHARD_ROWS = 16_384  # candidate rows of a shard, about
PIVOTS = 256  # sampled vectors that order the candidates; the sample is of this size whatever the table's


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and weights (array of double) of the rows that take part."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~odd).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("weights"))


def quantized(scale: float) -> Column:
    return F.transform("weights", lambda x: F.floor(x * scale).cast("double"))


def _near(rows: DataFrame) -> DataFrame:
    """``rows`` with ``near``, the number of the most similar pivot (by cosine); which one it is matters for speed alone."""
    sample = [np.array(r.weights) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()]
    dim = max((len(v) for v in sample), default=0)
    pivots = np.stack([np.pad(v, (0, dim - len(v))) for v in sample]) if dim else np.zeros((1, 0))
    pivots = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-9)
    # Numbered so that each follows one that is similar: a block may hold the vectors of several.
    chain, left = [0], np.arange(len(pivots)) > 0
    while left.any():
        chain.append(int(np.where(left, pivots @ pivots[chain[-1]], -np.inf).argmax()))
        left[chain[-1]] = False
    pivots = pivots[chain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy(zero_copy_only=False)
            near = np.zeros(b.num_rows, dtype=np.int32)
            for n in np.unique(np.diff(offsets)):  # vectors of one length together
                some = np.flatnonzero(np.diff(offsets) == n)
                m = flat[offsets[some][:, None] + np.arange(n)][:, :dim]
                near[some] = (m @ pivots[:, : m.shape[1]].T).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(near)], ["vec_id", "weights", "near"])

    return rows.select("vec_id", "weights").mapInArrow(returning(run), "vec_id long, weights array<double>, near int")


def _packed(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """Blocks of ``size`` rows in the given order: name, dim, ids (int64) and weights (float64), row-major, and the extremes of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0

        def flush(own: np.ndarray, vectors: list[np.ndarray]) -> pa.RecordBatch:
            dim = max(len(v) for v in vectors)
            m = np.zeros((len(vectors), dim))
            for i, v in enumerate(vectors):
                m[i, : len(v)] = v
            row = (f"{own[0]}:{own[-1]}:{part}:{done}", dim, own.tobytes(), m.tobytes(), m.max(0).tobytes(), m.min(0).tobytes())
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], ["name", "dim", "ids", "weights", "most", "least"])

        held_ids: list[int] = []
        held: list[np.ndarray] = []
        for b in batches:
            offsets = b.column(1).offsets.to_numpy()
            flat = b.column(1).values.to_numpy(zero_copy_only=False)
            for i, own in enumerate(b.column(0).to_numpy()):
                held_ids.append(own)
                held.append(flat[offsets[i] : offsets[i + 1]])
                if len(held) == size:
                    yield flush(np.array(held_ids, dtype=np.int64), held)
                    held_ids, held, done = [], [], done + 1
        if held:
            yield flush(np.array(held_ids, dtype=np.int64), held)

    laid = rows.repartitionByRange(shuffle_tasks(rows.sparkSession), *order).sortWithinPartitions(*order).select("vec_id", "weights")
    return laid.mapInArrow(returning(run), "name string, dim int, ids binary, weights binary, most binary, least binary")


def _matrix(blobs: pd.Series, rows: list[int], dims: pd.Series, dim: int) -> list[np.ndarray]:
    out = []
    for blob, n, own in zip(blobs, rows, dims, strict=True):
        m = np.frombuffer(blob, np.float64).reshape(n, own)
        out.append(m if own == dim else np.pad(m, ((0, 0), (0, dim - own))))
    return out


def best_in_blocks(query: np.ndarray, own: int, bounds: np.ndarray, ids: list[np.ndarray], blocks: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids) of the k best rows, best first, and how many blocks were scored."""
    order = np.argsort(-bounds, kind="stable")
    scores, names = np.empty(0), np.empty(0, np.int64)
    at, step, seen = 0, 1, 0
    while at < len(order):
        floor = scores[k - 1] if len(scores) >= k else -np.inf
        if bounds[order[at]] < floor:
            break
        some = [j for j in order[at : at + step] if bounds[j] >= floor]
        seen += len(some)
        found = np.concatenate([blocks[j] @ query for j in some])
        named = np.concatenate([ids[j] for j in some])
        good = (found >= floor) & (named != own)
        scores, names = np.concatenate([scores, found[good]]), np.concatenate([names, named[good]])
        best = np.lexsort((names, -scores))[:k]
        scores, names = scores[best], names[best]
        at, step = at + step, step * 2
    return scores, names, seen


def cells(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_row, query_id, vec_id and score of each shard's best, with blocks (of the shard) and scored (of these, for the query)."""
    shards = max(1, -(-candidates.count() // SHARD_ROWS))
    asked = queries.count()
    groups = max(1, -(-asked // GROUP), min(-(-asked // 64), -(-shuffle_tasks(queries.sparkSession) // shards)))
    spread = lambda n: F.pmod(F.xxhash64("name"), F.lit(n)).cast("int")
    # Neighbours in the order go to different shards, so that each has something near every query and a bound early.
    right = _packed(_near(candidates), BLOCK, "near", "vec_id").withColumn("shard", spread(shards)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    left = _packed(queries, 64, "vec_id").withColumn("part", spread(groups)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    columns = {"query_row": "object", "query_id": "int64", "vec_id": "int64", "score": "int64", "blocks": "int32", "scored": "int32"}

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            dim = int(max(q.dim.max(), c.dim.max()))
            ids, asked = ([np.frombuffer(x, np.int64) for x in side.ids] for side in (c, q))
            blocks, one = _matrix(c.weights, [*map(len, ids)], c.dim, dim), [1] * len(c)
            most, least = np.concatenate(_matrix(c.most, one, c.dim, dim)), np.concatenate(_matrix(c.least, one, c.dim, dim))
            for name, own, vectors in zip(q.name, asked, _matrix(q.weights, [*map(len, asked)], q.dim, dim), strict=True):
                bounds = np.maximum(vectors, 0) @ most.T + np.minimum(vectors, 0) @ least.T
                for i, query in enumerate(vectors):
                    scores, names, seen = best_in_blocks(query, own[i], bounds[i], ids, blocks, k)
                    out += [(f"{name}:{i}", int(own[i]), int(n), min(max(int(s), -(2**63)), 2**63 - 1), len(c), seen) for s, n in zip(scores, names, strict=True)]
        return pd.DataFrame(out, columns=[*columns]).astype(columns)

    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(score, "query_row string, query_id long, vec_id long, score long, blocks int, scored int")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score; both inputs have vec_id and integral ``weights``."""
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    ranked = cells(queries, candidates, k).withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
