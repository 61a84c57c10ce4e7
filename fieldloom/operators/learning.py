"""A learned inverse operator from tessellated observations to fields.

The operator is linear with a ridge penalty: its normal equations are sums over rows, which tasks add up,
so training reads the data once whatever its size, and the driver solves a system of one grid's
cells. A deep network would be a local library inside a task; it is left out on purpose.

The same operator can be trained by mini-batches instead: a task takes the steps of many batches in a row, or many tasks add up the gradient of a large one. Every epoch's weights
are stored as tables, and the weights of the least validation loss are read again. Weights have the size of a grid's cells squared, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.basis import summed
from fieldloom.operators.batch import listed, map_fields, stacked
from fieldloom.operators.covariance import moments
from fieldloom.operators.metrics import running_best, weighted_loss
from fieldloom.operators.selection import in_batches
from fieldloom.sources import stores

DEALT = 1 << 20  # numbers of the rows that an epoch orders as one group


def normal_equations(rows: DataFrame, inputs: str = "cell_value", target: str = "field") -> tuple[np.ndarray, np.ndarray]:
    """(cells + 1, cells + 1) and (cells + 1, cells): sums over the rows of the widened inputs' products with themselves and with the target, in one pass."""
    widened = rows.select(F.concat(F.col(inputs), F.array(F.lit(1.0))).alias("_x"), F.concat(F.col(inputs), F.array(F.lit(1.0)), F.col(target)).alias("_y"))
    both = moments(widened, ("_x", "_y"))
    return both[:, : len(both)], both[:, len(both) :]


def ridge(xx: np.ndarray, xy: np.ndarray, penalty: float) -> np.ndarray:
    """(cells + 1, cells) coefficients, the last row the intercept, which has no penalty."""
    added = penalty * np.eye(len(xx))
    added[-1, -1] = 0
    return np.linalg.solve(xx + added, xy)


def fit_inverse(rows: DataFrame, penalty: float, inputs: str = "cell_value", target: str = "field") -> np.ndarray:
    """(cells + 1, cells) coefficients, the last row the intercept."""
    return ridge(*normal_equations(rows, inputs, target), penalty)


def inferred(rows: DataFrame, weights: np.ndarray, inputs: str = "cell_value", name: str = "x_v") -> DataFrame:
    """Adds the field inferred from tessellated observations; ``weights`` are of one grid's size."""

    def compute(n: int, x: np.ndarray) -> tuple[np.ndarray, ...]:
        return (x.reshape(len(x), -1) @ weights[:-1] + weights[-1],)

    return map_fields(rows, [inputs], {name: "array"}, compute)


def trained(train: DataFrame, validation: DataFrame, penalties: list[float]) -> tuple[np.ndarray, list[tuple[float, float, bool]]]:
    """The weights of the least validation loss, and (penalty, loss, improved) of each try in order; one pass over each part, however many penalties."""
    sums = normal_equations(train)
    every = [ridge(*sums, penalty) for penalty in penalties]
    best, weights, tries = np.inf, np.empty(0), []
    for penalty, w, loss in zip(penalties, every, losses(validation, every), strict=True):
        tries.append((penalty, loss, loss < best))
        if loss < best:
            best, weights = loss, w
    return weights, tries


def losses(rows: DataFrame, every: list[np.ndarray], inputs: str = "cell_value", target: str = "field") -> list[float]:
    """Mean over the rows of the mean squared error over their cells, for each of some weights, in one pass."""
    sent = rows.sparkSession.sparkContext.broadcast(every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (stacked(b.column(k), (len(b.column(k)[0]),)) for k in (0, 1))
                off = [((x @ w[:-1] + w[-1] - y) ** 2).mean(1).sum() for w in sent.value]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(off)), pa.int32()), pa.array(off), pa.array([b.num_rows] * len(off))], ["k", "off", "rows"])

    parts = rows.select(inputs, target).mapInArrow(run, "k int, off double, rows long")
    found = parts.groupBy("k").agg((F.sum("off") / F.sum("rows")).alias("loss")).collect()  # a row for each of the weights
    sent.destroy()
    return [loss for _, loss in sorted((r.k, r.loss) for r in found)]


def residuals(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds x_v and residual, the field less what is inferred."""
    return inferred(rows, weights).withColumn("residual", F.zip_with("field", "x_v", lambda a, b: a - b))


def loss_and_gradient(rows: DataFrame, weights: np.ndarray, inputs: str = "cell_value", target: str = "field") -> tuple[int, float, np.ndarray]:
    """Number of rows, mean squared error over their cells and its gradient in the weights; a task adds its rows up."""
    shape = weights.shape
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total = sent.value, np.zeros((shape[0] + 2, shape[1]))
        for b in batches:
            if b.num_rows:
                x = np.hstack([stacked(b.column(0), (shape[0] - 1,)), np.ones((b.num_rows, 1))])
                off = x @ w - stacked(b.column(1), (shape[1],))
                total[:-2] += 2 * x.T @ off
                total[-2] += (off * off).sum(0)
                total[-1] += b.num_rows
        yield pa.RecordBatch.from_arrays([listed(total.reshape(1, -1))], ["v"])

    total = summed(rows.select(inputs, target).mapInArrow(run, "v array<double>"), (shape[0] + 2, shape[1]))
    sent.destroy()
    n = int(total[-1, 0])
    return n, float(total[-2].sum() / max(1, n * shape[1])), total[:-2] / max(1, n * shape[1])


def _stepped(state: np.ndarray, gradient: np.ndarray, step: int, rate: float) -> np.ndarray:
    """(weights, first, second) after Adam's step number ``step``; moments' decay and the least divisor are the published method's own values."""
    first, second = 0.9 * state[1] + 0.1 * gradient, 0.999 * state[2] + 0.001 * gradient**2
    return np.stack([state[0] - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8), first, second])


def packed(dealt: DataFrame, inputs: str = "cell_value", target: str = "field") -> DataFrame:
    """batch, place and rows: for rows of one batch that lie next to each other, the first one's place and (inputs, 1, target) of each as doubles in one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (stacked(b.column(k), (len(b.column(k)[0]),)) for k in (2, 3))
                whole = np.hstack([x, np.ones((len(x), 1)), y])
                number, place = b.column(0).to_numpy(), b.column(1).to_numpy()
                first = np.flatnonzero(np.append(True, (np.diff(number) != 0) | (np.diff(place) != 1)))
                pieces = [whole[low:high].tobytes() for low, high in zip(first, [*first[1:], len(whole)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(number[first]), pa.array(place[first]), pa.array(pieces, pa.binary())], ["batch", "place", "rows"])

    return dealt.select("batch", "place", inputs, target).mapInArrow(run, "batch long, place long, rows binary")


def steps_in_order(pieces: DataFrame, state: np.ndarray, step: int, rate: float) -> tuple[int, int, float, np.ndarray]:
    """Number of rows and of steps, mean loss and the state after a step for each batch of ``packed`` rows, in order, from ``state`` after ``step`` steps; one task, which holds one batch."""
    cells, wide = state.shape[1], sum(state.shape[1:])
    sent = pieces.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, n, losses, open_batch, held = sent.value, 0, 0, 0.0, None, []

        def close() -> None:
            nonlocal now, done, n, losses
            rows = np.concatenate(held) if len(held) > 1 else held[0]
            x = rows[:, :cells]
            off = x @ now[0] - rows[:, cells:]
            done, n, losses = done + 1, n + len(x), losses + float((off * off).mean()) * len(x)
            now = _stepped(now, 2 * x.T @ off / off.size, step + done, rate)
            held.clear()

        for b in batches:
            for number, piece in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if held and number != open_batch:
                    close()
                open_batch = number
                held.append(np.frombuffer(piece.as_buffer()).reshape(-1, wide))
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([done]), pa.array([losses / max(1, n)]), listed(now.reshape(1, -1))], ["n", "steps", "loss", "state"])

    ordered = pieces.coalesce(1).sortWithinPartitions("batch", "place").select("batch", "rows")
    r = ordered.mapInArrow(run, "n long, steps long, loss double, state array<double>").first()
    sent.destroy()
    return r.n, r.steps, r.loss, np.array(r.state).reshape(state.shape)


def trained_by_batches(train: DataFrame, validation: DataFrame, folder: str, epochs: int, size: int, rate: float, ids: list[str], seed: int = 0, inputs: str = "cell_value", target: str = "field", most: int = 1 << 23) -> DataFrame:
    """(epoch, loss, validation, best, improved) of training by mini-batches with Adam's steps from zero weights.

    Each epoch deals the rows anew into batches of ``size``, by hashes of ``ids``, and writes them under ``folder``, a folder for each part: as many batches in a row as
    have at most ``most`` numbers. Rows are shuffled once for it and packed where they then lie, so that all but the steps themselves is done in many tasks.
    Steps follow each other, so a part is one task, which hands its weights and moments to the next part's; jobs grow with the parts, not with the batches.
    A batch of more numbers than half of ``most`` is a part of its own, and its gradient adds up in many tasks. The epoch's weights are kept under ``weights`` there, for ``best_weights``.
    """
    spark = train.sparkSession
    train.select(*ids, inputs, target).write.parquet(f"{folder}/rows")
    train = spark.read.parquet(f"{folder}/rows")
    widths, rows = train.select(F.size(inputs), F.size(target)).first(), train.count()
    state, step, history, checks = np.zeros((3, widths[0] + 1, widths[1])), 0, [], []
    per = max(1, most // (size * (widths[0] + widths[1])))
    parts, bins = -(-rows // (size * per)), 1 + rows * (widths[0] + widths[1]) // DEALT
    for epoch in range(epochs):
        place = f"{folder}/batches/{epoch}"
        dealt = in_batches(train, size, seed, epoch, [], *ids, bins=bins)
        dealt = packed(dealt, inputs, target) if per > 1 else dealt
        dealt.withColumn("part", F.floor(F.col("batch") / per)).write.partitionBy("part").parquet(place)
        dealt = spark.read.parquet(place)
        for part in range(parts):
            some = dealt.where(F.col("part") == part)
            if per > 1:
                n, steps, loss, state = steps_in_order(some, state, step, rate)
            else:
                n, loss, gradient = loss_and_gradient(some, state[0], inputs, target)
                steps, state = 1, _stepped(state, gradient, step + 1, rate)
            step += steps
            history.append((epoch, part, n, loss))
        stores.write_weights(spark, state[0], f"{folder}/weights/epoch={epoch}")
        checks.append((epoch, loss_and_gradient(validation, state[0], inputs, target)[1]))
    losses = weighted_loss(spark.createDataFrame(history, "epoch int, part int, n long, loss double"), ["epoch"])
    kept = running_best(spark.createDataFrame(checks, "epoch int, loss double"), [], "epoch").withColumnRenamed("loss", "validation")
    return losses.join(kept, "epoch")


def best_weights(history: DataFrame, folder: str) -> np.ndarray:
    """The weights stored after the last epoch that improved on all before it."""
    epoch = history.where("improved").agg(F.max("epoch")).first()[0]
    return stores.read_weights(history.sparkSession, f"{folder}/weights/epoch={epoch}")
