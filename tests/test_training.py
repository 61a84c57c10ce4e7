"""Training by mini-batches against numpy on the same batches."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import learning, selection
from fieldloom.plans import queries as Q
from tests.compare import SMALL


def test_gradient_by_differences(spark):
    rng = np.random.default_rng(1)
    rows = [(0, t, 2, rng.standard_normal(4).tolist(), rng.standard_normal(4).tolist()) for t in range(7)]
    df = spark.createDataFrame(rows, "run int, t long, n int, cell_value array<double>, field array<double>").repartition(3)
    w = rng.standard_normal((5, 4))
    n, loss, gradient = learning.loss_and_gradient(df, w)
    off = np.array([[*r[3], 1.0] for r in rows]) @ w - np.array([r[4] for r in rows])
    assert n == 7 and loss == pytest.approx((off**2).mean())
    for i, j in [(0, 0), (4, 3), (2, 1)]:
        near = w.copy()
        near[i, j] += 1e-6
        assert (learning.loss_and_gradient(df, near)[1] - loss) / 1e-6 == pytest.approx(gradient[i, j], abs=1e-4)


def test_history_and_best_weights(spark, tmp_path):
    train, validation = Q.training(spark, SMALL)
    folder = str(tmp_path / "try")
    history = learning.trained_by_batches(train, validation, folder, 3, 150, 0.02, ["run", "t"])
    got = {r.epoch: r for r in history.collect()}
    x = {(r.run, r.t): (np.array([*r.cell_value, 1.0]), np.array(r.field)) for r in train.collect()}
    held = [(np.array([*r.cell_value, 1.0]), np.array(r.field)) for r in validation.collect()]
    w, first, second, step, kept = np.zeros((65, 64)), 0, 0, 0, {}
    for epoch in range(3):
        batches: dict = {}
        for r in selection.minibatches(train.select("run", "t"), 150, 0, epoch, [], "run", "t").collect():
            batches.setdefault(r.batch, []).append(x[r.run, r.t])
        losses = []
        for b in sorted(batches):
            a, y = (np.stack(z) for z in zip(*batches[b], strict=True))
            off = a @ w - y
            losses.append((len(a), (off**2).mean()))
            g = 2 * a.T @ off / off.size
            step += 1
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w = w - 0.02 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        a, y = (np.stack(z) for z in zip(*held, strict=True))
        kept[epoch] = (w, ((a @ w - y) ** 2).mean())
        assert len(losses) > 1 and sum(n for n, _ in losses) == len(x)
        assert got[epoch].loss == pytest.approx(sum(n * v for n, v in losses) / len(x), rel=1e-9)
        assert got[epoch].validation == pytest.approx(kept[epoch][1], rel=1e-9)
        assert got[epoch].best == pytest.approx(min(v for _, v in kept.values()), rel=1e-9)
    best = min(kept, key=lambda e: kept[e][1])
    np.testing.assert_allclose(learning.best_weights(history, folder), kept[best][0], rtol=1e-8, atol=1e-12)
    assert spark.read.parquet(f"{folder}/weights").groupBy("epoch").agg(F.count("*").alias("n")).where("n = 65").count() == 3


def test_jobs_do_not_grow_with_the_batches(spark, tmp_path):
    train, validation = (x.localCheckpoint() for x in Q.training(spark, SMALL))
    jobs, found = [], []
    for k, (size, most) in enumerate([(128, 1 << 23), (8, 1 << 23), (8, 8 * 128 * 5), (8, 1)]):
        spark.sparkContext.setJobGroup(f"training {k}", "")
        found.append(learning.trained_by_batches(train, validation, str(tmp_path / str(k)), 2, size, 0.01, ["run", "t"], most=most))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"training {k}")))
    spark.sparkContext.setJobGroup("after", "")
    assert jobs[1] <= jobs[0] + 4  # 57 batches an epoch, 4 before; a job each would be 100 more
    whole, cut, gradients = ([tuple(r) for r in x.orderBy("epoch").collect()] for x in found[1:])
    for other in (cut, gradients):
        np.testing.assert_allclose(np.array(other, float), np.array(whole, float), rtol=1e-9)
    w = [learning.best_weights(x, str(tmp_path / str(k + 1))) for k, x in enumerate(found[1:])]
    np.testing.assert_allclose(w[1], w[0], rtol=1e-7, atol=1e-11)
    np.testing.assert_allclose(w[2], w[0], rtol=1e-7, atol=1e-11)


def test_penalties_share_their_passes(spark):
    train, validation = (x.localCheckpoint() for x in Q.training(spark, SMALL))
    jobs = []
    for k, penalties in enumerate([[1.0], [0.1, 1.0, 10.0, 100.0]]):
        spark.sparkContext.setJobGroup(f"penalties {k}", "")
        weights, tries = learning.trained(train, validation, penalties)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"penalties {k}")))
    spark.sparkContext.setJobGroup("after", "")
    assert jobs[0] == jobs[1]
    x = np.array([[*r.cell_value, 1.0] for r in validation.collect()])
    y = np.array([r.field for r in validation.collect()])
    for penalty, loss, _ in tries:
        assert loss == pytest.approx(((x @ learning.fit_inverse(train, penalty) - y) ** 2).mean(), rel=1e-9)
    best = min(tries, key=lambda r: r[1])[0]
    np.testing.assert_allclose(weights, learning.fit_inverse(train, best), rtol=1e-9, atol=1e-12)


def test_rows_are_tessellated_after_the_split(spark):
    for part in Q.training(spark, SMALL):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_an_epoch_shuffles_rows_once(spark):
    train, _ = Q.training(spark, SMALL)
    name, rows = "spark.sql.autoBroadcastJoinThreshold", train.localCheckpoint().select("run", "t", "cell_value", "field")
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # as for rows that are many
    try:
        dealt = selection.minibatches(rows, 128, 0, 0, [], "run", "t")
        plan = dealt._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set(name, before)
    assert len(re.findall(r"\) Exchange\nInput.*field#", plan)) == 1


def test_packed_rows_and_groups_of_any_size(spark, tmp_path, monkeypatch):
    train, validation = (x.localCheckpoint() for x in Q.training(spark, SMALL))
    dealt = selection.in_batches(train, 16, 0, 0, [], "run", "t", bins=7).localCheckpoint()
    want = {(r.batch, r.place): [*r.cell_value, 1.0, *r.field] for r in dealt.collect()}
    got = {}
    for r in learning.packed(dealt).collect():
        for k, row in enumerate(np.frombuffer(r["rows"]).reshape(-1, 129).tolist()):
            got[r.batch, r.place + k] = row
    assert len(want) == train.count() and got == want
    found = []
    for dealt_at_once in (1 << 20, 1 << 10):
        monkeypatch.setattr(learning, "DEALT", dealt_at_once)
        history = learning.trained_by_batches(train, validation, str(tmp_path / str(dealt_at_once)), 2, 32, 0.01, ["run", "t"])
        found.append([tuple(r) for r in history.orderBy("epoch").collect()])
    np.testing.assert_allclose(np.array(found[1], float), np.array(found[0], float), rtol=1e-9)
