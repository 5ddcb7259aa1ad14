"""Autoencoders, stacked and alone: gradients by finite differences, steps against numpy, the stop rule on made-up curves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwise.operators import neural
from boxwise.operators.ml import split


def numeric(model, f, eps=1e-6):
    out = []
    for k, p in enumerate(model.parameters):
        g = np.zeros_like(p)
        for at in np.ndindex(p.shape):
            step = [np.zeros_like(q) for q in model.parameters]
            step[k][at] = eps
            up, down = f(model.moved(step)), f(model.moved([-s for s in step]))
            g[at] = (up - down) / (2 * eps)
        out.append(g)
    return out


@pytest.mark.parametrize(("act_enc", "act_dec", "cost", "tied"), [
    ("sigmoid", "sigmoid", "CE", True), ("sigmoid", "sigmoid", "jacobiCE", True), ("tanh", "linear", "MSE", False),
    ("softplus", "softplus", "MSE", True), ("rectifier", "tanh", "MSE", True), ("sigmoid", "linear", "jacobiMSE", False), ("tanh", "sigmoid", "CE", False),
])
def test_gradients_agree_with_finite_differences(act_enc, act_dec, cost, tied):
    rng = np.random.default_rng(0)
    x, noisy = rng.uniform(0.1, 0.9, (7, 4)), rng.uniform(0.1, 0.9, (7, 4))
    model = neural.started(4, 3, 2, tied, act_enc=act_enc, act_dec=act_dec, cost=cost, reg=0.3)
    got = model.loss_and_gradient(x, noisy)[1]
    for a, b in zip(got, numeric(model, lambda m: m.loss_and_gradient(x, noisy)[0]), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-4, atol=1e-5)


def test_network_gradient_agrees_with_finite_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 3, 9)
    net = neural.Network([(rng.normal(size=(4, 5)), rng.normal(size=5)), (rng.normal(size=(5, 3)), rng.normal(size=3))], "tanh")
    for a, b in zip(net.loss_and_gradient(x, y)[1], numeric(net, lambda m: m.loss_and_gradient(x, y)[0]), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-4, atol=1e-6)
    assert np.allclose(net.probabilities(x).sum(1), 1)


def frame(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(k, *map(float, rng.uniform(0, 1, 4))) for k in range(n)], "k bigint, a double, b double, c double, d double")


COLUMNS = ["a", "b", "c", "d"]


@pytest.mark.parametrize("noise", ["mask", "gaussian"])
def test_one_step_is_that_of_numpy_whatever_the_partitions(spark, noise):
    df = frame(spark, 50)
    model = neural.started(4, 3, 5)
    rows = neural.batched(df, COLUMNS, "k", 1)
    held = rows.toPandas()
    x, key = np.stack(held["_x"]), held["_key"].to_numpy()
    loss, gradient = model.loss_and_gradient(x, neural.corrupted(x, key, 0.3, noise, 2))
    want = model.moved([-0.1 * g / 50 for g in gradient])
    for parts in (1, 7):
        got, total, n = neural.autoencoder_step(rows.repartition(parts), model, 0.1, 0.3, noise, 2)
        assert n == 50 and total == pytest.approx(loss)
        for a, b in zip(got.parameters, want.parameters, strict=True):
            np.testing.assert_allclose(a, b, rtol=1e-10, atol=1e-12)


def test_corruption_has_its_rate_and_differs_by_epoch():
    key, x = np.arange(20_000), np.ones((20_000, 3))
    masked = neural.corrupted(x, key, 0.35, "mask", 1)
    assert masked.mean(0) == pytest.approx(0.65, abs=0.015) and not np.array_equal(masked, neural.corrupted(x, key, 0.35, "mask", 2))
    added = neural.corrupted(x, key, 0.5, "gaussian", 1) - 1
    assert added.mean() == pytest.approx(0, abs=0.02) and added.std() == pytest.approx(0.5, abs=0.02)
    assert abs(np.corrcoef(masked[:, 0], masked[:, 1])[0, 1]) < 0.03


def test_error_falls_and_hidden_values_are_those_of_the_model(spark):
    rng = np.random.default_rng(3)
    z = rng.uniform(0, 1, 300)
    df = spark.createDataFrame([(k, *[float(v if j % 2 else 1 - v) for j in range(4)]) for k, v in enumerate(z)], "k bigint, a double, b double, c double, d double")
    model, history = neural.fit_autoencoder(df, COLUMNS, "k", 2, level=0.1, rate=0.5, epochs=6, batches=3)
    errors = [r["error"] for r in history.orderBy("epoch").collect()]
    assert len(errors) == 6 and errors[-1] < errors[0] and all(b < a * 1.02 for a, b in zip(errors, errors[1:], strict=False))
    row = neural.with_hidden(df, model, COLUMNS).where("k = 5").first()
    np.testing.assert_allclose(row["hidden"], model.hidden(np.array([[row[c] for c in COLUMNS]]))[0])


def test_autoencoder_of_nothing_and_of_nulls(spark):
    model, history = neural.fit_autoencoder(frame(spark, 3).limit(0), COLUMNS, "k", 2, epochs=2, batches=2)
    assert [r["error"] for r in history.collect()] == [None, None] and np.array_equal(model.weights, neural.started(4, 2, 1).weights)
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, 0.5, None, 0.1, 0.2)], frame(spark, 1).schema)
    assert neural.fit_autoencoder(nulls, COLUMNS, "k", 2, epochs=1, batches=1)[1].first()["error"] > 0


def test_patience_on_made_up_curves():
    def epochs_run(errors, batches=4, first=10):
        rule, k = neural.Patience(batches, first), 0
        for k, e in enumerate(errors):
            rule.better(k * batches + batches - 1, e)
            if any(rule.over(k * batches + b) for b in range(batches)):
                break
        return k, rule

    flat, rule = epochs_run([0.5] * 100)
    assert flat == 10 and rule.best_iteration == 3  # ten epochs are always waited for
    falling, _ = epochs_run([0.5 * 0.98**k for k in range(60)])
    assert falling == 59  # each fall of 2 % doubles what it waits
    slow, _ = epochs_run([0.5 * 0.999**k for k in range(60)])
    assert slow == 10  # falls of 0.1 % are the best so far, but not worth waiting for
    late, rule = epochs_run([0.5] * 8 + [0.3] + [0.4] * 60)
    assert rule.best == 0.3 and late == 17  # improved after step 35: until step 70
    assert epochs_run([float("nan")] * 30)[0] == 10


def test_stacked_beats_the_plain_softmax_on_held_out_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(-1, 1, (1200, 4))
    label = (np.abs(x[:, 0]) > 0.5).astype(int)  # no plane parts these
    df = spark.createDataFrame([(k, *map(float, r), int(y)) for k, (r, y) in enumerate(zip(x, label, strict=True))], "k bigint, a double, b double, c double, d double, y int").repartition(2)
    train, valid, test = (part.persist() for part in split(df, "k"))
    held = neural.batched(test, COLUMNS, "k", 1, "y")
    how = {"rate": 2.0, "batches": 4, "act": "tanh", "cost": "MSE"}
    deep, shown, rule = neural.fit_stacked(train, valid, COLUMNS, "y", "k", 2, [12], [0.1], pretrain_epochs=2, epochs=14, **how)
    plain, _, _ = neural.fit_stacked(train, valid, COLUMNS, "y", "k", 2, [], [], epochs=3, **how)
    deep_error, plain_error = neural.class_error(held, deep, 2)[0], neural.class_error(held, plain, 2)[0]
    assert deep_error < 0.15 < plain_error and shown.count() == 2 and rule.best < 0.2
    assert neural.predicted(test, deep, COLUMNS).select(F.avg((F.col("prediction") != F.col("y")).cast("double"))).first()[0] == pytest.approx(deep_error)
    with pytest.raises(ValueError):
        neural.fit_stacked(train, valid, COLUMNS, "y", "k", 2, [3], [])


def test_rows_of_many_partitions_are_held_in_few(spark):
    """A step runs a task for each partition, so their number follows the rows and not a shuffle's setting."""
    rows = neural.batched(frame(spark, 300).repartition(40), COLUMNS, "k", 2)
    held = neural.compacted(rows)
    assert held.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r["_key"] for r in held.collect()) == sorted(r["_key"] for r in rows.collect())
    held.unpersist()
    more = neural.compacted(rows, 20)
    assert more.rdd.getNumPartitions() == 15
    more.unpersist()


def test_blocks_hold_every_row_once(spark):
    """Mini-batches as arrays have the rows of the table, cut to size, and give its sums; a batch may be empty."""
    rows = neural.batched(frame(spark, 300).repartition(7), COLUMNS, "k", 3)
    want = sorted((r["_batch"], r["_key"], tuple(r["_x"]), r["_label"]) for r in rows.collect())
    held = neural.held(rows, 4, 40)
    got = [[block for block in part.collect()] for part in held]
    assert sorted((b, int(k), tuple(map(float, x)), int(y)) for b, part in enumerate(got) for xs, ks, ys in part for x, k, y in zip(xs, ks, ys, strict=True)) == want
    assert not got[3] and len(neural.summed(held[3], lambda x, key, label: x.sum(0))) == 0
    assert all(1 <= part.getNumPartitions() <= 4 for part in held)
    assert max(len(key) for _, key, _ in neural.blocks(rows, 10).collect()) == 10
    for b in range(3):
        sums = neural.summed(rows.where(F.col("_batch") == b), lambda x, key, label: x.sum(0))
        np.testing.assert_allclose(neural.summed(held[b], lambda x, key, label: x.sum(0)), sums, rtol=1e-12)
        np.testing.assert_allclose(sums, np.sum([x for c, _, x, _ in want if c == b], axis=0), rtol=1e-12)
    for part in held:
        part.unpersist()


def test_stacked_descends_until_its_rule_stops_it(spark, monkeypatch):
    """Left alone, layers are trained for 15 epochs, and the descent ends by its rule, long before the bound on epochs."""
    run, tune = [], neural.fine_tune
    monkeypatch.setattr(neural, "fine_tune", lambda *a, **k: run.append(tune(*a, **k)) or run[-1])
    df = frame(spark, 60).withColumn("y", F.lit(1))  # one class: right after the first epoch, and no better after
    _, shown, rule = neural.fit_stacked(df, df, COLUMNS, "y", "k", 2, [2], [0.1], batches=1)
    assert [r["epoch"] for r in shown.orderBy("epoch").collect()] == list(range(15))
    assert rule.best == 0 and rule.patience == 10 and run[0][2] == 11


def test_sdae_fit_gives_its_networks_the_whole_training(spark, sf_dir, monkeypatch):
    """No epoch of the query's training is cut: each layer has 15 of them, and the bound of the descent is the reference's 1000, after at least 10."""
    from boxwise.plans.registry import QUERIES

    trained, tuned = [], []
    monkeypatch.setattr(neural, "_trained", lambda rows, model, rate, level, noise, epochs, *_: trained.append(epochs) or model)

    def tune(train, valid, network, classes, rate, epochs, first=10):
        tuned.append((len(network.layers), epochs, first))
        return network, neural.Patience(len(train), first), 0

    monkeypatch.setattr(neural, "fine_tune", tune)
    assert {r["kind"] for r in QUERIES["sdae_fit"](spark, sf_dir).collect()} == {"stacked", "softmax"}
    assert trained == [15, 15] and tuned == [(3, 1000, 10), (1, 1000, 10)]
