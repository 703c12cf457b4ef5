"""The factorisation's turns against a dense solver, and turns in Spark against turns in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmark.operators import factor
from glossmark.operators.factor import Penalties


def data(n=120, seed=0):
    rng = np.random.default_rng(seed)
    source, target, side = rng.integers(0, 9, n), rng.integers(0, 6, n), rng.normal(size=(n, 2))
    w, h = rng.normal(size=(9, 3)), rng.normal(size=(6, 3))
    label = 20 + rng.normal(size=9)[source] + rng.normal(size=6)[target] + (w[source] * h[target]).sum(1) + side @ [1.0, -2.0] + 0.1 * rng.normal(size=n)
    return source, target, side, label


NAMES = ([f"s{i}" for i in range(9)], [f"t{i}" for i in range(6)])


def test_objective_falls_in_every_turn():
    model = factor.fit_factors(*data(), NAMES, Penalties(0.01, 0.02, 0.1, 0.05, 0.01, 4), 42)
    steps = np.diff(model.objectives)
    assert len(steps) > 10 and np.all(steps <= 1e-9 * np.array(model.objectives[:-1])) and steps[0] < -1


def test_biases_and_side_equal_a_dense_solver():
    source, target, side, label = data()
    p = Penalties(0.02, 0.05, 0.1, 0.1, 0.01, 0)
    model = factor.fit_factors(source, target, side, label, NAMES, p, 42)
    x = np.c_[side, np.eye(9)[source], np.eye(6)[target]]
    penalty = np.r_[np.full(2, len(label) * p.z), np.bincount(source, minlength=9) * p.s, np.bincount(target, minlength=6) * p.t]
    want = np.linalg.solve(x.T @ x + np.diag(penalty), x.T @ (label - label.mean()))
    assert np.r_[model.side, model.source[:, 0], model.target[:, 0]] == pytest.approx(want, abs=1e-7)


def test_every_term_is_at_its_minimum_given_the_others():
    """Gradients of the whole objective, written out densely, vanish; separate penalties for both sides' factors."""
    source, target, side, label = data()
    p = Penalties(0.01, 0.02, 0.3, 0.05, 0.01, 3)
    model = factor.fit_factors(source, target, side, label, NAMES, p, 1, rounds=3000, settled=1e-9)
    wrong = label - model.predict(source, target, side)
    n = len(label)
    assert side.T @ wrong - n * p.z * model.side == pytest.approx(0, abs=1e-4)
    for owner, mine, other, other_of, bias, weight in ((source, model.source, model.target, target, p.s, p.w), (target, model.target, model.source, source, p.t, p.h)):
        for key in range(len(mine)):
            rows = owner == key
            assert wrong[rows].sum() - rows.sum() * bias * mine[key, 0] == pytest.approx(0, abs=1e-4)
            assert other[other_of[rows], 1:].T @ wrong[rows] - rows.sum() * weight * mine[key, 1:] == pytest.approx(0, abs=1e-4)


def test_keys_without_rows_have_no_terms():
    source, target, side, label = data()
    names = ([*NAMES[0], "new"], NAMES[1])
    model = factor.fit_factors(source, target, side, label, names, Penalties(0.01, 0.01, 0.1, 0.1, 0.01, 3), 42)
    got = model.predict(np.array([9]), np.array([2]), np.zeros((1, 2)))
    assert got[0] == pytest.approx(model.mean + model.target[2, 0]) and not model.source[9].any()


def test_spark_turns_equal_those_in_memory(spark):
    source, target, side, label = data(80, 3)
    p = Penalties(0.01, 0.03, 0.2, 0.1, 0.02, 2)
    frame = [(NAMES[0][s], NAMES[1][t], z.tolist(), float(y)) for s, t, z, y in zip(source, target, side, label)]
    rows = spark.createDataFrame(frame, "src_key string, tgt string, side array<double>, label double").repartition(3)
    fitted = factor.fit_scanned(rows, p, 7, 2, rounds=3, settled=0.0)
    model = factor.fit_factors(source, target, side, label, NAMES, p, 7, rounds=3, settled=0.0)
    assert fitted[1] == pytest.approx(model.side, rel=1e-7)
    asked = [("s1", "t2", [0.5, 1.0]), ("s1", "none", [0.0, 0.0]), ("none", "t0", [1.0, 0.0])]
    got = factor.predict_scanned(spark.createDataFrame(asked, "src_key string, tgt string, side array<double>"), fitted, 2)
    by = {(r.src_key, r.tgt): r.prediction for r in got.collect()}
    assert by["s1", "t2"] == pytest.approx(model.predict(np.array([1]), np.array([2]), np.array([[0.5, 1.0]]))[0], rel=1e-7)
    assert by["s1", "none"] == pytest.approx(model.mean + model.source[1, 0], rel=1e-7)
    assert by["none", "t0"] == pytest.approx(model.mean + model.target[0, 0] + model.side[0], rel=1e-7)


def table(spark):
    source, target, side, label = data(90, 5)
    rows = [(f"k{i}", NAMES[0][s], NAMES[1][t], float(z[0]), float(z[1]), float(y) if i % 17 else 0.0) for i, (s, t, z, y) in enumerate(zip(source, target, side, label))]
    return spark.createDataFrame(rows, "_key string, source_lang string, target_lang string, a double, b double, y double")


def test_search_in_memory_equals_search_in_spark(spark, monkeypatch):
    rows = table(spark)
    members = rows.selectExpr("'42|x' AS run", "CASE WHEN pmod(hash(_key), 3) = 2 THEN 'test' ELSE concat('fold', pmod(hash(_key), 3)) END AS part", "_key")
    config = {"cv": 2, "param_space": {"alpha": [0.001, 0.01], "beta_z": [0.01]}, "fixed_param": {"factors": False}, "rounds": 2}
    got = [
        factor.fit_protocol(rows, members, {"42|x": 42}, [["source_lang", "target_lang", "a", "b"]], "y", config, "_key", in_memory=limit).collect()
        for limit in (1 << 20, 0)
    ]
    (a,), (b,) = got
    assert a.part == b.part == "test" and a.rmse == pytest.approx(b.rmse, rel=1e-6) and a.cv_rmse == pytest.approx(b.cv_rmse, rel=1e-6)
    assert a.extra == b.extra and a.extra["alpha"] == 0.001  # equal fits: the first candidate stays
    calls = []
    monkeypatch.setattr(factor, "fit_all", lambda spark, held, specs, *rest: calls.append(len(specs)) or [None] * len(specs))
    assert not factor.fit_protocol(rows, members, {"42|x": 42}, [["source_lang", "target_lang", "a"]], "y", config, "_key").collect()
    assert calls[0] == 2  # one setting, two folds: a learning rate makes no fit of its own


def test_zero_scores_count_as_missing(spark):
    rows = table(spark)
    members = rows.select(F.lit("42").alias("run"), F.when(F.rand(1) < 0.3, "test").otherwise(F.concat(F.lit("fold"), (F.rand(2) * 3).cast("int").cast("string"))).alias("part"), "_key")
    members = spark.createDataFrame(members.collect())
    config = {"cv": 3, "param_space": {"beta_z": [0.01, 1.0]}, "fixed_param": {"rank": 2}}
    (got,) = factor.fit_protocol(rows.where("y <> 0"), members, {"42": 42}, [["source_lang", "target_lang", "a", "b"]], "y", config, "_key").collect()
    assert 0 < got.rmse < 3 and got.cv_rmse < 3
