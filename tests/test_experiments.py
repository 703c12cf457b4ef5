"""Splits, feature choice, models and protocols."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glossmark.operators import factor, features, linear, polynomial, search, splits, summary, transforms, trees
from glossmark.plans.regression import Setup, prepare, run_experiment, run_results

FT = ["source_lang", "target_lang", "train_dataset", "test_dataset"]


@pytest.fixture(scope="module")
def table(spark):
    """A small experiment table whose score depends on proxies and languages."""
    rng = np.random.default_rng(3)
    langs = ["eng", "aaa", "bbb", "ccc", "ddd"]
    rows = []
    for s in langs:
        for t in langs:
            for d in range(4):
                if s != t:
                    size, proxy, far = 1000 * (d + 1), rng.uniform(5, 40), rng.uniform(0, 1)
                    score = 2 + 0.8 * proxy - 5 * far + size / 1000 + rng.normal(0, 0.5)
                    rows.append((s, t, f"d{d}", f"d{d % 3}", size, far, 1.0, int(t == "eng"), proxy, score, 0.1))
    names = FT + ["dataset_size", "genetic", "test_size", "eng_target", "trfm_spBLEU_mean", "m2m100_ft_spBLEU_mean", "m2m100_ft_spBLEU_se"]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names))


COMBO = features.Toggles(with_small100_ft=False, with_small100_noft=False, with_model_noft=False)


def test_split_sizes_and_membership(spark):
    df = spark.range(829).selectExpr("string(id) AS k", "if(id % 13 = 0, 'rare', if(id % 3 = 0, 'x', 'y')) AS s")
    split = splits.random_split(df, [], ["s"], F.col("k"), 42).toPandas()
    assert len(split) == 829 and split["is_test"].sum() == splits.test_rows(829) == 249
    for _, part in split.groupby("s"):
        assert abs(part["is_test"].sum() - 0.3 * len(part)) < 1
    again = splits.random_split(df.repartition(7), [], ["s"], F.col("k"), 42).toPandas()
    assert set(split[split.is_test].k) == set(again[again.is_test].k)
    other = splits.random_split(df, [], ["s"], F.col("k"), 43).toPandas()
    assert set(split[split.is_test].k) != set(other[other.is_test].k)


def test_incremental_sizes(spark):
    df = spark.range(1184).selectExpr("string(id) AS k", "id % 4 = 0 AS s")
    out = splits.incremental_split(df, [], ["s"], F.col("k"), 42).toPandas()
    train = 1184 - splits.test_rows(1184)
    sizes = out[out.portion.notna()].groupby("portion").size().to_dict()
    assert train == 828 and sizes == {p: splits.test_rows(828, p) for p in splits.PORTIONS}
    held = set(out[out.portion.isna()].k)
    assert not held & set(out[out.portion.notna()].k)


def test_folds(spark):
    df = spark.range(103).selectExpr("string(id) AS k")
    sizes = splits.kfold(df, [], F.col("k"), 1).groupBy("fold").count().toPandas().sort_values("fold")
    assert list(sizes["count"]) == [11] * 3 + [10] * 7
    few = splits.kfold(spark.range(4).selectExpr("string(id) AS k"), [], F.col("k"), 1)
    assert sorted(r.fold for r in few.collect()) == [0, 1, 2, 3]


def test_language_splits(table):
    train, source, target = splits.leave_one_out(table, "aaa")
    assert train.filter("source_lang = 'aaa' OR target_lang = 'aaa'").count() == 0
    assert train.count() + source.count() + target.count() == table.count()
    langs = splits.languages(table)
    assert {r.lang for r in langs.collect()} == {"aaa", "bbb", "ccc", "ddd"}
    seen, tests = splits.seen_unseen(table, ["aaa", "bbb"])
    assert seen.filter("source_lang IN ('aaa', 'bbb')").count() == 0
    assert {(r.role, r.lang) for r in tests.select("role", "lang").distinct().collect()} == {
        (r, x) for r in ("source", "target") for x in ("aaa", "bbb")
    }


def test_feature_choice(table):
    assert features.constant_columns(table) == ["test_size", "m2m100_ft_spBLEU_se"]
    full = features.select_features(table.columns, "m2m100", "spBLEU", COMBO)
    assert full == ["dataset_size", "genetic", "test_size", "eng_target", "trfm_spBLEU_mean"]
    base = features.Toggles(nlperf_only=True)
    assert features.select_features(table.columns, "m2m100", "spBLEU", base) == ["genetic", "dataset_size"]
    ids = features.select_features(["genetic"], "m2m100", "spBLEU", features.Toggles(dataset_features=False), with_ids=True)
    assert ids[:4] == ["source_lang", "target_lang", "dataset_size", "genetic"]
    assert ids[4:] == [f"{p}_spBLEU_mean" for p in ("trfm", "small100_noft", "small100_ft", "m2m100_noft")]
    task = features.select_features(
        ["genetic", "ttr_train", "aya_accuracy", "aya_f1", "source_lang"], "aya", "accuracy", features.TaskToggles()
    )
    assert task == ["genetic", "ttr_train", "aya_f1", "smollm_135m_accuracy", "smollm_360m_accuracy", "bloomz_560m_accuracy"]
    assert len(features.feature_combinations(published=True)) == 20
    assert len(features.feature_combinations()) == 1


def test_scaling_of_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = transforms.scale(df, transforms.scaler(df, ["a", "b"]), ["a", "b"]).collect()
    assert sorted(tuple(r) for r in out) == [(-1.0, 0.0), (1.0, 0.0)]


def test_lookup_raises_on_missing(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no entry for 2"):
        features.lookup_or_fail(left, right, ["k"]).collect()
    assert [tuple(r) for r in features.lookup_or_fail(left.where("k = 1"), right, ["k"]).collect()] == [(1, "x")]


def test_summaries(spark):
    runs = spark.createDataFrame([(1.0,), (3.0,)], "e double")
    assert tuple(summary.repeat_summary(runs, [], ["e"]).first()) == (2.0, 1.0)
    grid = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 0), ("c", 2.0, 2)], "p string, e double, o int")
    assert summary.best_of(grid, [], "e", "o").first().p == "b"
    scores = spark.createDataFrame([("x", "source", 1.0), ("x", "source", 3.0)], "lang string, role string, rmse double")
    langs = spark.createDataFrame([("x",), ("y",)], "lang string")
    rows = {r.lang: r for r in summary.language_summary(scores, [], langs).collect()}
    assert rows["x"].test_source_rmse == 2.0 and rows["x"].test_target_rmse is None and rows["y"].test_source_rmse is None


def test_search():
    assert search.grid({"a": [1, 2], "b": [3, 4]}) == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}, {"a": 2, "b": 4}]
    space = {"n": {"type": "Categorical", "low": 100, "high": 300, "step": 100}, "e": {"type": "Real", "low": 0.01, "high": 0.1, "prior": "log-uniform"}}
    draws = search.sample(space, 20, 1)
    assert draws == search.sample(space, 20, 1) and {d["n"] for d in draws} <= {100, 200, 300}
    assert all(0.01 <= d["e"] <= 0.1 for d in draws)
    errors = {0: 2.0, 1: 1.0, 2: 1.0}
    best, error = search.choose([{"i": i} for i in range(3)], 2, lambda p, f: errors[p["i"]])
    assert best == {"i": 1} and error == 1.0


def coordinate_descent(x, y, alpha=0.1, share=0.9):
    xc, yc, w, n = x - x.mean(0), y - y.mean(), np.zeros(x.shape[1]), len(y)
    for _ in range(5000):
        for j in range(len(w)):
            d = xc[:, j] @ xc[:, j]
            if d > 1e-9:
                pull = xc[:, j] @ (yc - xc @ w) + d * w[j]
                w[j] = np.sign(pull) * max(abs(pull) - n * alpha * share, 0) / (d + n * alpha * (1 - share))
    return w, y.mean() - x.mean(0) @ w


def test_linear_protocol_equals_direct_fits(spark, table):
    """The moments give the same errors as fitting on the rows, per language and seed."""
    setup = Setup(dataset="mt560", mode="lolo", regressor="poly", model="m2m100", config={"cv": 4, "degree": 2}, combos=[COMBO], seeds=[42])
    got = {(r.lang, r.part): (r.rmse, r.cv_rmse) for r in run_results(table, setup).collect()}
    keyed = table.withColumn("key", F.concat_ws("|", *FT, F.col("dataset_size").cast("string")))
    pdf = keyed.toPandas()
    x = pdf[["dataset_size", "genetic", "test_size", "trfm_spBLEU_mean"]].to_numpy(float)
    x, y = np.hstack([x, x**2, pdf[["eng_target"]].to_numpy(float)]), pdf["m2m100_ft_spBLEU_mean"].to_numpy()
    for lang in ("aaa", "ccc"):
        source, target = (pdf["source_lang"] == lang).to_numpy(), (pdf["target_lang"] == lang).to_numpy()
        train = ~(source | target)
        mean, std = x[train].mean(0), x[train].std(0)
        std[std < 1e-9] = 1
        mean[-1], std[-1] = 0, 1
        z = (x - mean) / std
        w, b = coordinate_descent(z[train], y[train])
        mine = keyed.filter((F.col("source_lang") != lang) & (F.col("target_lang") != lang))
        dealt = {r.key: r.fold for r in splits.kfold(mine, [], F.col("key"), 42, 4).collect()}
        fold = pdf["key"].map(dealt).to_numpy()
        folds = []
        for f in range(4):
            held = train & (fold == f)
            wf, bf = coordinate_descent(z[train & ~held], y[train & ~held])
            folds.append(np.mean((y[held] - z[held] @ wf - bf) ** 2))
        for part, rows in (("source", source), ("target", target)):
            rmse, cv = got[(lang, part)]
            assert rmse == pytest.approx(np.sqrt(np.mean((y[rows] - z[rows] @ w - b) ** 2)), rel=1e-5)
            assert cv == pytest.approx(np.sqrt(np.mean(folds)), rel=1e-5)


def test_moment_fit_meets_optimality():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6))
    x[:, 5] = x[:, 4] + 1e-3 * rng.normal(size=200)
    y = 3 * x[:, 0] - x[:, 4] + rng.normal(size=200)
    xc, yc = x - x.mean(0), y - y.mean()
    w = linear.descend(xc.T @ xc, xc.T @ yc, 200, 0.1, 0.9)
    gap = xc.T @ (yc - xc @ w) - 200 * 0.1 * 0.1 * w
    assert np.all(np.abs(gap[w == 0]) <= 18 + 1e-6)
    assert np.allclose(gap[w != 0], 18 * np.sign(w[w != 0]), atol=1e-4)


def test_mllib_elastic_net_matches_descent(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = 10 * x[:, 0] - 4 * x[:, 1] + rng.normal(size=300)
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(float(t), Vectors.dense(r)) for t, r in zip(y, x)], ["label", "v"])
    model = polynomial.elastic_net(df, 0.5, 0.5, "v")
    w, b = coordinate_descent(x, y, 0.5, 0.5)
    assert np.allclose(model.coefficients.toArray(), w, atol=2e-3 * np.abs(w).max())


def test_polynomial_search_equals_direct_fits(table):
    """Degree, penalty and its L1 share from moments against coordinate descent on the expanded rows."""
    space = {"poly_degree": [1, 2], "alpha": [0.02, 0.5], "l1_ratio": [0.3, 0.9]}
    setup = Setup("mt560", "random", "poly", "m2m100", {"cv": 3, "pipeline_type": "grid", "param_space": space}, combos=[COMBO], seeds=[42])
    (got,) = run_results(table, setup).collect()
    rows, _ = prepare(table, setup)
    split = splits.random_split(rows, [], ["_stratum"], F.col("_key"), 42)
    train = splits.kfold(split.filter("not is_test"), [], F.col("_key"), 42, 3).toPandas()
    test = split.filter("is_test").toPandas()
    columns = setup.columns(rows, COMBO)
    mean, std = train[columns].astype(float).mean(), train[columns].astype(float).std(ddof=0).replace(0, 1)
    mean["eng_target"], std["eng_target"] = 0, 1

    def expand(frame, degree):
        z = ((frame[columns].astype(float) - mean) / std).to_numpy()
        return np.stack([np.prod(z[:, list(t)], axis=1) for t in polynomial.monomials(len(columns), degree) if t], 1)

    def fit(frame, o):
        return coordinate_descent(expand(frame, o[0]), frame["m2m100_ft_spBLEU_mean"].to_numpy(), o[1], o[2])

    def error(frame, o, w, b):
        return np.mean((frame["m2m100_ft_spBLEU_mean"].to_numpy() - expand(frame, o[0]) @ w - b) ** 2)

    scores = {}
    for o in [(d, a, l) for d in (1, 2) for a in (0.02, 0.5) for l in (0.3, 0.9)]:
        scores[o] = np.sqrt(np.mean([error(train[train["fold"] == f], o, *fit(train[train["fold"] != f], o)) for f in range(3)]))
    best = min(scores, key=scores.get)
    assert (got.extra["degree"], got.extra["alpha"], got.extra["l1_ratio"]) == best
    assert got.cv_rmse == pytest.approx(scores[best], rel=1e-4)
    assert got.rmse == pytest.approx(np.sqrt(error(test, best, *fit(train, best))), rel=1e-4)


def test_folds_of_leave_one_out_are_those_of_the_training_rows(table):
    """The stretches of the one order give every run the folds that dealing its own rows gives."""
    from glossmark.plans.regression import _linear_plan, _memberships

    setup = Setup("mt560", "lolo", "poly", "m2m100", {"cv": 7, "degree": 1}, combos=[COMBO], seeds=[42, 43])
    rows, _ = prepare(table, setup)
    members, uses = _linear_plan(rows, setup, None)
    counted = members.join(uses, "cell").groupBy("run", "part", "_key").agg(F.sum("sign").alias("times"))
    assert counted.where("times NOT IN (0, 1)").count() == 0
    got = {tuple(r) for r in counted.where("times = 1").select("run", "part", "_key").collect()}
    want = {tuple(r) for r in _memberships(rows, setup, None).collect()}
    assert got == want and len({r for r, _, _ in got}) == 2 * len({r for r, _, _ in got if r.startswith("42")})


@pytest.mark.parametrize("mode", ["random", "unseen", "incremental"])
def test_protocols_run_and_beat_the_mean(table, mode):
    setup = Setup(
        dataset="mt560", mode=mode, regressor="poly", model="m2m100", config={"cv": 3, "degree": 1},
        combos=[COMBO], seeds=[42, 43], unseen=["aaa", "eng"], portions=[0.5],
    )
    rows = run_experiment(table, setup).collect()
    spread = table.agg(F.stddev_pop("m2m100_ft_spBLEU_mean")).first()[0]
    name = "test_source_rmse" if mode == "unseen" else "test_rmse"
    assert len(rows) == (2 if mode == "unseen" else 1)
    assert all(0 < r[name] < spread for r in rows) and all(r.with_trfm and not r.with_small100_ft for r in rows)


def test_cross_dataset(table):
    setup = Setup(dataset="mt560", mode="cross_dataset", regressor="poly", model="m2m100", config={"cv": 3, "degree": 1}, combos=[COMBO], seeds=[42])
    row = run_experiment(table.filter("dataset_size < 3000"), setup, table.filter("dataset_size >= 3000")).first()
    assert 0 < row.test_rmse < 10 and row.train_mt560


def test_trees_and_factors(table):
    trees = {"hpm_search_mode": "grid_search", "cv": 2, "param_space": {"eta": [0.3]}, "fixed_param": {"n_estimators": 3, "max_depth": 3}}
    setup = Setup(dataset="mt560", mode="random", regressor="xgb", model="m2m100", config=trees, combos=[COMBO], seeds=[42])
    row = run_experiment(table, setup).first()
    spread = table.agg(F.stddev_pop("m2m100_ft_spBLEU_mean")).first()[0]
    assert 0 < row.test_rmse < spread
    assert sum(v for k, v in row.extra.items() if k.endswith("_importance")) == pytest.approx(1)
    matrix = {"cv": 2, "param_space": {"beta_z": [0.01], "beta_w": [0.1]}}
    setup = Setup(dataset="nusa", mode="lolo", regressor="mf", model="m2m100", config=matrix, combos=[COMBO], seeds=[42], lang="ccc")
    row = run_experiment(table, setup).first()
    assert row.lang == "ccc" and 0 < row.test_source_rmse < 2 * spread


def test_repeated_keys_keep_their_rows(spark, table):
    """Every experiment twice, with another score: split sizes and fold sizes count all rows."""
    doubled = table.unionByName(table.withColumn("m2m100_ft_spBLEU_mean", F.col("m2m100_ft_spBLEU_mean") + 1))
    setup = Setup("mt560", "random", "poly", "m2m100", {"cv": 5, "degree": 1}, combos=[COMBO], seeds=[42])
    rows, _ = prepare(doubled, setup)
    assert rows.select("_key").distinct().count() == doubled.count() == 160
    once, _ = prepare(table, setup)
    assert {r["_key"] for r in once.collect()} == {r["_key"] for r in rows.collect() if "#" not in r["_key"]}
    (row,) = run_results(doubled, setup).collect()
    assert row.n == 160 - splits.test_rows(160)


def test_missing_predictors_raise(table):
    wanted = features.Toggles(with_small100_ft=False, with_small100_noft=True, with_model_noft=False)
    setup = Setup("mt560", "random", "poly", "m2m100", {"cv": 5, "degree": 1}, combos=[wanted], seeds=[42])
    with pytest.raises(KeyError, match="small100_noft"):
        run_results(table, setup)
    constant = table.withColumn("trfm_spBLEU_mean", F.lit(1.0))  # dropped as constant, which is no fault
    setup = Setup("nusa", "random", "poly", "m2m100", {"cv": 5, "degree": 1}, combos=[COMBO], seeds=[42])
    assert run_results(constant, setup).count() == 1


def test_parameters_are_passed_or_refused():
    with pytest.raises(ValueError, match="learning_rate"):
        trees.leafwise({"learning_rate": 1.5})
    assert trees.leafwise({"max_bin": 200_000}).bins == 200_000
    assert trees.depthwise({"reg_alpha": 0.2, "reg_lambda": 0.1, "gamma": 3}) == trees.Policy(
        rounds=100, step=0.3, depth=6, leaves=0, l1=0.2, l2=0.1, min_gain=3.0, min_hessian=1.0, min_rows=1, rows=1.0, columns=1.0, bins=256
    )
    assert trees.leafwise({"subsample": 0.5}).rows == 1.0 and trees.leafwise({"subsample": 0.5, "subsample_freq": 1}).rows == 0.5
    chosen = ["source_lang", "target_lang", "dataset_size", "a", "b"]
    assert factor.side_columns(chosen) == ["a", "b"] and factor.side_columns(chosen, 0) == ["dataset_size", "a", "b"]


def test_setup_checks():
    good = dict(dataset="nusa", mode="random", regressor="mf", model="nllb", config={})
    assert Setup(**good).score == "spBLEU" and Setup(**{**good, "mode": "seen_unseen"}).mode == "seen_unseen"
    for key, value, error in (
        ("dataset", "other", NotImplementedError), ("regressor", "svm", NotImplementedError),
        ("dataset", "mt560", ValueError), ("model", "aya", ValueError), ("mode", "never", ValueError),
    ):
        with pytest.raises(error):
            Setup(**{**good, key: value})
    assert factor.side_columns(["source_lang", "target_lang", "dataset_size", "a"]) == ["a"]


def test_searches_are_registered_whole(monkeypatch):
    from glossmark.operators.splits import SEEDS
    from glossmark.plans import model_queries as mq

    monkeypatch.setattr(mq, "table", lambda spark, sf_dir: None)
    monkeypatch.setattr(mq, "run_experiment", lambda rows, setup: setup)
    setups = {name: getattr(mq, name)(None, "") for name in ("depthwise_trees", "leafwise_trees", "matrix_factors", "polynomial_grid")}
    for setup in setups.values():
        assert setup.seeds == SEEDS and setup.lang == "all" and setup.config["cv"] == 10
    trees, leaves = setups["depthwise_trees"].config, setups["leafwise_trees"].config
    assert trees["n_iter"] == 50 and trees["param_space"]["n_estimators"]["low"] == 2000
    assert leaves["param_space"] == {"learning_rate": [0.03, 0.1, 0.3], "num_leaves": [16, 32, 64]}
    assert leaves["fixed_param"]["n_estimators"] == 100
    assert setups["matrix_factors"].config["param_space"]["alpha"] == [0.001, 0.01]
