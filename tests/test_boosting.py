"""Boosted trees against a plain booster, growth by scans against growth in memory, and the shared search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmark.operators import boosting, trees
from glossmark.operators.boosting import Layout, Policy


def policy(**more):
    given = dict(rounds=0, step=0.3, depth=3, leaves=0, l1=0.0, l2=1.0, min_gain=0.0, min_hessian=1.0, min_rows=1, rows=1.0, columns=1.0, bins=256)
    return Policy(**{**given, **more})


def pull(t, l1):
    return np.sign(t) * max(abs(t) - l1, 0)


class Plain:
    """One tree by trying every split of every node, the published formulas written out."""

    def __init__(self, x, g, p, allowed):
        self.x, self.g, self.p, self.allowed = x, g, p, allowed
        self.uses, self.gains = np.zeros(x.shape[1]), np.zeros(x.shape[1])

    def best(self, at):
        p, found = self.p, []
        g, n = self.g[at].sum(), len(at)
        for j in np.flatnonzero(self.allowed):
            for v in np.unique(self.x[at, j])[:-1]:
                left = at[self.x[at, j] <= v]
                gl, nl = self.g[left].sum(), len(left)
                if min(nl, n - nl) < max(p.min_hessian, p.min_rows):
                    continue
                gain = pull(gl, p.l1) ** 2 / (nl + p.l2) + pull(g - gl, p.l1) ** 2 / (n - nl + p.l2) - pull(g, p.l1) ** 2 / (n + p.l2)
                if gain > 1e-6 and gain >= p.min_gain:
                    found.append((gain, j, v))
        most = max((f[0] for f in found), default=0)
        return next((f for f in found if f[0] >= most * (1 - 1e-9)), None)

    def grow(self, bag):
        leaves = [(bag, 0, [])]
        order = []
        while True:
            open_leaves = []
            for i, (at, depth, _) in enumerate(leaves):
                if not self.p.depth or depth < self.p.depth:
                    top = self.best(at)
                    if top:
                        open_leaves.append((top, i))
            if not open_leaves or (self.p.leaves and len(leaves) >= self.p.leaves):
                break
            top, i = max(open_leaves, key=lambda o: o[0][0])
            at, depth, path = leaves.pop(i)
            gain, j, v = top
            self.uses[j] += 1
            self.gains[j] += gain
            order.append(gain)
            low = self.x[at, j] <= v
            leaves += [(at[low], depth + 1, [*path, (j, v, True)]), (at[~low], depth + 1, [*path, (j, v, False)])]
        return leaves

    def predict(self, leaves, x):
        out = np.zeros(len(x))
        for at, _, path in leaves:
            mine = np.ones(len(x), bool)
            for j, v, low in path:
                mine &= (x[:, j] <= v) == low
            out[mine] = -pull(self.g[at].sum(), self.p.l1) / (len(at) + self.p.l2) * self.p.step
        return out


def plain_boost(x, y, train, test, p, rounds, seed):
    guess = np.full(len(y), y[train].mean())
    uses, gains, errors = np.zeros(x.shape[1]), np.zeros(x.shape[1]), {}
    for turn in range(1, max(rounds) + 1):
        bag = train[boosting.sampled(train, seed, turn, p.rows)] if p.rows < 1 else train
        tree = Plain(x, guess - y, p, boosting.columns_of(x.shape[1], seed, turn, p.columns))
        guess = guess + tree.predict(tree.grow(bag), x)
        uses, gains = uses + tree.uses, gains + tree.gains
        if turn in rounds:
            errors[turn] = np.mean((guess[test] - y[test]) ** 2)
    return errors, uses, gains


def data(n=160, seed=0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 2, n), rng.integers(0, 7, n), rng.normal(size=n), rng.normal(size=n)], 1).astype(float)
    y = 3 * x[:, 0] + np.where(x[:, 1] > 4, 5.0, 0.0) * (x[:, 2] > 0) + np.exp(x[:, 3]) + 0.3 * rng.normal(size=n)
    return x, y


def coded(x):
    edges = [np.unique(c) for c in x.T]
    layout = Layout([len(e) for e in edges])
    return np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], 1) + layout.start[:-1], layout


CASES = {
    "depth": policy(),
    "penalties": policy(l1=2.0, l2=0.5, min_hessian=5, min_gain=3.0, depth=4),
    "sampled": policy(rows=0.6, columns=0.5, depth=4),
    "leaves": policy(depth=0, leaves=7, l2=0.0, min_rows=5, min_hessian=1e-3),
    "leaves and depth": policy(depth=3, leaves=6, l1=0.5, l2=0.1, min_rows=3),
    "many leaves": policy(depth=10, leaves=40, l1=0.1, l2=0.1, min_rows=2, step=0.5),
}


@pytest.mark.parametrize("digits", [1, 9])
@pytest.mark.parametrize("name", CASES)
def test_boosting_equals_a_plain_booster(name, digits):
    """With fewer bins than rows by sums per bin, with a bin for every value by running sums."""
    x, y = data()
    x = np.round(x, digits)
    codes, layout = coded(x)
    assert (layout.bins > len(x)) == (digits == 9)
    train, test = np.arange(120), np.arange(120, 160)
    rounds = [1, 4, 9]
    errors, gains = boosting.fit_local(codes, y, np.arange(160), layout, train, {"t": test}, CASES[name], rounds, 11)
    want, uses, total = plain_boost(x, y, train, test, CASES[name], rounds, 11)
    assert errors["t"] == pytest.approx(want, rel=1e-9)
    assert gains.uses.tolist() == uses.tolist() and gains.gain == pytest.approx(total, rel=1e-7)
    shares = gains.importances(False)
    assert shares.sum() == pytest.approx(1) and gains.importances(True).sum() == uses.sum()


@pytest.mark.parametrize("name", CASES)
def test_columns_of_few_values_only(name):
    """All columns by sums per bin, one of them constant."""
    x, y = data(400, 5)
    x = np.c_[np.round(x), np.ones(400)]
    codes, layout = coded(x)
    train, test = np.arange(300), np.arange(300, 400)
    assert max(np.diff(layout.start)) * boosting.FEW <= 300
    errors, gains = boosting.fit_local(codes, y, np.arange(400), layout, train, {"t": test}, CASES[name], [1, 6], 3)
    want, uses, total = plain_boost(x, y, train, test, CASES[name], [1, 6], 3)
    assert errors["t"] == pytest.approx(want, rel=1e-9)
    assert gains.uses.tolist() == uses.tolist() and gains.gain == pytest.approx(total, rel=1e-7)


def test_rows_are_put_in_order_once_a_fit(monkeypatch):
    """The order of a column's values is dealt on from node to node, whatever the number of trees."""
    x, y = data()
    codes, layout = coded(x)
    sorts, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(1) or plain(*a, **k))
    boosting.fit_local(codes, y, np.arange(160), layout, np.arange(160), {}, CASES["leaves"], [12], 11)
    assert 0 < len(sorts) <= x.shape[1]


def test_sums_take_in_no_more_than_a_tree_may_use(monkeypatch):
    """A tree's sums see the rows of its bag and its own columns: all of them for the root, at most half of them for each level below."""
    x, y = data(400, 5)
    x = np.round(x)
    codes, layout = coded(x)
    seen, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda key, *a, **k: seen.append(len(key)) or plain(key, *a, **k))
    p = policy(rows=0.5, columns=0.5, depth=4)
    boosting.fit_local(codes, y, np.arange(400), layout, np.arange(400), {}, p, [1], 11)
    drawn = int(boosting.sampled(np.arange(400), 11, 1, 0.5).sum())
    assert 2 * drawn * 2 <= sum(seen) <= 2 * drawn * 2 * (1 + 3 / 2)


def test_leafwise_growth_goes_where_depth_cannot():
    """A chain: every split frees one group, so seven leaves need six levels, and the gain is on one side only."""
    x = np.repeat(np.arange(7.0), 10)[:, None]
    y = np.repeat(3.0 ** np.arange(7), 10)
    codes, layout = coded(x)
    rows = np.arange(70)
    lone = policy(depth=0, leaves=7, l2=0.0, min_rows=1, step=1.0)
    errors, gains = boosting.fit_local(codes, y, rows, layout, rows, {"t": rows}, lone, [1], 0)
    assert errors["t"][1] == pytest.approx(0, abs=1e-18) and gains.uses[0] == 6
    shallow, _ = boosting.fit_local(codes, y, rows, layout, rows, {"t": rows}, policy(depth=2, l2=0.0, step=1.0), [1], 0)
    assert shallow["t"][1] > 10


def test_scans_equal_the_table_in_memory(spark):
    x, y = data(120, 3)
    codes, layout = coded(x)
    fold = np.arange(120) % 4 - 1  # -1: a test row
    frame = [(i, c.tolist(), float(v), [int(f)], [] if f >= 0 else ["0|t"]) for i, (c, v, f) in enumerate(zip(codes, y, fold))]
    rows = spark.createDataFrame(frame, "row long, codes array<int>, label double, folds array<int>, parts array<string>").repartition(3)
    fits = [
        boosting.Fit(0, 1, CASES["sampled"], [1, 3], 5), boosting.Fit(0, -1, CASES["leaves"], [2], 5), boosting.Fit(0, 0, CASES["penalties"], [2, 3], 6),
    ]
    asked = {0: ["fold1"], 1: ["t"], 2: ["fold0"]}
    got = boosting.fit_scanned(rows, layout, fits, asked, sums_bytes=layout.bins * 16 * 5)
    for fit, (errors, gains) in zip(fits, got):
        train = np.flatnonzero((fold >= 0) & (fold != fit.fold))
        tests = {f"fold{fit.fold}": np.flatnonzero(fold == fit.fold)} if fit.fold >= 0 else {"t": np.flatnonzero(fold < 0)}
        want, same = boosting.fit_local(codes, y, np.arange(120), layout, train, tests, fit.policy, fit.rounds, fit.seed)
        for part in want:
            assert errors[part] == pytest.approx(want[part], rel=1e-9)
        assert gains.uses.tolist() == same.uses.tolist()


def table(spark, n=150, seed=1):
    x, y = data(n, seed)
    rows = [(f"k{i}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "_key string, a double, b double, c double, d double, y double")


def members(spark, n=150):
    rows = []
    for run in ("42|x", "43|y"):
        shift = 0 if run == "42|x" else 3
        for i in range(n):
            rows.append((run, "test" if i % 5 == shift else f"fold{(i // 5 + shift) % 3}", f"k{i}"))
    return spark.createDataFrame(rows, "run string, part string, _key string")


CONFIG = {
    "hpm_search_mode": "grid_search", "cv": 3, "param_space": {"n_estimators": [2, 6], "eta": [0.1, 0.5]}, "fixed_param": {"max_depth": 2, "reg_lambda": 0.3},
}


def test_search_shares_paths_and_jobs(spark):
    """Four candidates on two paths: the choice is that of separate fits, and jobs do not grow with the candidates."""
    rows, parts, seeds = table(spark), members(spark), {"42|x": 42, "43|y": 43}
    _, paths, placed = trees._seed_options(CONFIG, "xgb", 42)
    assert [r for _, r in paths] == [[2, 6], [2, 6]] and placed == [(0, 2), (1, 2), (0, 6), (1, 6)]
    got = {r.run: r for r in trees.fit_protocol(rows, parts, seeds, [["a", "b", "c", "d"]], "y", CONFIG, "xgb", "_key").collect()}
    assert set(got) == set(seeds)
    pdf = rows.toPandas().set_index("_key")
    x, y = pdf[["a", "b", "c", "d"]].to_numpy(), pdf["y"].to_numpy()
    place = {k: i for i, k in enumerate(pdf.index)}
    for run, r in got.items():
        of = {p: np.array([place[m["_key"]] for m in parts.where((F.col("run") == run) & (F.col("part") == p)).collect()]) for p in ("test", "fold0", "fold1", "fold2")}
        folds = [of[f"fold{f}"] for f in range(3)]
        scores = {}
        for rounds in (2, 6):
            for eta in (0.1, 0.5):
                p = policy(step=eta, depth=2, l2=0.3)
                scores[rounds, eta] = np.sqrt(np.mean([plain_boost(x, y, np.concatenate([g for g in folds if g is not h]), h, p, [rounds], 0)[0][rounds] for h in folds]))
        best = min(scores, key=scores.get)
        assert (r.extra["n_estimators"], r.extra["eta"]) == best and r.cv_rmse == pytest.approx(scores[best], rel=1e-9)
        error, _, gains = plain_boost(x, y, np.concatenate(folds), of["test"], policy(step=best[1], depth=2, l2=0.3), [best[0]], 0)
        assert r.rmse == pytest.approx(np.sqrt(error[best[0]]), rel=1e-9) and r.n == 120 and r.part == "test"
        assert sum(v for k, v in r.extra.items() if k.endswith("_importance")) == pytest.approx(1)

    def jobs(config):
        tracker, group = spark.sparkContext.statusTracker(), f"boost-{config['cv']}-{len(config['param_space']['eta'])}"
        spark.sparkContext.setJobGroup(group, group)
        trees.fit_protocol(rows, parts, seeds, [["a", "b"]], "y", config, "xgb", "_key").collect()
        found = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    wide = {**CONFIG, "param_space": {"n_estimators": [1, 2, 3], "eta": [0.1, 0.2, 0.3, 0.4, 0.5]}}
    assert jobs(CONFIG) == jobs(wide)


def test_search_by_scans_equals_search_in_memory(spark):
    config = {**CONFIG, "param_space": {"n_estimators": [1, 2], "num_leaves": [3, 4]}, "fixed_param": {"learning_rate": 0.4, "min_child_samples": 4}}
    rows, parts, seeds = table(spark, 60), members(spark, 60), {"42|x": 42, "43|y": 43}
    both = [
        sorted((r.run, r.combo, r.part, round(r.cv_rmse, 9), round(r.rmse, 9), sorted(r.extra.items())) for r in
               trees.fit_protocol(rows, parts, seeds, [["a", "b", "c"], ["d"]], "y", config, "lgbm", "_key", in_memory=limit).collect())
        for limit in (1 << 20, 0)
    ]
    assert both[0] == both[1] and len(both[0]) == 4


def test_bins_are_all_values_or_quantiles(spark):
    rows = spark.range(1000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"), F.lit(None).cast("double").alias("z"))
    x, y, z = trees.borders(rows, ["x", "y", "z"], 10)
    assert len(x) == 10 and np.abs(x - np.arange(99.0, 1000, 100)).max() <= 5 and y.tolist() == [0, 1, 2] and len(z) == 1
