"""Experiments with a closed form, in every protocol, with their check SQL.

One predictor makes the elastic net a shrunken slope; a parabola without penalty is a 2x2 system; one
tree of depth 1 on a 0/1 column is a pair of means; a factorisation without factors is a slope and two
kinds of shrunken means, worked out in turns. Folds, seeds and languages are those of the published runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.operators import features as ft
from glossmark.plans import fixtures as fx
from glossmark.plans.corpus_queries import rounded
from glossmark.plans.model_queries import ONE, PROXY, _fold, _one_predictor, _without_toggles, _x, run, table, task_table
from glossmark.plans.regression import Setup, run_experiment
from glossmark.plans.table_queries import (
    CROSS_TABLES_SQL, LABELLED_SQL, LANGS_SQL, PORTIONS_SQL, SEED_ROWS_SQL, UNSEEN, allocation_sql, split_sql,
)

PROXY_TASK = ft.TaskToggles(dataset_features=False, lang_features=False, with_smollm_360m=False, with_bloomz_560m=False)
PLAIN = ft.Toggles(lang_features=False, with_trfm=False, with_small100_ft=False, with_small100_noft=False, with_model_noft=False)
# The experiment table of the task runs: no size, so the ids alone are the key.
TASK_SQL = LABELLED_SQL.replace("m2m100_ft_spBLEU_mean AS y, k FROM exp)", "m2m100_ft_spBLEU_mean AS y, trfm_spBLEU_mean AS x, k FROM exp)")

REPEATS = """round(avg(cv_rmse), 6) AS cv_rmse, round(avg(e), 6) AS test_rmse,
  round(stddev_pop(cv_rmse), 6) AS cv_rmse_se, round(stddev_pop(e), 6) AS test_rmse_se"""


def _ranked(source: str, runs: str) -> str:
    """Rows of ``source`` with ``fold``, dealt by the seeded order inside each run."""
    return f"""SELECT * EXCLUDE (r, n), {_fold("r", "n")} AS fold FROM (
    SELECT *, row_number() OVER (PARTITION BY {runs} ORDER BY md5(seed || '|' || k)) - 1 AS r, count(*) OVER (PARTITION BY {runs}) AS n
    FROM {source}) q"""


def proxy_only_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen and unseen languages as training and test side in turn; one row per language and role."""
    wide = _without_toggles(run(spark, sf_dir, "unseen", "poly", ONE, [PROXY]))
    found = [c.removesuffix("_rmse").removeprefix("test_").split("_", 1) for c in wide.columns if c.endswith("_rmse") and c.startswith("test_")]
    entries = [
        F.struct(F.lit(role).alias("role"), F.lit(lang).alias("lang"), F.col(f"test_{role}_{lang}_rmse").alias("rmse"), F.col(f"test_{role}_{lang}_rmse_se").alias("rmse_se"))
        for role, lang in (f for f in found if len(f) == 2)
    ]
    means = ["cv_rmse", "cv_rmse_se", "test_source_rmse", "test_target_rmse"]
    return wide.select("train_is_seen", *means, F.inline(F.array(*entries))).where("rmse IS NOT NULL")


UNSEEN_SQL = f"""{_x(LABELLED_SQL)}, {SEED_ROWS_SQL}, {LANGS_SQL},
dirs AS (SELECT lang, lang IN ({", ".join(f"'{x}'" for x in UNSEEN)}) AS seen FROM langs),
d AS (SELECT unnest([true, false]) AS seen),
side AS (
  SELECT ys.*, seen FROM ys, d WHERE source_lang NOT IN (SELECT lang FROM dirs WHERE dirs.seen = d.seen)
    AND target_lang NOT IN (SELECT lang FROM dirs WHERE dirs.seen = d.seen)),
dealt AS ({_ranked("side", "seed, seen")}),
tr AS (SELECT seed || '|' || seen AS run, fold, x, y FROM dealt),
te AS (
  SELECT seed || '|' || seen AS run, 'source|' || lang AS part, x, y FROM ys JOIN dirs ON source_lang = lang
  UNION ALL SELECT seed || '|' || seen, 'target|' || lang, x, y FROM ys JOIN dirs ON target_lang = lang),
{_one_predictor("run", "tr", "te", "part")},
named AS (SELECT string_split(run, '|')[2]::BOOLEAN AS train_is_seen, string_split(part, '|')[1] AS role, string_split(part, '|')[2] AS lang, e FROM err),
per_lang AS (SELECT train_is_seen, role, lang, avg(e) AS rmse, stddev_pop(e) AS rmse_se FROM named GROUP BY ALL),
cvs AS (SELECT string_split(run, '|')[2]::BOOLEAN AS train_is_seen, avg(cv_rmse) AS cv, stddev_pop(cv_rmse) AS cv_se FROM cv GROUP BY 1),
means AS (
  SELECT train_is_seen, avg(rmse) FILTER (WHERE role = 'source') AS s, avg(rmse) FILTER (WHERE role = 'target') AS t FROM per_lang GROUP BY 1)
SELECT train_is_seen, round(cv, 6) AS cv_rmse, round(cv_se, 6) AS cv_rmse_se, round(s, 6) AS test_source_rmse, round(t, 6) AS test_target_rmse,
  role, lang, round(rmse, 6) AS rmse, round(rmse_se, 6) AS rmse_se
FROM per_lang JOIN cvs USING (train_is_seen) JOIN means USING (train_is_seen)"""


def proxy_only_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on one table, tested on another."""
    sales = fx.sales(spark, sf_dir)
    setup = Setup(dataset="mt560", mode="cross_dataset", regressor="poly", model="m2m100", config=ONE, combos=[PROXY])
    train = fx.experiments_from(sales.filter("l_returnflag <> 'R'"))
    return _without_toggles(run_experiment(train, setup, fx.experiments_from(sales.filter("l_returnflag = 'R'"))))


CROSS_SQL = f"""{CROSS_TABLES_SQL},
seeds AS (SELECT unnest([42, 43, 44, 45, 46]) AS seed),
side AS (SELECT seed, trfm_spBLEU_mean AS x, m2m100_ft_spBLEU_mean AS y, k || '|' || dataset_size AS k FROM cross_train, seeds WHERE trfm_spBLEU_mean IS NOT NULL),
tr AS ({_ranked("side", "seed")}),
te AS (SELECT seed, 'test' AS part, trfm_spBLEU_mean AS x, m2m100_ft_spBLEU_mean AS y FROM cross_test, seeds WHERE trfm_spBLEU_mean IS NOT NULL),
{_one_predictor("seed", "tr", "te", "part")}
SELECT {REPEATS}, true AS train_mt560 FROM err JOIN cv USING (seed)"""


def proxy_only_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growing shares of the training rows."""
    return _without_toggles(run(spark, sf_dir, "incremental", "poly", ONE, [PROXY]))


INCREMENTAL_SQL = f"""{_x(LABELLED_SQL)}, {PORTIONS_SQL},
side AS (SELECT c.seed, c.portion, c.k, y.x, y.y FROM chosen c JOIN y ON c.k = y.k),
learn AS (SELECT * FROM side WHERE portion IS NOT NULL),
dealt AS ({_ranked("learn", "seed, portion")}),
tr AS (SELECT seed || '|' || portion AS run, seed, portion, fold, x, y FROM dealt),
te AS (
  SELECT r.run, 'test' AS part, s.x, s.y FROM side s JOIN (SELECT DISTINCT run, seed FROM tr) r ON s.seed = r.seed WHERE s.portion IS NULL),
{_one_predictor("run", "tr", "te", "part")},
sizes AS (SELECT run, portion, count(*) AS n FROM tr GROUP BY run, portion)
SELECT portion AS train_portion, n AS train_regressor_size, {REPEATS}
FROM err JOIN cv USING (run) JOIN sizes USING (run) GROUP BY portion, n"""


def proxy_only_task_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intent task, split by source language."""
    setup = Setup(dataset="intent", mode="random", regressor="poly", model="aya", config=ONE, combos=[PROXY_TASK])
    return _task(run_experiment(task_table(spark, sf_dir), setup))


def proxy_only_task_lolo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot task, every language held out in turn."""
    setup = Setup(dataset="slot", mode="lolo", regressor="poly", model="aya", config=ONE, combos=[PROXY_TASK])
    names = {f"{m}_accuracy": f"{m}_f1" for m in ("smollm_135m", "bloomz_560m", "aya")}
    return _task(run_experiment(task_table(spark, sf_dir).withColumnsRenamed(names), setup))


def _task(df: DataFrame) -> DataFrame:
    return _without_toggles(df.drop("with_smollm_135m", "with_smollm_360m", "with_bloomz_560m"))


TASK_RANDOM_SQL = f"""{TASK_SQL}, {split_sql("source_lang")},
side AS (SELECT * FROM split WHERE NOT is_test),
tr AS ({_ranked("side", "seed")}),
te AS (SELECT seed, 'test' AS part, x, y FROM split WHERE is_test),
{_one_predictor("seed", "tr", "te", "part")}
SELECT {REPEATS} FROM err JOIN cv USING (seed)"""

TASK_LOLO_SQL = f"""{TASK_SQL}, {SEED_ROWS_SQL},
langs AS (SELECT DISTINCT source_lang AS lang FROM y),
left_out AS (SELECT ys.*, lang FROM ys, langs WHERE source_lang <> lang AND target_lang <> lang),
dealt AS ({_ranked("left_out", "seed, lang")}),
tr AS (SELECT seed || '|' || lang AS run, fold, x, y FROM dealt),
te AS (
  SELECT seed || '|' || lang AS run, 'source' AS part, x, y FROM ys JOIN langs ON source_lang = lang
  UNION ALL SELECT seed || '|' || lang, 'target', x, y FROM ys JOIN langs ON target_lang = lang),
{_one_predictor("run", "tr", "te", "part")},
per_lang AS (
  SELECT string_split(run, '|')[2] AS lang, avg(e) FILTER (WHERE part = 'source') AS s, avg(e) FILTER (WHERE part = 'target') AS t,
    stddev_pop(e) FILTER (WHERE part = 'source') AS ss, stddev_pop(e) FILTER (WHERE part = 'target') AS ts FROM err GROUP BY 1),
cvs AS (SELECT string_split(run, '|')[2] AS lang, avg(cv_rmse) AS c, stddev_pop(cv_rmse) AS cs FROM cv GROUP BY 1)
SELECT lang, round(c, 6) AS cv_rmse, round(cs, 6) AS cv_rmse_se, round(s, 6) AS test_source_rmse, round(t, 6) AS test_target_rmse,
  round(ss, 6) AS test_source_rmse_se, round(ts, 6) AS test_target_rmse_se FROM per_lang JOIN cvs USING (lang)"""


# ---- the other models, random protocol, five seeds, ten folds

PARABOLA = {"cv": 10, "pipeline_type": "grid", "param_space": {"poly_degree": [2], "alpha": [0.0], "l1_ratio": [0.0]}}
# A whole step and no penalty, so that a leaf is the mean of its rows.
_STUMP = {"n_estimators": 1, "subsample": 1.0, "colsample_bytree": 1.0, "eta": 1.0, "learning_rate": 1.0, "reg_lambda": 0.0}
DEPTHWISE_STUMP = {"hpm_search_mode": "grid_search", "cv": 10, "param_space": {"max_depth": [1]}, "fixed_param": {**_STUMP, "min_child_weight": 1}}
LEAFWISE_STUMP = {"hpm_search_mode": "grid_search", "cv": 10, "param_space": {"num_leaves": [2]}, "fixed_param": {**_STUMP, "min_child_samples": 1, "max_bin": 32}}


def _split_sql(head: str) -> str:
    """Random split by the same-domain flag: ``tr`` with folds and ``te``."""
    return f"""{head}, {SEED_ROWS_SQL},
strata AS (SELECT seed, CAST(same_domain AS VARCHAR) AS stratum, count(*) AS n FROM ys GROUP BY ALL),
{allocation_sql("alloc", "strata", "seed", "stratum", "0.3")},
split AS (
  SELECT ys.*, row_number() OVER (PARTITION BY ys.seed, stratum ORDER BY md5(ys.seed || '|' || k)) <= n_test AS is_test
  FROM ys JOIN alloc a ON ys.seed = a.seed AND CAST(ys.same_domain AS VARCHAR) = a.stratum),
side AS (SELECT * FROM split WHERE NOT is_test),
tr AS ({_ranked("side", "seed")}),
te AS (SELECT seed, x, y FROM split WHERE is_test),
parts AS (SELECT unnest([-1, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS part)"""


def _scored(predicted: str) -> str:
    """Errors from ``fit`` (seed, part, ...): part -1 is trained on all rows, others without that fold."""
    return f"""
fold_mse AS (SELECT f.seed, f.part, avg(pow(y - ({predicted}), 2)) AS mse FROM fit f JOIN tr ON tr.seed = f.seed AND tr.fold = f.part GROUP BY ALL),
cv AS (SELECT seed, sqrt(avg(mse)) AS cv_rmse FROM fold_mse GROUP BY seed),
err AS (SELECT f.seed, sqrt(avg(pow(y - ({predicted}), 2))) AS e FROM fit f JOIN te ON te.seed = f.seed WHERE f.part = -1 GROUP BY f.seed)
SELECT {REPEATS} FROM err JOIN cv USING (seed)"""


def polynomial_parabola(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full polynomial of degree 2 on one proxy score, without penalty."""
    return _without_toggles(run(spark, sf_dir, "random", "poly", PARABOLA, [PROXY]).drop("extra"))


PARABOLA_SQL = f"""{_split_sql(_x(LABELLED_SQL))},
mid AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx FROM y),
m AS (
  SELECT tr.seed, part, avg((x - mx) / sx) AS a, avg(pow((x - mx) / sx, 2)) AS b, avg(y) AS c, covar_pop((x - mx) / sx, (x - mx) / sx) AS aa,
    covar_pop((x - mx) / sx, pow((x - mx) / sx, 2)) AS ab, var_pop(pow((x - mx) / sx, 2)) AS bb,
    covar_pop((x - mx) / sx, y) AS ay, covar_pop(pow((x - mx) / sx, 2), y) AS by_
  FROM tr, parts, mid WHERE tr.fold <> part GROUP BY tr.seed, part),
fit AS (
  SELECT seed, part, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS p, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS q,
    c - (ay * bb - by_ * ab) / (aa * bb - ab * ab) * a - (by_ * aa - ay * ab) / (aa * bb - ab * ab) * b AS o, mx, sx FROM m, mid),
{_scored("o + p * (x - mx) / sx + q * pow((x - mx) / sx, 2)")}"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments with the English-target flag as the only feature."""
    rows = ft.complete_rows(table(spark, sf_dir))
    return rows.select(*fx.EXPERIMENT_IDS, "eng_target", "m2m100_ft_spBLEU_mean")


def _stump(spark: SparkSession, sf_dir: str, regressor: str, config: dict) -> DataFrame:
    setup = Setup(dataset="mt560", mode="random", regressor=regressor, model="m2m100", config=config, combos=[PLAIN])
    return _without_toggles(run_experiment(_flags(spark, sf_dir), setup).drop("extra"))


def depthwise_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stump(spark, sf_dir, "xgb", DEPTHWISE_STUMP)


def leafwise_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stump(spark, sf_dir, "lgbm", LEAFWISE_STUMP)


FLAG_SQL = TASK_SQL.replace("trfm_spBLEU_mean AS x, k FROM exp)", "eng_target AS x, k FROM exp)")
STUMP_SQL = f"""{_split_sql(FLAG_SQL)},
fit AS (
  SELECT tr.seed, part, avg(y) FILTER (WHERE x = 0) AS m0, avg(y) FILTER (WHERE x = 1) AS m1
  FROM tr, parts WHERE tr.fold <> part GROUP BY tr.seed, part),
{_scored("CASE WHEN x = 1 THEN m1 ELSE m0 END")}"""

# Several candidates, two settings of the rounds on every path. With one 0/1 column and step e, each round takes the share
# e n / (n + l2) off a leaf's sum above l1.
_SEARCH = {"n_estimators": [1, 3, 8], "step": [0.1, 0.5]}
DEPTHWISE_SEARCH = {
    "hpm_search_mode": "grid_search", "cv": 10, "param_space": {"n_estimators": _SEARCH["n_estimators"], "eta": _SEARCH["step"]},
    "fixed_param": {"max_depth": 3, "min_child_weight": 2, "reg_alpha": 0.2, "reg_lambda": 0.7},
}
LEAFWISE_SEARCH = {
    "hpm_search_mode": "grid_search", "cv": 10, "param_space": {"n_estimators": _SEARCH["n_estimators"], "learning_rate": _SEARCH["step"]},
    "fixed_param": {"num_leaves": 4, "min_child_samples": 3, "reg_alpha": 0.2, "reg_lambda": 0.7},
}


def _searched(spark: SparkSession, sf_dir: str, regressor: str, config: dict, step: str) -> DataFrame:
    setup = Setup(dataset="mt560", mode="random", regressor=regressor, model="m2m100", config=config, combos=[PLAIN])
    found = run_experiment(_flags(spark, sf_dir), setup)
    chosen = [F.col("extra")[k].alias(n) for k, n in (("n_estimators", "rounds"), (step, "step"), ("eng_target_importance", "importance"))]
    return _without_toggles(found.select("*", *chosen).drop("extra"))


def depthwise_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice among six candidates, the chosen settings' means over the seeds, and shares of gain."""
    return _searched(spark, sf_dir, "xgb", DEPTHWISE_SEARCH, "eta")


def leafwise_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same leaf-wise; importances are numbers of splits."""
    return _searched(spark, sf_dir, "lgbm", LEAFWISE_SEARCH, "learning_rate")


def _search_sql(importance: str) -> str:
    options = ", ".join(f"({i}, {k}, {e})" for i, (k, e) in enumerate((k, e) for k in _SEARCH["n_estimators"] for e in _SEARCH["step"]))
    return f"""{_split_sql(FLAG_SQL)},
options(number, rounds, step) AS (VALUES {options}),
learn AS (SELECT tr.seed, part, x, y FROM tr, parts WHERE tr.fold <> part),
mid AS (SELECT seed, part, avg(y) AS base FROM learn GROUP BY seed, part),
leaf AS (SELECT seed, part, x, count(*)::DOUBLE AS n, sum(y - base) AS s, any_value(base) AS base FROM learn JOIN mid USING (seed, part) GROUP BY seed, part, x),
fit AS (
  SELECT seed, part, x, number, rounds, step,
    base + sign(s) / n * greatest(abs(s) - 0.2, 0) * (1 - pow(1 - step * n / (n + 0.7), rounds)) AS guess FROM leaf, options),
fold_mse AS (
  SELECT f.seed, f.number, f.part, avg(pow(y - guess, 2)) AS mse FROM fit f JOIN tr ON tr.seed = f.seed AND tr.fold = f.part AND tr.x = f.x GROUP BY ALL),
scores AS (SELECT seed, number, sqrt(avg(mse)) AS cv_rmse FROM fold_mse GROUP BY seed, number),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY cv_rmse, number) AS r FROM scores) q WHERE r = 1),
cv AS (SELECT seed, cv_rmse, rounds, step FROM best JOIN options USING (number)),
err AS (
  SELECT f.seed, sqrt(avg(pow(y - guess, 2))) AS e FROM fit f JOIN best b ON b.seed = f.seed AND b.number = f.number
  JOIN te ON te.seed = f.seed AND te.x = f.x WHERE f.part = -1 GROUP BY f.seed)
SELECT {REPEATS}, round(avg(rounds), 6) AS rounds, round(avg(step), 6) AS step, round({importance}, 6) AS importance
FROM err JOIN cv USING (seed)"""


DEPTHWISE_SEARCH_SQL = _search_sql("avg(1.0::DOUBLE)")
LEAFWISE_SEARCH_SQL = _search_sql("avg(rounds)")

# Two proxy scores: the second degree has their product.
TWO = ft.Toggles(
    dataset_features=False, lang_features=False, with_trfm=True, with_small100_ft=True, with_small100_noft=False, with_model_noft=False,
)
SURFACE = {"cv": 10, "pipeline_type": "grid", "param_space": {"poly_degree": [1, 2], "alpha": [0.0], "l1_ratio": [0.0]}}


def polynomial_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane or full second degree on two proxy scores, chosen by cross-validation; the chosen degree's mean."""
    found = run(spark, sf_dir, "random", "poly", SURFACE, [TWO])
    return _without_toggles(found.withColumn("degree", F.col("extra")["degree"]).drop("extra"))


def _surface_sql() -> str:
    """Least squares by taking each term out of all later ones and out of the label, on all rows; what is left is the error."""
    head = _split_sql(
        _x(LABELLED_SQL).replace("trfm_spBLEU_mean AS x,", "trfm_spBLEU_mean AS x, small100_ft_spBLEU_mean AS x2,")
    )
    terms = ["1.0", "a", "b", "a * a", "a * b", "b * b"]
    steps = []
    for j in range(len(terms)):
        later = [f"t{k}" for k in range(j + 1, len(terms))] + ["y"]
        shares = ", ".join(f"sum({c} * t{j}) FILTER (WHERE learn) / sum(t{j} * t{j}) FILTER (WHERE learn) AS k_{c}" for c in later)
        kept = ", ".join(f"t{k}" for k in range(j + 1))
        less = ", ".join(f"{c} - k_{c} * t{j} AS {c}" for c in later)
        steps.append(f"c{j} AS MATERIALIZED (SELECT seed, part, {shares} FROM r{j} GROUP BY seed, part)")
        steps.append(f"r{j + 1} AS MATERIALIZED (SELECT seed, part, learn, {kept}, {less} FROM r{j} JOIN c{j} USING (seed, part))")
    return f"""{head},
mid AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(x2) AS my, stddev_pop(x2) AS sy FROM y),
whole AS (
  SELECT tr.seed, part, (x - mx) / sx AS a, (x2 - my) / sy AS b, y, fold <> part AS learn FROM tr, parts, mid
  UNION ALL SELECT split.seed, -1, (x - mx) / sx, (x2 - my) / sy, y, false FROM split, mid WHERE is_test),
r0 AS MATERIALIZED (SELECT seed, part, learn, {", ".join(f"{t} AS t{i}" for i, t in enumerate(terms))}, y FROM whole),
{", ".join(steps)},
wrong AS (
  SELECT seed, part, 1 AS degree, avg(y * y) AS e FROM r3 WHERE NOT learn GROUP BY ALL
  UNION ALL SELECT seed, part, 2, avg(y * y) FROM r6 WHERE NOT learn GROUP BY ALL),
scores AS (SELECT seed, degree, sqrt(avg(e)) AS cv_rmse FROM wrong WHERE part >= 0 GROUP BY seed, degree),
cv AS (SELECT seed, arg_min(degree, cv_rmse) AS degree, min(cv_rmse) AS cv_rmse FROM scores GROUP BY seed),
err AS (SELECT wrong.seed, cv_rmse, cv.degree, sqrt(e) AS e FROM wrong JOIN cv ON cv.seed = wrong.seed AND cv.degree = wrong.degree WHERE part = -1)
SELECT {REPEATS}, round(avg(degree), 6) AS degree FROM err"""


BIASES = {
    "cv": 10, "fixed_param": {"factors": False},
    "param_space": {"beta_z": [0.01], "beta_s": [0.02], "beta_t": [0.05]},
}


def factor_biases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score-matrix model with one side column and biases, without the factor term."""
    return _without_toggles(run(spark, sf_dir, "random", "mf", BIASES, [PROXY], dataset="nusa").drop("extra"))


MATRIX_SQL = _x(LABELLED_SQL).replace(" AS x, k ||", " AS x, source_lang || '_' || dataset_size AS src, k ||")


def _turns(n: int) -> str:
    """``n`` rounds of exact turns on the rows of ``tr``: slope, source biases, target biases."""
    steps = ["turn_0 AS MATERIALIZED (SELECT seed, part, target_lang, src, z, y - mu AS l, 0.0::DOUBLE AS bs, 0.0::DOUBLE AS bt FROM tr JOIN m USING (seed, part))"]
    for k in range(1, n + 1):
        steps.append(f"""turn_{k if k < n else "last"} AS MATERIALIZED (
  SELECT *, sum(l - w * z - bs) OVER (PARTITION BY seed, part, target_lang) / (1.05 * count(*) OVER (PARTITION BY seed, part, target_lang)) AS bt
  FROM (
    SELECT * EXCLUDE (bs, bt), sum(l - w * z - bt) OVER (PARTITION BY seed, part, src) / (1.02 * count(*) OVER (PARTITION BY seed, part, src)) AS bs
    FROM (
      SELECT * {"EXCLUDE (w)" if k > 1 else ""}, sum(z * (l - bs - bt)) OVER (PARTITION BY seed, part)
        / (sum(z * z) OVER (PARTITION BY seed, part) + 0.01 * count(*) OVER (PARTITION BY seed, part)) AS w
      FROM turn_{k - 1}) AS x) AS x)""")
    return ",\n".join(steps)


_TURNS = _turns(150)
BIASES_SQL = f"""{MATRIX_SQL}, {split_sql("source_lang")},
side AS (SELECT * FROM split WHERE NOT is_test),
folded AS ({_ranked("side", "seed")}),
strata2 AS (SELECT seed, source_lang, count(*) AS n FROM side GROUP BY ALL),
{allocation_sql("alloc2", "strata2", "seed", "source_lang", "0.2")},
cells AS (
  SELECT f.*, (x - avg(x) OVER (PARTITION BY f.seed)) / stddev_pop(x) OVER (PARTITION BY f.seed) AS z,
    row_number() OVER (PARTITION BY f.seed, f.source_lang ORDER BY md5(f.seed || '|' || k)) > n_test AS inner_part
  FROM folded f JOIN alloc2 a ON f.seed = a.seed AND f.source_lang = a.source_lang),
spread AS (SELECT seed, avg(x) AS mx, stddev_pop(x) AS sx FROM folded GROUP BY seed),
held AS (SELECT seed, target_lang, src, (x - mx) / sx AS z, y FROM split JOIN spread USING (seed) WHERE is_test),
parts AS (SELECT unnest([-1, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS part),
tr AS (SELECT c.*, part FROM cells c, parts WHERE CASE WHEN part < 0 THEN inner_part ELSE fold <> part END),
m AS (SELECT seed, part, avg(y) AS mu FROM tr GROUP BY seed, part),
{_TURNS},
weight AS (SELECT seed, part, any_value(w) AS w FROM turn_last GROUP BY seed, part),
bt AS (SELECT seed, part, target_lang, any_value(bt) AS b FROM turn_last GROUP BY ALL),
bs AS (SELECT seed, part, src, any_value(bs) AS b FROM turn_last GROUP BY ALL),
asked AS (
  SELECT seed, fold AS part, target_lang, src, z, y FROM cells UNION ALL SELECT seed, -1, target_lang, src, z, y FROM held),
wrong AS (
  SELECT a.seed, a.part, pow(a.y - mu - w * z - coalesce(bt.b, 0) - coalesce(bs.b, 0), 2) AS e2
  FROM asked a JOIN m USING (seed, part) JOIN weight USING (seed, part)
  LEFT JOIN bt ON bt.seed = a.seed AND bt.part = a.part AND bt.target_lang = a.target_lang
  LEFT JOIN bs ON bs.seed = a.seed AND bs.part = a.part AND bs.src = a.src),
mse AS (SELECT seed, part, avg(e2) AS e FROM wrong GROUP BY seed, part),
cv AS (SELECT seed, sqrt(avg(e)) AS cv_rmse FROM mse WHERE part >= 0 GROUP BY seed),
err AS (SELECT seed, sqrt(e) AS e FROM mse WHERE part = -1)
SELECT {REPEATS} FROM err JOIN cv USING (seed)"""

QUERIES = {
    "factor_biases": (factor_biases, BIASES_SQL),
    "proxy_only_unseen": (proxy_only_unseen, UNSEEN_SQL),
    "proxy_only_cross": (proxy_only_cross, CROSS_SQL),
    "proxy_only_incremental": (proxy_only_incremental, INCREMENTAL_SQL),
    "proxy_only_task_random": (proxy_only_task_random, TASK_RANDOM_SQL),
    "proxy_only_task_lolo": (proxy_only_task_lolo, TASK_LOLO_SQL),
    "polynomial_parabola": (polynomial_parabola, PARABOLA_SQL),
    "polynomial_surface": (polynomial_surface, _surface_sql()),
    "depthwise_search": (depthwise_search, DEPTHWISE_SEARCH_SQL),
    "leafwise_search": (leafwise_search, LEAFWISE_SEARCH_SQL),
    "depthwise_stump": (depthwise_stump, STUMP_SQL),
    "leafwise_stump": (leafwise_stump, STUMP_SQL),
}
