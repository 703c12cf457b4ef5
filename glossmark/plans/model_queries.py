"""Registered performance-prediction experiments.

Experiments on a single predictor have a closed form and are checked in SQL; the others
are compared with direct computations in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.operators import features as ft
from glossmark.plans import fixtures as fx
from glossmark.plans.corpus_queries import rounded
from glossmark.plans.regression import Setup, run_experiment
from glossmark.plans.table_queries import LABELLED_SQL, LANGS_SQL, SEED_ROWS_SQL, UNSEEN, allocation_sql

ALL = ft.Toggles(with_small100_noft=False, with_model_noft=False)
BASELINE = ft.Toggles(
    nlperf_only=True, dataset_features=False, lang_features=False, with_trfm=False,
    with_small100_ft=False, with_small100_noft=False, with_model_noft=False,
)
PROXY = ft.Toggles(
    dataset_features=False, lang_features=False, with_trfm=True,
    with_small100_ft=False, with_small100_noft=False, with_model_noft=False,
)
BASIC = {"cv": 10, "pipeline_type": "basic", "degree": 2}
# The published searches. The factorisation's learning rate, its decay and its epochs change nothing.
DEPTHWISE = {
    "hpm_search_mode": "bayes_search", "cv": 10, "n_iter": 50,
    "param_space": {
        "n_estimators": {"type": "Categorical", "low": 2000, "high": 5000, "step": 250, "prior": "uniform"},
        "eta": {"type": "Real", "low": 0.01, "high": 0.1, "prior": "log-uniform"},
    },
    "fixed_param": {
        "n_estimators": 2250, "eta": 0.1, "min_child_weight": 5.0, "max_depth": 5, "gamma": 0.0, "subsample": 0.6,
        "colsample_bytree": 0.83, "reg_alpha": 0.2, "reg_lambda": 0.1,
    },
}
LEAFWISE = {
    "hpm_search_mode": "grid_search", "cv": 10, "n_iter": 25,
    "param_space": {"learning_rate": [0.03, 0.1, 0.3], "num_leaves": [16, 32, 64]},
    "fixed_param": {
        "n_estimators": 100, "max_bin": 200000, "max_depth": 10, "min_child_weight": 0.001, "min_child_samples": 20,
        "min_split_gain": 0.0, "colsample_bytree": 1.0, "subsample": 1.0, "reg_alpha": 0.1, "reg_lambda": 0.1,
    },
}
FACTORS = {
    "cv": 10,
    "param_space": {"alpha": [0.001, 0.01], "beta_w": [0.1], "beta_h": [0.1], "beta_z": [0.01, 0.1], "beta_s": [0.01], "beta_t": [0.01]},
    "fixed_param": {"lr_decay": 0.001, "iterations": 2000},
}
# No grid is published for the polynomial model.
GRID = {"cv": 10, "pipeline_type": "grid", "param_space": {"poly_degree": [1, 2], "alpha": [0.1], "l1_ratio": [0.9]}}
HIDDEN = ["nlperf_only", "dataset_features", "lang_features", "with_trfm", "with_small100_ft", "with_small100_noft", "with_model_noft"]


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.experiments(spark, sf_dir)


def task_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The experiment table under the names of the intent task."""
    rows = fx.experiments(spark, sf_dir)
    return rows.select(
        *fx.EXPERIMENT_IDS, "genetic", "geographic", "syntactic", "train_word_vocab_size", "avg_train_sentence_length",
        "ttr_train", "ttr_test", F.col("trfm_spBLEU_mean").alias("smollm_135m_accuracy"),
        F.col("small100_ft_spBLEU_mean").alias("bloomz_560m_accuracy"), F.col("m2m100_ft_spBLEU_mean").alias("aya_accuracy"),
    )


def run(spark: SparkSession, sf_dir: str, mode: str, regressor: str, config: dict, combos, dataset="mt560", **more) -> DataFrame:
    setup = Setup(dataset=dataset, mode=mode, regressor=regressor, model="m2m100", config=config, combos=combos, unseen=UNSEEN, **more)
    return run_experiment(table(spark, sf_dir), setup)


def elastic_net_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "random", "poly", BASIC, [ALL, BASELINE])


def elastic_net_lolo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All languages, five seeds, ten folds, two feature sets: one pass over the rows."""
    return run(spark, sf_dir, "lolo", "poly", BASIC, [ALL, BASELINE])


def elastic_net_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "unseen", "poly", BASIC, [ALL])


def elastic_net_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "incremental", "poly", BASIC, [ALL])


def elastic_net_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = fx.sales(spark, sf_dir)
    setup = Setup(dataset="mt560", mode="cross_dataset", regressor="poly", model="m2m100", config=BASIC, combos=[ALL])
    train = fx.experiments_from(sales.filter("l_returnflag <> 'R'"))
    return run_experiment(train, setup, fx.experiments_from(sales.filter("l_returnflag = 'R'")))


def elastic_net_task_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    combo = ft.TaskToggles(with_smollm_360m=False)
    setup = Setup(dataset="intent", mode="random", regressor="poly", model="aya", config=BASIC, combos=[combo])
    return run_experiment(task_table(spark, sf_dir), setup)


def elastic_net_task_lolo(spark: SparkSession, sf_dir: str) -> DataFrame:
    combo = ft.TaskToggles(with_smollm_360m=False)
    setup = Setup(dataset="slot", mode="lolo", regressor="poly", model="aya", config=BASIC, combos=[combo])
    names = {f"{m}_accuracy": f"{m}_f1" for m in ("smollm_135m", "bloomz_560m", "aya")}
    return run_experiment(task_table(spark, sf_dir).withColumnsRenamed(names), setup)


def depthwise_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "random", "xgb", DEPTHWISE, [ALL])


def leafwise_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "lolo", "lgbm", LEAFWISE, [ALL])


def matrix_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "random", "mf", FACTORS, [ALL], dataset="nusa")


def polynomial_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "random", "poly", GRID, [ALL])


def _without_toggles(df: DataFrame) -> DataFrame:
    out = df.drop(*HIDDEN)
    return rounded(out, [c for c, t in out.dtypes if t == "double"])


ONE = {"cv": 10, "pipeline_type": "basic", "degree": 1}


def proxy_only_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One proxy score as the only predictor, five seeds, ten folds."""
    return _without_toggles(run(spark, sf_dir, "random", "poly", ONE, [PROXY]))


def proxy_only_lolo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One proxy score as the only predictor, every language held out in turn."""
    return _without_toggles(run(spark, sf_dir, "lolo", "poly", ONE, [PROXY]))


def _x(sql: str) -> str:
    """The labelled rows with the proxy score as ``x`` and the experiment table's own key."""
    return sql.replace(
        f"{fx.EXPERIMENTS_SQL}, y AS (SELECT source_lang, target_lang, train_dataset = test_dataset AS same_domain, m2m100_ft_spBLEU_mean AS y, k FROM exp)",
        f"{fx.EXPERIMENTS_SQL}, y AS (SELECT source_lang, target_lang, train_dataset = test_dataset AS same_domain, "
        "m2m100_ft_spBLEU_mean AS y, trfm_spBLEU_mean AS x, k || '|' || dataset_size AS k FROM exp)",
    )


def _fold(rank: str, n: str) -> str:
    return (
        f"CASE WHEN {rank} < ({n} % 10) * ({n} // 10 + 1) THEN {rank} // ({n} // 10 + 1) "
        f"ELSE {n} % 10 + ({rank} - ({n} % 10) * ({n} // 10 + 1)) // greatest({n} // 10, 1) END"
    )


# One predictor z: w = shrink(cov(z, y), 0.09) / (var(z) + 0.01), intercept from the means.
def _slope(cov: str, var: str) -> str:
    return f"(sign({cov}) * greatest(abs({cov}) - 0.09, 0) / ({var} + 0.01))"


def _one_predictor(runs: str, train: str, tests: str, part: str) -> str:
    """Errors per run from ``train`` (run, fold, x, y) and ``tests`` (run, part, x, y)."""
    return f"""
st AS (SELECT {runs}, avg(x) AS mu, stddev_pop(x) AS sd, avg(y) AS my FROM {train} GROUP BY {runs}),
z AS (SELECT t.* EXCLUDE (x), (x - mu) / sd AS z FROM {train} t JOIN st USING ({runs})),
whole AS (SELECT {runs}, covar_pop(z, y) AS c, var_pop(z) AS v, avg(z) AS mz, avg(y) AS my FROM z GROUP BY {runs}),
f AS (SELECT {runs}, fold, count(*)::DOUBLE AS n, sum(z) AS sz, sum(y) AS sy, sum(z * z) AS szz, sum(z * y) AS szy, sum(y * y) AS syy
  FROM z GROUP BY {runs}, fold),
tot AS (SELECT {runs}, sum(n) AS n, sum(sz) AS sz, sum(sy) AS sy, sum(szz) AS szz, sum(szy) AS szy FROM f GROUP BY {runs}),
o AS (
  SELECT f.*, t.n - f.n AS tn, (t.sz - f.sz) / (t.n - f.n) AS tz, (t.sy - f.sy) / (t.n - f.n) AS ty,
    (t.szz - f.szz) / (t.n - f.n) AS tzz, (t.szy - f.szy) / (t.n - f.n) AS tzy FROM f JOIN tot t USING ({runs})),
w AS (SELECT *, {_slope("(tzy - tz * ty)", "(tzz - tz * tz)")} AS w FROM o),
wb AS (SELECT *, ty - w * tz AS b FROM w),
cv AS (
  SELECT {runs}, sqrt(avg((syy + w * w * szz + n * b * b - 2 * w * szy - 2 * b * sy + 2 * w * b * sz) / n)) AS cv_rmse
  FROM wb GROUP BY {runs}),
model AS (SELECT {runs}, {_slope("c", "v")} AS w, my - {_slope("c", "v")} * mz AS b FROM whole),
err AS (
  SELECT {runs}, {part}, sqrt(avg(pow(y - b - w * (x - mu) / sd, 2))) AS e
  FROM {tests} JOIN st USING ({runs}) JOIN model USING ({runs}) GROUP BY {runs}, {part})"""


PROXY_RANDOM_SQL = f"""{_x(LABELLED_SQL)}, {SEED_ROWS_SQL},
strata AS (SELECT seed, CAST(same_domain AS VARCHAR) AS stratum, count(*) AS n FROM ys GROUP BY ALL),
{allocation_sql("alloc", "strata", "seed", "stratum", "0.3")},
split AS (
  SELECT ys.*, row_number() OVER (PARTITION BY ys.seed, stratum ORDER BY md5(ys.seed || '|' || k)) <= n_test AS is_test
  FROM ys JOIN alloc a ON ys.seed = a.seed AND CAST(ys.same_domain AS VARCHAR) = a.stratum),
tr AS (
  SELECT seed, x, y, {_fold("r", "n")} AS fold FROM (
    SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|' || k)) - 1 AS r, count(*) OVER (PARTITION BY seed) AS n
    FROM split WHERE NOT is_test) q),
te AS (SELECT seed, 'test' AS part, x, y FROM split WHERE is_test),
{_one_predictor("seed", "tr", "te", "part")}
SELECT round(avg(cv_rmse), 6) AS cv_rmse, round(avg(e), 6) AS test_rmse,
  round(stddev_pop(cv_rmse), 6) AS cv_rmse_se, round(stddev_pop(e), 6) AS test_rmse_se FROM err JOIN cv USING (seed)"""

PROXY_LOLO_SQL = f"""{_x(LABELLED_SQL)}, {SEED_ROWS_SQL}, {LANGS_SQL},
left_out AS (SELECT ys.*, lang FROM ys, langs WHERE source_lang <> lang AND target_lang <> lang),
tr AS (
  SELECT seed || '|' || lang AS run, x, y, {_fold("r", "n")} AS fold FROM (
    SELECT *, row_number() OVER (PARTITION BY seed, lang ORDER BY md5(seed || '|' || k)) - 1 AS r, count(*) OVER (PARTITION BY seed, lang) AS n
    FROM left_out) q),
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


QUERIES = {
    "proxy_only_random": (proxy_only_random, PROXY_RANDOM_SQL),
    "proxy_only_lolo": (proxy_only_lolo, PROXY_LOLO_SQL),
    "elastic_net_random": (elastic_net_random, None),
    "elastic_net_lolo": (elastic_net_lolo, None),
    "elastic_net_unseen": (elastic_net_unseen, None),
    "elastic_net_incremental": (elastic_net_incremental, None),
    "elastic_net_cross": (elastic_net_cross, None),
    "elastic_net_task_random": (elastic_net_task_random, None),
    "elastic_net_task_lolo": (elastic_net_task_lolo, None),
    "depthwise_trees": (depthwise_trees, None),
    "leafwise_trees": (leafwise_trees, None),
    "matrix_factors": (matrix_factors, None),
    "polynomial_grid": (polynomial_grid, None),
}
