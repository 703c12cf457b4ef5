"""Registered experiment-table queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.functions.keys import cell_key
from glossmark.operators import features as ft
from glossmark.operators import splits as sp
from glossmark.operators import summary as sm
from glossmark.operators import transforms as tf
from glossmark.plans import fixtures as fx
from glossmark.plans.corpus_queries import rounded
from glossmark.session import join_bounded, stage
from glossmark.sources import tables

LABEL = "m2m100_ft_spBLEU_mean"
UNSEEN = ["L00", "L05", "L10", "L15", "L20"]
KEY = "k"
EXP = fx.EXPERIMENTS_SQL


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete experiment rows with their key, staged."""
    return stage(ft.complete_rows(fx.experiments(spark, sf_dir)).withColumn(KEY, fx.experiment_key()), "experiments")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the columns the split queries need, staged."""
    rows = ft.complete_rows(fx.experiments(spark, sf_dir))
    same = (F.col("train_dataset") == F.col("test_dataset")).alias("same_domain")
    return stage(
        rows.select("source_lang", "target_lang", same, F.col(LABEL).alias("y"), fx.experiment_key().alias(KEY)), "labels"
    )


LABELLED_SQL = f"{EXP}, y AS (SELECT source_lang, target_lang, train_dataset = test_dataset AS same_domain, {LABEL} AS y, k FROM exp)"


def allocation_sql(name: str, source: str, runs: str, stratum: str, share: str) -> str:
    """Test rows per stratum, from ``source`` with ``runs``, ``stratum`` and ``n``."""
    over = f"OVER (PARTITION BY {runs})" if runs else "OVER ()"
    lead = f"{runs}, " if runs else ""
    part = f"PARTITION BY {runs}" if runs else ""
    return f"""
{name}_a AS (SELECT {lead}{stratum}, n, (sum(n) {over})::BIGINT AS big,
  (sum(n) {over})::BIGINT - CAST(ceil(round({share} * sum(n) {over}, 9)) AS BIGINT) AS tr FROM {source}),
{name}_b AS (SELECT *, (n * tr) // big AS fl, (n * tr) % big AS re FROM {name}_a),
{name} AS (
  SELECT {lead}{stratum}, n, n - fl - CASE WHEN row_number() OVER ({part} ORDER BY re DESC, {stratum})
    <= tr - (sum(fl) {over})::BIGINT THEN 1 ELSE 0 END AS n_test FROM {name}_b)"""


SEED_ROWS_SQL = "seeds AS (SELECT unnest([42, 43, 44, 45, 46]) AS seed), ys AS (SELECT * FROM y, seeds)"


def split_sql(stratum: str) -> str:
    return f"""{SEED_ROWS_SQL},
strata AS (SELECT seed, {stratum}, count(*) AS n FROM ys GROUP BY seed, {stratum}),
{allocation_sql("alloc", "strata", "seed", stratum, "0.3")},
split AS (
  SELECT ys.*, row_number() OVER (PARTITION BY ys.seed, ys.{stratum} ORDER BY md5(ys.seed || '|' || k)) <= n_test AS is_test
  FROM ys JOIN alloc a ON ys.seed = a.seed AND ys.{stratum} = a.{stratum})"""


def seeded_splits(spark: SparkSession, sf_dir: str, strata: list[str]) -> DataFrame:
    rows = sp.repeat_seeds(labelled(spark, sf_dir))
    return sp.random_split(rows, ["seed"], strata, F.col(KEY), F.col("seed"))


def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified by source language, five seeds."""
    return seeded_splits(spark, sf_dir, ["source_lang"]).select("seed", KEY, F.col("is_test").cast("int").alias("is_test"))


SPLIT_SQL = f"{LABELLED_SQL}, {split_sql('source_lang')} SELECT seed, k, is_test::INTEGER AS is_test FROM split"


def split_same_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified by the same-domain flag: two strata hold all rows."""
    return seeded_splits(spark, sf_dir, ["same_domain"]).select("seed", KEY, F.col("is_test").cast("int").alias("is_test"))


SPLIT_DOMAIN_SQL = f"{LABELLED_SQL}, {split_sql('same_domain')} SELECT seed, k, is_test::INTEGER AS is_test FROM split"


def split_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sp.repeat_seeds(labelled(spark, sf_dir))
    split = sp.incremental_split(rows, ["seed"], ["same_domain"], F.col(KEY), F.col("seed"))
    return split.groupBy("seed", "portion", "same_domain").agg(
        F.count(F.lit(1)).alias("n"), F.min(KEY).alias("first_key"), F.round(F.sum("y"), 4).alias("y_sum")
    )


PORTIONS_SQL = f"""{split_sql('same_domain')},
train AS (SELECT * FROM split WHERE NOT is_test),
portions AS (SELECT unnest([0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 0.9]::DOUBLE[]) AS portion),
pstrata AS (SELECT seed, portion, same_domain, count(*) AS n FROM train, portions GROUP BY seed, portion, same_domain),
{allocation_sql("take", "pstrata", "seed, portion", "same_domain", "portion")},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY seed, same_domain ORDER BY md5(seed || '|portion|' || k)) AS r FROM train),
chosen AS (
  SELECT r.seed, t.portion, r.same_domain, r.k, r.y FROM ranked r
  JOIN take t ON r.seed = t.seed AND r.same_domain = t.same_domain AND r.r <= t.n_test
  UNION ALL SELECT seed, NULL, same_domain, k, y FROM split WHERE is_test)"""
INCREMENTAL_SQL = f"""{LABELLED_SQL}, {PORTIONS_SQL}
SELECT seed, portion, same_domain, count(*) AS n, min(k) AS first_key, round(sum(y), 4) AS y_sum
FROM chosen GROUP BY seed, portion, same_domain"""


def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.kfold(labelled(spark, sf_dir), [], F.col(KEY), 42).select(KEY, "fold")


KFOLD_SQL = f"""{LABELLED_SQL},
r AS (SELECT k, row_number() OVER (ORDER BY md5('42|' || k)) - 1 AS r, count(*) OVER () AS n FROM y)
SELECT k, CASE WHEN r < (n % 10) * (n // 10 + 1) THEN r // (n // 10 + 1)
  ELSE n % 10 + (r - (n % 10) * (n // 10 + 1)) // (n // 10) END::INTEGER AS fold FROM r"""


def shuffle_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.seeded_order(labelled(spark, sf_dir), F.col(KEY), 43).select(KEY, F.col("position").cast("long").alias("position"))


SHUFFLE_SQL = f"{LABELLED_SQL} SELECT k, row_number() OVER (ORDER BY md5('43|' || k)) AS position FROM y"


def split_lolo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per held-out language: training by complement, tests by role."""
    rows = labelled(spark, sf_dir)
    whole = rows.agg(F.count(F.lit(1)).alias("_total"))
    touched = sp.touching(rows).groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    roles = sp.role_rows(rows).groupBy("lang").agg(
        F.count(F.when(F.col("role") == "source", 1)).alias("n_source"),
        F.count(F.when(F.col("role") == "target", 1)).alias("n_target"),
    )
    langs = sp.languages(rows)
    return (
        langs.join(touched, "lang").join(roles, "lang").crossJoin(F.broadcast(whole))
        .select("lang", (F.col("_total") - F.col("_n")).alias("n_train"), "n_source", "n_target")
    )


LANGS_SQL = "langs AS (SELECT DISTINCT source_lang AS lang FROM y WHERE source_lang <> 'eng')"
LOLO_SQL = f"""{LABELLED_SQL}, {LANGS_SQL}
SELECT lang, count(*) FILTER (WHERE source_lang <> lang AND target_lang <> lang) AS n_train,
  count(*) FILTER (WHERE source_lang = lang) AS n_source, count(*) FILTER (WHERE target_lang = lang) AS n_target
FROM langs, y GROUP BY lang"""


def split_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of the seen/unseen protocol, rows per language and role."""
    rows = labelled(spark, sf_dir)
    langs = sp.languages(rows)
    parts = []
    for seen, table in ((True, sp.unseen_languages(langs, UNSEEN)), (False, sp.seen_languages(langs, UNSEEN))):
        train = sp.without_languages(rows, table).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("train").alias("role"), F.lit("*").alias("lang"), "n"
        )
        tests = sp.role_rows(rows).join(table, "lang", "left_semi").groupBy("role", "lang").agg(F.count(F.lit(1)).alias("n"))
        parts.append(train.unionByName(tests).withColumn("train_is_seen", F.lit(seen)))
    return sm.append(parts)


_UNSEEN_LIST = ", ".join(f"'{x}'" for x in UNSEEN)
UNSEEN_SQL = f"""{LABELLED_SQL}, {LANGS_SQL},
dirs AS (SELECT lang, lang IN ({_UNSEEN_LIST}) AS train_is_seen FROM langs),
d AS (SELECT unnest([true, false]) AS train_is_seen),
train AS (
  SELECT d.train_is_seen, count(*) AS n FROM d, y
  WHERE source_lang NOT IN (SELECT lang FROM dirs WHERE dirs.train_is_seen = d.train_is_seen)
    AND target_lang NOT IN (SELECT lang FROM dirs WHERE dirs.train_is_seen = d.train_is_seen) GROUP BY d.train_is_seen)
SELECT d.train_is_seen, 'train' AS role, '*' AS lang, coalesce(n, 0) AS n FROM d LEFT JOIN train t ON d.train_is_seen = t.train_is_seen
UNION ALL SELECT train_is_seen, 'source', lang, count(*) FROM dirs JOIN y ON source_lang = lang GROUP BY 1, 3
UNION ALL SELECT train_is_seen, 'target', lang, count(*) FROM dirs JOIN y ON target_lang = lang GROUP BY 1, 3"""


def _cross(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sales = fx.sales(spark, sf_dir)
    train = ft.complete_rows(fx.experiments_from(sales.filter("l_returnflag <> 'R'")))
    test = ft.complete_rows(fx.experiments_from(sales.filter("l_returnflag = 'R'")))
    return train, test


def split_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features of two tables, without the English-target flag; constants stay."""
    train, test = _cross(spark, sf_dir)
    toggles = ft.Toggles(with_small100_noft=False, with_model_noft=False)
    columns = ft.select_features(train.columns, "m2m100", "spBLEU", toggles, disable_eng_target=True)
    left, right = sp.cross_tables(
        train.withColumn(KEY, fx.experiment_key()), test.withColumn(KEY, fx.experiment_key()), [KEY, *columns]
    )
    both = left.withColumn("part", F.lit("train")).unionByName(right.withColumn("part", F.lit("test")))
    return rounded(both, ["train_word_vocab_size", "avg_train_sentence_length"], 9)


_CROSS_COLUMNS = "dataset_size, genetic, geographic, syntactic, test_size, round(train_word_vocab_size, 9) AS train_word_vocab_size, round(avg_train_sentence_length, 9) AS avg_train_sentence_length, ttr_train, ttr_test, trfm_spBLEU_mean, small100_ft_spBLEU_mean"
CROSS_TABLES_SQL = f"WITH {fx.SALES_SQL}, {fx.experiments_sql('cross_train', chr(39).join(['l_returnflag <> ', 'R', '']))}, {fx.experiments_sql('cross_test', chr(39).join(['l_returnflag = ', 'R', '']))}"
CROSS_SQL = f"""{CROSS_TABLES_SQL}
SELECT k, {_CROSS_COLUMNS}, 'train' AS part FROM cross_train WHERE trfm_spBLEU_mean IS NOT NULL
UNION ALL SELECT k, {_CROSS_COLUMNS}, 'test' FROM cross_test WHERE trfm_spBLEU_mean IS NOT NULL"""


def drop_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.drop_constant(complete(spark, sf_dir)).drop("m2m100_ft_spBLEU_se")


DROP_SQL = f"""{EXP}
SELECT k, source_lang, target_lang, train_dataset, test_dataset, dataset_size, genetic, geographic, syntactic,
  train_word_vocab_size, avg_train_sentence_length, ttr_train, ttr_test, eng_target::INTEGER AS eng_target,
  trfm_spBLEU_mean, small100_ft_spBLEU_mean, m2m100_ft_spBLEU_mean FROM exp"""


def feature_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language features and two proxies only, with the standard errors in use."""
    rows = ft.drop_constant(complete(spark, sf_dir))
    toggles = ft.Toggles(dataset_features=False, with_small100_noft=False, with_model_noft=False)
    columns = ft.select_features(rows.columns, "m2m100", "spBLEU", toggles, with_ids=True)
    errors = [c for c in ft.se_columns("m2m100", "spBLEU", toggles) if c in rows.columns]
    label = F.col(ft.label_column("m2m100", "spBLEU")).alias("label")
    return rounded(rows.select(KEY, *columns, *errors, label), errors)


FEATURE_SQL = f"""{EXP}
SELECT k, source_lang, target_lang, dataset_size, genetic, geographic, syntactic, trfm_spBLEU_mean, small100_ft_spBLEU_mean,
  round(m2m100_ft_spBLEU_se, 6) AS m2m100_ft_spBLEU_se, m2m100_ft_spBLEU_mean AS label FROM exp"""


def code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First long code in file order per language code; unknown codes keep null."""
    nations = fx.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("L"), F.lpad((F.col("n_nationkey") % 20).cast("string"), 2, "0")).alias("code"),
        F.when(F.col("n_nationkey") % 7 != 3, F.lower("n_name")).alias("long_code"),
        F.col("n_nationkey").alias("line_no"),
    )
    mapping = tables.first_code(nations, "code", "long_code", "line_no").withColumnRenamed("code", "source_lang")
    rows = fx.sales(spark, sf_dir).select("l_orderkey", "l_linenumber", "source_lang")
    return join_bounded(rows, mapping, ["source_lang"], "left")


CODE_SQL = f"""WITH {fx.SALES_SQL},
m AS (
  SELECT 'L' || lpad(CAST(n_nationkey % 20 AS VARCHAR), 2, '0') AS code,
    CASE WHEN n_nationkey % 7 <> 3 THEN lower(n_name) END AS long_code,
    row_number() OVER (PARTITION BY n_nationkey % 20 ORDER BY n_nationkey) AS r FROM nation)
SELECT l_orderkey, l_linenumber, source_lang, long_code FROM sales LEFT JOIN (SELECT * FROM m WHERE r = 1) f ON source_lang = code"""


def language_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances joined by language pair; pairs without an entry keep null."""
    rows = fx.sales(spark, sf_dir).select("l_orderkey", "l_linenumber", "source_lang", "target_lang", "sn", "cn")
    pairs = fx.sales(spark, sf_dir).filter("(sn + cn) % 3 <> 0").select(
        "source_lang", "target_lang", (F.abs(F.col("sn") - F.col("cn")) / 25).alias("genetic")
    ).distinct()
    return ft.add_language_features(rows.drop("sn", "cn"), pairs)


LANGUAGE_SQL = f"""WITH {fx.SALES_SQL}
SELECT l_orderkey, l_linenumber, source_lang, target_lang, CASE WHEN (sn + cn) % 3 <> 0 THEN abs(sn - cn) / 25.0 END AS genetic,
  CASE WHEN target_lang = 'eng' THEN 1 ELSE 0 END::INTEGER AS eng_target FROM sales"""


def context_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side information of each cell by its key; every cell must have an entry."""
    rows = complete(spark, sf_dir)
    cell = cell_key(F.col("source_lang"), F.col("dataset_size"), F.col("target_lang"))
    context = rows.groupBy(cell.alias("cell")).agg(F.max("genetic").alias("genetic"), F.max("syntactic").alias("syntactic"))
    return ft.lookup_or_fail(rows.select(KEY, cell.alias("cell")), context, ["cell"])


CONTEXT_SQL = f"""{EXP}
SELECT k, source_lang || '_' || dataset_size || '_' || target_lang AS cell, genetic, syntactic FROM exp"""


SCALE = ["genetic", "dataset_size", "test_size", "ttr_train", "small100_ft_spBLEU_mean"]


def scale_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = complete(spark, sf_dir).select(KEY, "eng_target", *SCALE)
    return rounded(tf.scale(rows, tf.scaler(rows, SCALE), SCALE), SCALE)


def _scale_sql(columns: dict[str, str]) -> str:
    stats = ", ".join(f'avg({e}) AS "{n}_m", stddev_pop({e}) AS "{n}_s"' for n, e in columns.items())
    out = ", ".join(
        f'round(({e} - "{n}_m") / CASE WHEN "{n}_s" <= abs("{n}_m") * 1e-12 THEN 1 ELSE "{n}_s" END, 6) AS "{n}"'
        for n, e in columns.items()
    )
    return f"{EXP}, st AS (SELECT {stats} FROM exp) SELECT k, eng_target::INTEGER AS eng_target, {out} FROM exp, st"


SCALE_SQL = _scale_sql({c: c for c in SCALE})
POWERS = ["genetic", "ttr_train", "small100_ft_spBLEU_mean"]


def power_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubic expansion, scaled after expanding; the flag passes through."""
    rows = tf.power_expand(complete(spark, sf_dir).select(KEY, "eng_target", *POWERS), [*POWERS, "eng_target"], 3)
    names = tf.scalable(tf.power_names(POWERS, 3))
    scaled = tf.scale(rows, tf.scaler(rows, names), names)
    scaled = scaled.select(*[F.col(f"`{c}`").alias(c.replace("^", "_pow")) for c in scaled.columns])
    return rounded(scaled, [c.replace("^", "_pow") for c in names])


POWER_SQL = _scale_sql({(c if d == 1 else f"{c}_pow{d}"): f"pow({c}, {d})" for d in (1, 2, 3) for c in POWERS})


def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf.score_matrix(complete(spark, sf_dir), LABEL, KEY)


MATRIX_SQL = f"""{EXP}
SELECT source_lang || '_' || dataset_size AS src_key, target_lang, arg_max({LABEL}, k) AS score FROM exp GROUP BY ALL"""


def lolo_rmse_mean_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-language-out error of the training mean, all languages in one pass.

    Training sums are the total minus the held-out language's rows, so no row is copied
    per language.
    """
    rows = labelled(spark, sf_dir)
    whole = rows.agg(F.count(F.lit(1)).alias("_total"), F.sum("y").alias("_total_sum"))
    out = sp.touching(rows).groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_s"))
    means = out.crossJoin(F.broadcast(whole)).selectExpr("lang", "(_total_sum - _s) / nullif(_total - _n, 0) AS m")
    roles = sp.role_rows(rows).groupBy("lang", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")
    )
    scores = roles.join(means, "lang").selectExpr("lang", "role", "sqrt(greatest(q - 2 * m * s + n * m * m, 0) / n) AS rmse")
    table = sm.language_summary(scores, [], sp.languages(rows))
    return rounded(table.drop("test_source_rmse_se", "test_target_rmse_se"), ["test_source_rmse", "test_target_rmse"])


LOLO_RMSE_SQL = f"""{LABELLED_SQL}, {LANGS_SQL},
m AS (SELECT lang, avg(y) FILTER (WHERE source_lang <> lang AND target_lang <> lang) AS m FROM langs, y GROUP BY lang)
SELECT lang, round(sqrt(avg(pow(y - m, 2)) FILTER (WHERE source_lang = lang)), 6) AS test_source_rmse,
  round(sqrt(avg(pow(y - m, 2)) FILTER (WHERE target_lang = lang)), 6) AS test_target_rmse FROM m, y GROUP BY lang"""


def seen_unseen_rmse_mean_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training mean without the unseen languages, tested per language and role."""
    rows = labelled(spark, sf_dir)
    train, tests = sp.seen_unseen(rows, UNSEEN)
    mean = train.agg(F.avg("y").alias("m"))
    scores = tests.crossJoin(F.broadcast(mean)).groupBy("lang", "role").agg(sm.rmse(F.col("y"), F.col("m")).alias("rmse"))
    wide = sm.wide_languages(scores, [], UNSEEN)
    return rounded(wide, wide.columns)


_U = ", ".join(
    f'round(max(rmse) FILTER (WHERE role = \'{r}\' AND lang = \'{x}\'), 6) AS "test_{r}_{x}_rmse", '
    f'CASE WHEN count(*) FILTER (WHERE role = \'{r}\' AND lang = \'{x}\') > 0 THEN 0.0::DOUBLE END AS "test_{r}_{x}_rmse_se"'
    for x in UNSEEN
    for r in ("source", "target")
)
UNSEEN_RMSE_SQL = f"""{LABELLED_SQL},
m AS (SELECT avg(y) AS m FROM y WHERE source_lang NOT IN ({_UNSEEN_LIST}) AND target_lang NOT IN ({_UNSEEN_LIST})),
s AS (
  SELECT 'source' AS role, source_lang AS lang, sqrt(avg(pow(y - m, 2))) AS rmse FROM y, m WHERE source_lang IN ({_UNSEEN_LIST}) GROUP BY source_lang
  UNION ALL SELECT 'target', target_lang, sqrt(avg(pow(y - m, 2))) FROM y, m WHERE target_lang IN ({_UNSEEN_LIST}) GROUP BY target_lang)
SELECT round(avg(rmse) FILTER (WHERE role = 'source'), 6) AS test_source_rmse,
  round(avg(rmse) FILTER (WHERE role = 'target'), 6) AS test_target_rmse, {_U} FROM s"""


def _mean_rmse(split: DataFrame, runs: list[str]) -> DataFrame:
    """Test error of the training mean per run, from sums."""
    return (
        split.groupBy(*runs)
        .agg(
            F.avg(F.when(~F.col("is_test"), F.col("y"))).alias("m"),
            F.count(F.when(F.col("is_test"), 1)).alias("n"),
            F.sum(F.when(F.col("is_test"), F.col("y"))).alias("s"),
            F.sum(F.when(F.col("is_test"), F.col("y") * F.col("y"))).alias("q"),
        )
        .selectExpr(*runs, "sqrt(greatest(q - 2 * m * s + n * m * m, 0) / n) AS test_rmse")
    )


def random_repeat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over five seeds, for both kinds of strata."""
    parts = []
    for stratum in ("same_domain", "source_lang"):
        scores = _mean_rmse(seeded_splits(spark, sf_dir, [stratum]), ["seed"])
        parts.append(sm.tagged(sm.repeat_summary(scores, [], ["test_rmse"]), {"stratum": stratum}))
    return rounded(sm.append(parts), ["test_rmse", "test_rmse_se"])


def _repeat_sql(stratum: str) -> str:
    return f"""SELECT round(avg(e), 6) AS test_rmse, round(stddev_pop(e), 6) AS test_rmse_se, '{stratum}' AS stratum FROM (
  {LABELLED_SQL}, {split_sql(stratum)}, m AS (SELECT seed, avg(y) AS m FROM split WHERE NOT is_test GROUP BY seed)
  SELECT split.seed, sqrt(avg(pow(y - m, 2))) AS e FROM split JOIN m ON split.seed = m.seed WHERE is_test GROUP BY split.seed) x"""


REPEAT_SQL = f"{_repeat_sql('same_domain')} UNION ALL {_repeat_sql('source_lang')}"


def incremental_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the training mean by training portion, over five seeds."""
    rows = sp.repeat_seeds(labelled(spark, sf_dir))
    split = stage(sp.incremental_split(rows, ["seed"], ["same_domain"], F.col(KEY), F.col("seed")), "portions")
    means = split.filter("portion IS NOT NULL").groupBy("seed", "portion").agg(
        F.avg("y").alias("m"), F.count(F.lit(1)).alias("train_regressor_size")
    )
    tests = split.filter("portion IS NULL").groupBy("seed").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")
    )
    scores = means.join(tests, "seed").selectExpr(
        "portion AS train_portion", "train_regressor_size", "sqrt(greatest(q - 2 * m * s + n * m * m, 0) / n) AS test_rmse"
    )
    table = sm.repeat_summary(scores, ["train_portion", "train_regressor_size"], ["test_rmse"])
    return rounded(table, ["test_rmse", "test_rmse_se"])


CURVE_SQL = f"""{LABELLED_SQL}, {PORTIONS_SQL},
m AS (SELECT seed, portion, avg(y) AS m, count(*) AS c FROM chosen WHERE portion IS NOT NULL GROUP BY seed, portion),
e AS (
  SELECT m.seed, m.portion, c, sqrt(avg(pow(t.y - m, 2))) AS e FROM m JOIN chosen t ON t.seed = m.seed AND t.portion IS NULL GROUP BY ALL)
SELECT portion AS train_portion, c AS train_regressor_size, round(avg(e), 6) AS test_rmse, round(stddev_pop(e), 6) AS test_rmse_se
FROM e GROUP BY portion, c"""


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest error per source language among candidates; ties go to the first in order."""
    rows = complete(spark, sf_dir).selectExpr(
        "source_lang", "target_lang", "k AS grid_order", "round(genetic * 10) AS cv_rmse"
    )
    return sm.best_of(rows, ["source_lang"], "cv_rmse", "grid_order")


BEST_SQL = f"""{EXP},
c AS (SELECT source_lang, target_lang, k AS grid_order, round(genetic * 10) AS cv_rmse,
  row_number() OVER (PARTITION BY source_lang ORDER BY round(genetic * 10), k) AS r FROM exp)
SELECT source_lang, target_lang, grid_order, cv_rmse FROM c WHERE r = 1"""


QUERIES = {
    "split_stratified": (split_stratified, SPLIT_SQL),
    "split_same_domain": (split_same_domain, SPLIT_DOMAIN_SQL),
    "split_incremental": (split_incremental, INCREMENTAL_SQL),
    "kfold": (kfold, KFOLD_SQL),
    "shuffle_position": (shuffle_position, SHUFFLE_SQL),
    "split_lolo": (split_lolo, LOLO_SQL),
    "split_unseen": (split_unseen, UNSEEN_SQL),
    "split_cross": (split_cross, CROSS_SQL),
    "drop_constant": (drop_constant, DROP_SQL),
    "feature_select": (feature_select, FEATURE_SQL),
    "code_lookup": (code_lookup, CODE_SQL),
    "language_features": (language_features, LANGUAGE_SQL),
    "context_lookup": (context_lookup, CONTEXT_SQL),
    "scale_population": (scale_population, SCALE_SQL),
    "power_expand": (power_expand, POWER_SQL),
    "score_matrix": (score_matrix, MATRIX_SQL),
    "lolo_rmse_mean_model": (lolo_rmse_mean_model, LOLO_RMSE_SQL),
    "seen_unseen_rmse_mean_model": (seen_unseen_rmse_mean_model, UNSEEN_RMSE_SQL),
    "random_repeat_summary": (random_repeat_summary, REPEAT_SQL),
    "incremental_curve": (incremental_curve, CURVE_SQL),
    "best_candidate": (best_candidate, BEST_SQL),
}
