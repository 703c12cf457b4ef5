"""Performance-prediction experiments under the five hold-out protocols."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmark.functions.keys import same_domain
from glossmark.operators import features as ft
from glossmark.operators import linear
from glossmark.operators import splits as sp
from glossmark.operators import summary as sm
from glossmark.operators import transforms as tf
from glossmark.operators import factor, polynomial, trees
from glossmark.operators.ranking import seeded_rank
from glossmark.session import stage

# Fixed names a run may use.
DATASETS = ["mt560", "nusa", "intent", "slot"]
REGRESSORS = ["xgb", "lgbm", "mf", "poly"]
TRANSLATION_MODELS = ["m2m100", "nllb"]
TRANSLATION_MODES = ["random", "lolo", "unseen", "seen_unseen", "cross_dataset", "incremental"]
TASK_MODELS = ["aya", "llama3"]
TASK_MODES = ["random", "lolo"]
DEFAULT_SCORE = {"mt560": "spBLEU", "nusa": "spBLEU", "intent": "accuracy", "slot": "f1"}
KEY = "_key"


@dataclass
class Setup:
    """What to run. ``config`` is the regressor specification."""

    dataset: str
    mode: str
    regressor: str
    model: str
    config: dict
    score: str | None = None
    lang: str = "all"
    seeds: list[int] = field(default_factory=lambda: list(sp.SEEDS))
    combos: list | None = None
    unseen: list[str] | None = None
    portions: list[float] = field(default_factory=lambda: list(sp.PORTIONS))

    def __post_init__(self):
        if self.regressor not in REGRESSORS:
            raise NotImplementedError(f"regressor {self.regressor} is not one of {REGRESSORS}")
        if self.dataset not in DATASETS:
            raise NotImplementedError(f"dataset {self.dataset} is not one of {DATASETS}")
        if self.dataset == "mt560" and self.regressor == "mf":
            raise ValueError("matrix factorisation cannot be used for mt560")
        if self.model not in (TASK_MODELS if self.task else TRANSLATION_MODELS):
            raise ValueError(f"model {self.model} is not known for {self.dataset}")
        if self.mode not in (TASK_MODES if self.task else TRANSLATION_MODES):
            raise ValueError(f"experiment mode {self.mode} is not known for {self.dataset}")
        self.score = self.score or DEFAULT_SCORE[self.dataset]
        self.combos = self.combos or ft.feature_combinations(self.task)

    @property
    def task(self) -> bool:
        return self.dataset in ("intent", "slot")

    @property
    def label(self) -> str:
        return ft.label_column(self.model, self.score, self.task)

    @property
    def linear(self) -> bool:
        return self.regressor == "poly" and self.config.get("pipeline_type", "basic") == "basic"

    def columns(self, table: DataFrame, combo, dropped: tuple = ()) -> list[str]:
        """Predictors of a combination; the factorisation gets the ids in front.

        Columns the combination asks for must be in the table, but for those that ``prepare``
        dropped because they were constant.
        """
        given = [c for c in table.columns if not c.startswith("_")]
        chosen = ft.select_features(
            given, self.model, self.score, combo,
            with_ids=self.regressor == "mf", disable_eng_target=self.mode == "cross_dataset",
        )
        missing = [c for c in chosen if c not in given and c not in dropped]
        if missing:
            raise KeyError(f"the table lacks the predictors {missing}")
        return [c for c in chosen if c in given]


def load_setup(options: dict) -> Setup:
    """Setup from a parsed run file; ``regressor_config`` names a JSON file."""
    with open(options["regressor_config"], encoding="utf-8") as file:
        config = json.load(file)
    return Setup(
        dataset=options["dataset_name"], mode=options["exp_mode"], regressor=options["regressor"],
        model=options["model"], config=config, score=options.get("score"), lang=options.get("lang", "all"),
    )


def prepare(table: DataFrame, setup: Setup) -> tuple[DataFrame, tuple]:
    """Complete rows with a unique key and the stratum, staged; and the constant columns dropped.

    The key is made of the ids and the size; of rows that share it, all but the first (by their
    other columns) get their number appended. Constant columns go, except for mt560 and for the
    cross-dataset protocol.
    """
    rows = ft.complete_rows(table, setup.score if setup.dataset == "mt560" else "")
    ids = [c for c in [*ft.ID_COLUMNS, "dataset_size"] if c in rows.columns]
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ids])
    same = Window.partitionBy(*ids).orderBy(*[c for c in rows.columns if c not in ids])
    rows = rows.withColumn("_same", F.row_number().over(same))
    rows = rows.withColumn(KEY, F.when(F.col("_same") == 1, key).otherwise(F.concat_ws("#", key, "_same"))).drop("_same")
    if setup.dataset == "mt560":
        stratum = same_domain(F.col("train_dataset"), F.col("test_dataset")).cast("string")
    else:
        stratum = F.col("source_lang")
    rows = stage(rows.withColumn("_stratum", stratum), "experiments")
    if setup.dataset != "mt560" and setup.mode != "cross_dataset":
        keep = ("source_lang", "target_lang", KEY, "_stratum", setup.label)
        dropped = tuple(c for c in ft.constant_columns(rows) if c not in keep)
        return rows.drop(*dropped), dropped
    return rows, ()


def _test_languages(rows: DataFrame, setup: Setup) -> list[tuple[bool, list[str]]]:
    """Held-out languages of both directions. A list of languages is a run setting, not data."""
    unseen = setup.unseen if setup.unseen is not None else ft.UNSEEN_LANGUAGES[setup.model]
    langs = sp.languages(rows, setup.dataset == "mt560")
    found = sorted(r["lang"] for r in langs.collect())
    return [(True, [x for x in found if x in unseen]), (False, [x for x in found if x not in unseen])]


# --- linear models: membership cells, then one pass over the data -------------------------


def _member(rows: DataFrame, cell) -> DataFrame:
    return rows.select(KEY, cell.alias("cell"))


def _name(*parts) -> F.Column:
    return F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


def _fold_name():
    return F.concat(F.lit("fold"), F.col("fold").cast("string"))


def _runs_uses(members: DataFrame, run, part) -> DataFrame:
    """Uses of cells that belong to one run only, read off the membership."""
    return members.select(run.alias("run"), part.alias("part"), "cell", F.lit(1).alias("sign")).distinct()


def _linear_plan(rows: DataFrame, setup: Setup, other: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``(key, cell)`` membership and ``(run, part, cell, sign)`` uses of a protocol."""
    k, seeds = setup.config["cv"], setup.seeds
    slim = rows.select(KEY, "_stratum", "source_lang", "target_lang")
    first, last = F.substring_index("cell", "|", 1), F.substring_index("cell", "|", -1)
    if setup.mode == "random":
        split = stage(sp.random_split(sp.repeat_seeds(slim, seeds), ["seed"], ["_stratum"], F.col(KEY), F.col("seed")), "split")
        folds = sp.kfold(split.filter("not is_test"), ["seed"], F.col(KEY), F.col("seed"), k)
        members = _member(folds, _name("seed", _fold_name())).unionByName(
            _member(split.filter("is_test"), _name("seed", F.lit("test")))
        )
        members = stage(members, "members")
        return members, _runs_uses(members, first, last)
    if setup.mode == "incremental":
        split = stage(
            sp.incremental_split(sp.repeat_seeds(slim, seeds), ["seed"], ["_stratum"], F.col(KEY), F.col("seed"), setup.portions),
            "split",
        )
        folds = sp.kfold(split.filter("portion IS NOT NULL"), ["seed", "portion"], F.col(KEY), F.col("seed"), k)
        train = _member(folds, _name("seed", "portion", _fold_name()))
        test = _member(split.filter("portion IS NULL"), _name("seed", F.lit("test")))
        members = stage(train.unionByName(test), "members")
        trained = members.filter("cell NOT LIKE '%test'")
        uses = _runs_uses(trained, F.substring_index("cell", "|", 2), last)
        tests = uses.select("run", F.lit("test").alias("part"), _name(F.substring_index("run", "|", 1), F.lit("test")).alias("cell"), "sign")
        return members, uses.unionByName(tests.distinct())
    if setup.mode == "cross_dataset":
        folds = sp.kfold(sp.repeat_seeds(slim, seeds), ["seed"], F.col(KEY), F.col("seed"), k)
        members = _member(folds, _name("seed", _fold_name())).unionByName(_member(other, F.lit("test")))
        members = stage(members, "members")
        uses = _runs_uses(members.filter("cell <> 'test'"), first, last)
        tests = uses.select("run", F.lit("test").alias("part"), F.lit("test").alias("cell"), "sign").distinct()
        return members, uses.unionByName(tests)
    seeded = sp.repeat_seeds(slim, seeds)
    roles = _member(sp.role_rows(slim), _name("role", "lang"))
    if setup.mode == "lolo":
        cut = _lolo_cells(seeded, setup, sp.languages(rows, setup.dataset == "mt560"))
        return cut[0].unionByName(roles), cut[1]
    members, uses = [roles], []
    for seen, langs in _test_languages(rows, setup):
        train = sp.without_languages(seeded, langs)
        folds = sp.kfold(train, ["seed"], F.col(KEY), F.col("seed"), k)
        mine = stage(_member(folds, _name("seed", F.lit(str(seen)), _fold_name())), "members")
        members.append(mine)
        trained = _runs_uses(mine, F.substring_index("cell", "|", 2), last)
        names = [f"{r}|{x}" for x in langs for r in ("source", "target")]
        tests = trained.select("run").distinct().withColumn("cell", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")))
        uses += [trained, tests.select("run", F.col("cell").alias("part"), "cell", F.lit(1).alias("sign"))]
    return sm.append(members), sm.append(uses)


def _lolo_cells(seeded: DataFrame, setup: Setup, langs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells and uses of the leave-one-language-out runs, whose folds are dealt over each run's own training rows.

    The seeded order of a run's rows is the order of all rows without those of its language. So a run's folds are
    stretches of the one order: the training row of rank ``r`` has the place ``r`` plus the number of the language's rows
    before it. All runs' cuts together cut the order into stretches; a run's fold is the sum of its stretches less the
    same stretches of its language.
    """
    k = setup.config["cv"]
    if setup.lang != "all":
        langs = langs.filter(F.col("lang") == setup.lang)
    ordered = stage(seeded_rank(seeded, ["seed"], F.col(KEY), F.col("seed"), "place"), "order")
    total = ordered.groupBy("seed").agg(F.count(F.lit(1)).alias("total"))
    mine = sp.touching(ordered).join(F.broadcast(langs), "lang")
    ranked = seeded_rank(mine, ["seed", "lang"], F.col(KEY), F.col("seed"), "own")
    counts = mine.groupBy("seed", "lang").agg(F.count(F.lit(1)).alias("without"))
    runs = total.join(langs).join(counts, ["seed", "lang"], "left").withColumn("n", F.col("total") - F.coalesce("without", F.lit(0)))
    # rows in the folds before fold f; the training row of that rank ends fold f - 1
    ends = runs.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k)))).withColumn(
        "r", F.expr(f"fold * (n div {k}) + least(fold, n % {k})")
    )
    before = ranked.select("seed", "lang", (F.col("place") - F.col("own")).alias("others"))
    # the language's rows that come before its training row of rank r
    passed = ends.join(before, ["seed", "lang"], "left").groupBy("seed", "lang", "fold", "n", "total", "r").agg(
        F.coalesce(F.sum(F.when(F.col("others") < F.col("r"), 1)), F.lit(0)).alias("passed")
    )
    place = F.when(F.col("fold") == 0, 0).when(F.col("fold") == k, F.col("total")).otherwise(F.col("r") + F.col("passed"))
    ends = stage(passed.select("seed", "lang", "fold", F.when(F.col("r") == 0, 0).otherwise(place).alias("place")), "cuts")
    cuts = ends.groupBy("seed").agg(F.array_sort(F.collect_set("place")).alias("cuts"))  # languages times folds at most
    spans = stage(cuts.select("seed", F.posexplode("cuts").alias("span", "place")), "spans")
    # stretch s holds the places after cut s - 1 up to cut s
    number = F.size(F.filter("cuts", lambda c: c < F.col("place")))
    at = ordered.join(F.broadcast(cuts), "seed").withColumn("span", number).drop("cuts", "place")
    whole = _member(at, _name("seed", "span", F.lit("*")))
    without = _member(sp.touching(at).join(F.broadcast(langs), "lang"), _name("seed", "span", "lang"))
    low = ends.join(spans, ["seed", "place"]).select("seed", "lang", "fold", F.col("span").alias("low"))
    high = ends.join(spans, ["seed", "place"]).select("seed", "lang", (F.col("fold") - 1).alias("fold"), F.col("span").alias("high"))
    used = low.join(high, ["seed", "lang", "fold"]).where("high > low").withColumn("span", F.explode(F.expr("sequence(low + 1, high)")))
    plus = used.select(_name("seed", "lang").alias("run"), _fold_name().alias("part"), _name("seed", "span", F.lit("*")).alias("cell"), F.lit(1).alias("sign"))
    minus = used.select(_name("seed", "lang").alias("run"), _fold_name().alias("part"), _name("seed", "span", "lang").alias("cell"), F.lit(-1).alias("sign"))
    role = runs.withColumn("part", F.explode(F.array(F.lit("source"), F.lit("target"))))
    tests = role.select(_name("seed", "lang").alias("run"), "part", _name("part", "lang").alias("cell"), F.lit(1).alias("sign"))
    return whole.unionByName(without), plus.unionByName(minus).unionByName(tests)


def _memberships(rows: DataFrame, setup: Setup, other: DataFrame | None) -> DataFrame:
    """``(run, part, key)``: the training folds and test parts of every run, row by row."""
    if setup.mode != "lolo":
        members, uses = _linear_plan(rows, setup, other)
        return members.join(uses.select("run", "part", "cell"), "cell").select("run", "part", KEY)
    langs = sp.languages(rows, setup.dataset == "mt560")
    if setup.lang != "all":
        langs = langs.filter(F.col("lang") == setup.lang)
    slim = sp.repeat_seeds(rows.select(KEY, "source_lang", "target_lang"), setup.seeds)
    pairs = slim.join(F.broadcast(langs))
    train = pairs.where("source_lang <> lang AND target_lang <> lang")
    folds = sp.kfold(train, ["seed", "lang"], F.col(KEY), F.col("seed"), setup.config["cv"])
    parts = folds.select(_name("seed", "lang").alias("run"), _fold_name().alias("part"), KEY)
    for role in ("source", "target"):
        tests = pairs.where(F.col(f"{role}_lang") == F.col("lang"))
        parts = parts.unionByName(tests.select(_name("seed", "lang").alias("run"), F.lit(role).alias("part"), KEY))
    return parts


def _wide(rows: DataFrame, setup: Setup, other: DataFrame | None, dropped: tuple) -> tuple[DataFrame, list[list[str]], list[str]]:
    """All rows with key, predictors and label; the predictors of each combination; and all of them."""
    combos = [setup.columns(rows, c, dropped) for c in setup.combos]
    base = list(dict.fromkeys(c for combo in combos for c in combo))
    wide = [KEY, *base, setup.label]
    table = rows.select(*wide)
    return table if other is None else table.unionByName(other.select(*wide)), combos, base


def _celled(table: DataFrame, members: DataFrame) -> DataFrame:
    return table.join(members.groupBy(KEY).agg(F.collect_list("cell").alias("cells")), KEY)


def _linear_results(rows: DataFrame, setup: Setup, other: DataFrame | None, dropped: tuple) -> DataFrame:
    """``(run, combo, part, n, cv_rmse, rmse)`` of an elastic net on power features."""
    degree = setup.config.get("degree", 1)
    table, combos, base = _wide(rows, setup, other, dropped)
    members, uses = _linear_plan(rows, setup, other)
    expanded = tf.power_expand(table, base, degree)
    powers = [tf.power_names(combo, degree) for combo in combos]
    return linear.fit_runs(_celled(expanded, members), tf.power_names(base, degree), setup.label, uses, powers)


def _polynomial_results(rows: DataFrame, setup: Setup, other: DataFrame | None, dropped: tuple) -> DataFrame:
    """The same with ``extra``, for elastic nets on the full polynomial expansion."""
    table, combos, base = _wide(rows, setup, other, dropped)
    members, uses = _linear_plan(rows, setup, other)
    return polynomial.fit_runs(_celled(table, members), base, setup.label, uses, combos, setup.config["param_space"])


def _searched_results(rows: DataFrame, setup: Setup, other: DataFrame | None, dropped: tuple) -> DataFrame:
    """The same for boosted trees and factorisations."""
    table, combos, _ = _wide(rows, setup, other, dropped)
    members = stage(_memberships(rows, setup, other), "members")
    runs = [r["run"] for r in members.select("run").distinct().collect()]
    seeds = {run: int(run.split("|")[0]) for run in runs}
    if setup.regressor == "mf":
        names = [c for c in ("source_lang", "target_lang", "dataset_size") if c in rows.columns]
        whole = rows if other is None else rows.select(*other.columns).unionByName(other)
        keyed = table.join(whole.select(KEY, *[c for c in names if c not in table.columns]), KEY)
        return factor.fit_protocol(keyed, members, seeds, combos, setup.label, setup.config, KEY)
    return trees.fit_protocol(table, members, seeds, combos, setup.label, setup.config, setup.regressor, KEY)


# --- results --------------------------------------------------------------------------------


def _toggle_table(results: DataFrame, setup: Setup) -> DataFrame:
    """Replace the combination number by its toggles."""
    numbered = [F.struct(F.lit(i).alias("combo"), *[F.lit(v).alias(n) for n, v in asdict(c).items()]) for i, c in enumerate(setup.combos)]
    toggles = results.sparkSession.range(1).select(F.inline(F.array(*numbered)))
    return results.join(F.broadcast(toggles), "combo").drop("combo")


def run_results(table: DataFrame, setup: Setup, other: DataFrame | None = None) -> DataFrame:
    """One row per run, combination and test part."""
    rows, dropped = prepare(table, setup)
    if setup.mode == "cross_dataset":
        prepared, _ = prepare(other, setup)
        other = prepared.withColumn(KEY, F.concat(F.lit("other|"), KEY))
        for combo in setup.combos:
            sp.cross_tables(rows, other, setup.columns(rows, combo, dropped))
    if setup.regressor == "poly":
        fit = _linear_results if setup.linear else _polynomial_results
    else:
        fit = _searched_results
    results = fit(rows, setup, other, dropped)
    parts = F.split("run", r"\|")
    results = results.withColumn("seed", parts[0].cast("int"))
    if setup.mode == "lolo":
        results = results.withColumn("lang", parts[1])
    elif setup.mode == "incremental":
        results = results.withColumn("train_portion", parts[1].cast("double"))
    elif setup.mode in ("unseen", "seen_unseen"):
        results = results.withColumn("train_is_seen", parts[1].cast("boolean"))
    return results.drop("run")


def _extras(results: DataFrame, group: list[str]) -> DataFrame:
    """Means of parameters and importances, back as one map column."""
    entries = results.select(*group, F.explode("extra").alias("name", "value")).groupBy(*group, "name").agg(F.avg("value").alias("value"))
    return entries.groupBy(*group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("extra"))


def run_experiment(table: DataFrame, setup: Setup, other: DataFrame | None = None) -> DataFrame:
    """The published table of a protocol: means and deviations over the seeds."""
    results = stage(run_results(table, setup, other), "results")
    if setup.mode in ("random", "cross_dataset"):
        group = ["combo"]
        scores = results.withColumnRenamed("rmse", "test_rmse")
        out = sm.repeat_summary(scores, group, ["cv_rmse", "test_rmse"])
        if setup.mode == "cross_dataset":
            out = sm.tagged(out, {"train_mt560": setup.dataset == "mt560"})
    elif setup.mode == "incremental":
        group = ["combo", "train_portion"]
        scores = results.withColumnRenamed("rmse", "test_rmse").withColumnRenamed("n", "train_regressor_size")
        out = sm.repeat_summary(scores, [*group, "train_regressor_size"], ["cv_rmse", "test_rmse"])
    elif setup.mode == "lolo":
        group = ["combo", "lang"]
        errors = sm.language_summary(results.withColumn("role", F.col("part")), ["combo"])
        once = results.select(*group, "seed", "cv_rmse").distinct()
        out = sm.repeat_summary(once, group, ["cv_rmse"]).join(errors, group)
    else:
        group = ["combo", "train_is_seen"]
        roles = results.withColumn("role", F.substring_index("part", "|", 1)).withColumn("lang", F.substring_index("part", "|", -1))
        langs = sorted(r["lang"] for r in roles.select("lang").distinct().collect())
        wide = sm.wide_languages(roles, group, langs)
        once = results.select(*group, "seed", "cv_rmse").distinct()
        out = sm.repeat_summary(once, group, ["cv_rmse"]).join(wide, group)
    if "extra" in results.columns:
        out = out.join(_extras(results, group), group, "left")
    return _toggle_table(out, setup)
