"""Experiment-table preparation: constant columns, feature choice, lookups."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.functions.keys import PIVOT_LANG
from glossmark.session import join_bounded

# Fixed names the experiment tables use.
METRICS = ["spBLEU", "chrF2++", "BLEU", "chrF2", "TER", "comet"]
SCORE_SUFFIXES = [f"{m}_{v}" for m in METRICS for v in ("mean", "se")]
LANG_FEATURES = ["genetic", "geographic", "syntactic", "inventory", "phonological", "featural"]
ID_COLUMNS = ["source_lang", "target_lang", "train_dataset", "test_dataset"]
BASELINE_TRANSLATION = LANG_FEATURES + [
    "dataset_size",
    "train_word_vocab_size", "dev_word_vocab_size", "test_word_vocab_size",
    "avg_train_sentence_length", "avg_dev_sentence_length", "avg_test_sentence_length",
    "train_dev_word_overlap", "train_test_word_overlap", "dev_test_word_overlap",
    "ttr_train", "ttr_dev", "ttr_test",
    "train_dev_ttr_distance", "train_test_ttr_distance", "dev_test_ttr_distance",
]
BASELINE_TASK = LANG_FEATURES + [
    "train_word_vocab_size", "test_word_vocab_size",
    "avg_train_sentence_length", "avg_test_sentence_length",
    "train_test_word_overlap", "ttr_train", "ttr_test", "train_test_ttr_distance",
]
TASK_MODELS = ["aya", "llama3", "smollm_135m", "smollm_360m", "bloomz_560m"]
TASK_PROXIES = ["smollm_135m", "smollm_360m", "bloomz_560m"]

# Fixed language lists: not seen in pre-training per model, and covered by the learnt metric.
UNSEEN_LANGUAGES = {
    "m2m100": [
        "asm", "dik", "ewe", "fao", "hne", "kab", "kin", "kir", "lmo", "mri", "sna", "tat",
        "tel", "tgk", "tuk", "uig", "abs", "btk", "bew", "bhp", "mad", "mak", "min",
    ],
    "nllb": ["abs", "btk", "bew", "bhp", "mad", "mak"],
}
COMET_LANGUAGES = [
    "afr", "amh", "hye", "bel", "mya", "kat", "guj", "hau", "ind", "jav", "kan", "kaz", "khm",
    "kir", "plt", "mar", "pan", "snd", "sin", "som", "tam", "cym", "xho", "deu", "zho", "fra",
    "kor", "rus", "vie",
]


@dataclass(frozen=True)
class Toggles:
    """Which feature groups take part, for translation experiments."""

    nlperf_only: bool = False
    dataset_features: bool = True
    lang_features: bool = True
    with_trfm: bool = True
    with_small100_ft: bool = True
    with_small100_noft: bool = True
    with_model_noft: bool = True

    def proxies(self, model: str) -> list[str]:
        """Proxy prefixes in their fixed order."""
        chosen = [
            (self.with_trfm, "trfm"),
            (self.with_small100_noft, "small100_noft"),
            (self.with_small100_ft, "small100_ft"),
            (self.with_model_noft, f"{model}_noft"),
        ]
        return [name for on, name in chosen if on]


@dataclass(frozen=True)
class TaskToggles:
    """Which feature groups take part, for intent and slot experiments."""

    nlperf_only: bool = False
    dataset_features: bool = True
    lang_features: bool = True
    with_smollm_135m: bool = True
    with_smollm_360m: bool = True
    with_bloomz_560m: bool = True

    def proxies(self, model: str) -> list[str]:
        return [name for name in TASK_PROXIES if getattr(self, f"with_{name}")]


def _no_proxies(toggles):
    return replace(toggles, **{name: False for name in asdict(toggles) if name.startswith("with_")})


def feature_combinations(task: bool = False, published: bool = False) -> list:
    """All groups on; with ``published`` also the baseline and every other published row."""
    full = TaskToggles() if task else Toggles()
    combos = [full]
    if not published:
        return combos
    bare = _no_proxies(full)
    combos.append(replace(bare, nlperf_only=True, dataset_features=False, lang_features=False))
    if task:
        proxies = [{}] + [{f"with_{name}": True} for name in TASK_PROXIES]
    else:
        proxies = [
            {},
            {"with_trfm": True},
            {"with_small100_ft": True},
            {"with_small100_noft": True},
            {"with_small100_ft": True, "with_small100_noft": True},
            {"with_model_noft": True},
        ]
    groups = [(True, False), (False, True), (True, True)]
    for proxy, (dataset, lang) in product(proxies, groups):
        combos.append(replace(bare, dataset_features=dataset, lang_features=lang, **proxy))
    return combos


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with one distinct value, found in one pass over the table."""
    bounds = [f"min(`{c}`) <=> max(`{c}`) AND max(`{c}`) IS NOT NULL AS `{c}`" for c in df.columns]
    row = df.selectExpr(*bounds).first()
    return [c for c in df.columns if row[c]]


def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def complete_rows(df: DataFrame, score: str = "spBLEU") -> DataFrame:
    """Rows without nulls; for the learnt metric only pairs with a covered language."""
    df = df.na.drop()
    if score == "comet":
        df = df.filter(F.col("source_lang").isin(COMET_LANGUAGES) | F.col("target_lang").isin(COMET_LANGUAGES))
    return df


def select_features(
    columns: list[str],
    model: str,
    score: str,
    toggles,
    with_ids: bool = False,
    disable_eng_target: bool = False,
) -> list[str]:
    """Names of the predictor columns, in the order the models receive them."""
    task = isinstance(toggles, TaskToggles)
    suffix = "" if task else "_mean"
    if toggles.nlperf_only:
        baseline = BASELINE_TASK if task else BASELINE_TRANSLATION
        chosen = [c for c in baseline if c in columns]
    else:
        scores = [f"{m}_{score}" for m in TASK_MODELS] if task else SCORE_SUFFIXES
        plain = [c for c in columns if c not in ID_COLUMNS and not any(s in c for s in scores)]
        chosen = [
            c for c in plain if (toggles.lang_features if c in LANG_FEATURES else toggles.dataset_features)
        ]
        chosen += [f"{p}_{score}{suffix}" for p in toggles.proxies(model)]
    if disable_eng_target:
        chosen = [c for c in chosen if c != "eng_target"]
    if with_ids:
        if not task and "dataset_size" not in chosen:
            chosen = ["dataset_size", *chosen]
        chosen = ["source_lang", "target_lang", *chosen]
    return chosen


def se_columns(model: str, score: str, toggles: Toggles) -> list[str]:
    """Standard-error columns of the target and of the proxies in use."""
    order = ["trfm", "small100_ft", "small100_noft", f"{model}_noft"]
    used = toggles.proxies(model)
    return [f"{model}_ft_{score}_se"] + [f"{p}_{score}_se" for p in order if p in used]


def label_column(model: str, score: str, task: bool = False) -> str:
    return f"{model}_{score}" if task else f"{model}_ft_{score}_mean"


def add_language_features(df: DataFrame, distances: DataFrame) -> DataFrame:
    """Distances of the language pair and the English-target flag."""
    joined = join_bounded(df, distances, ["source_lang", "target_lang"], "left")
    return joined.withColumn("eng_target", (F.col("target_lang") == PIVOT_LANG).cast("int"))


def lookup_or_fail(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Join with a table that must have an entry for every row; running it raises if one has none."""
    found = table.withColumn("_found", F.lit(True))
    message = F.concat(F.lit("no entry for "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on]))
    checked = F.when(F.col("_found").isNull(), F.raise_error(message)).otherwise(F.lit(True))
    return df.join(found, on, "left").withColumn("_found", checked).where("_found").drop("_found")
