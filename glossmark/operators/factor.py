"""Score-matrix factorisation with biases and side information, all terms minimised together.

``score = mean + source bias + target bias + W_source . H_target + side . weights``. The squared error plus the
penalties (each counted once per training row) is minimised by turns: the side weights are one ridge regression, a
source's bias and factors are the ridge regression of its rows on its targets' factors, and likewise for the targets.
Each turn is solved exactly, so the objective falls with every step; a learning rate has no place in it, and candidates
that differ in nothing else are one fit. A key without training rows gets no bias and no factor term.

Fits whose table was checked to be small run in the workers, all folds and candidates of all runs in one job. Beyond that
``fit_scanned`` solves the same turns in Spark, with one normal equation per key summed in tasks first.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.functions.keys import sized_source
from glossmark.operators import search
from glossmark.operators.fits import asked, fit_all, is_fold, part_rows, part_sizes, training
from glossmark.operators.ranking import seeded_rank
from glossmark.operators.splits import random_split
from glossmark.operators.transforms import scalable
from glossmark.session import BROADCAST_BYTES, join_bounded, stage

RANK = 20
#: Rounds of turns at most, and the change of a prediction, in deviations of the label, below which they end.
ROUNDS = 200
SETTLED = 1e-4
#: Without factors the turns go to the one minimum quickly.
SETTLED_LINEAR = 1e-10
# Default of the setup's least_side_columns.
LEAST_SIDE = 10
#: Settings that change the minimum; others only say how to get there.
PENALTIES = {"beta_s": 0.01, "beta_t": 0.01, "beta_w": 0.1, "beta_h": 0.1, "beta_z": 0.01}


@dataclass(frozen=True)
class Penalties:
    s: float
    t: float
    w: float
    h: float
    z: float
    rank: int


def penalties(params: dict) -> Penalties:
    values = [float(params.get(name, default)) for name, default in PENALTIES.items()]
    return Penalties(*values, rank=int(params.get("rank", RANK)) if params.get("factors", True) else 0)


def first_factors(key: str, side: int, seed: int, rank: int) -> np.ndarray:
    """Where a key's factors begin: drawn by its name, so that folds and ways of computing agree."""
    return np.random.default_rng([seed, side, zlib.crc32(key.encode())]).normal(scale=1 / max(rank, 1), size=rank)


def ridge(gram: np.ndarray, target: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Solutions of ``(gram + diag(penalty)) x = target``; what neither rows nor penalties fix is 0."""
    system = gram + penalty[..., None] * np.eye(gram.shape[-1])
    try:
        return np.linalg.solve(system, target[..., None])[..., 0]
    except np.linalg.LinAlgError:
        return (np.linalg.pinv(system, hermitian=True) @ target[..., None])[..., 0]


@dataclass
class Factors:
    """A fitted model over numbered sources and targets: row 0 of each table is the bias, the others are factors."""

    mean: float
    side: np.ndarray
    source: np.ndarray
    target: np.ndarray
    objectives: list[float] = field(default_factory=list)

    def predict(self, source: np.ndarray, target: np.ndarray, side: np.ndarray) -> np.ndarray:
        s, t = self.source[source], self.target[target]
        return self.mean + side @ self.side + s[:, 0] + t[:, 0] + (s[:, 1:] * t[:, 1:]).sum(1)


def _by_key(owner: np.ndarray, size: int, others: np.ndarray, left: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Bias and factors of each key from its rows' other side and from what is left of their labels."""
    order = np.argsort(owner, kind="stable")
    keys, starts, counts = np.unique(owner[order], return_index=True, return_counts=True)
    x, y = others[order], left[order]
    gram, pull = np.empty((len(keys), x.shape[1], x.shape[1])), np.empty((len(keys), x.shape[1]))
    for k, (a, b) in enumerate(zip(starts.tolist(), (starts + counts).tolist())):
        rows = x[a:b]
        gram[k], pull[k] = rows.T @ rows, rows.T @ y[a:b]
    out = np.zeros((size, others.shape[1]))
    out[keys] = ridge(gram, pull, counts[:, None] * penalty)
    return out


def fit_factors(
    source: np.ndarray, target: np.ndarray, side: np.ndarray, label: np.ndarray, names: tuple[list[str], list[str]], p: Penalties, seed: int,
    rounds: int = ROUNDS, settled: float | None = None,
) -> Factors:
    """Fit on numbered rows; ``names`` are the keys behind the numbers."""
    settled = (SETTLED if p.rank else SETTLED_LINEAR) if settled is None else settled
    tables = [np.zeros((len(n), p.rank + 1)) for n in names]
    for i, n in enumerate(names):
        for at in np.unique((source, target)[i]).tolist():
            tables[i][at, 1:] = first_factors(n[at], i, seed, p.rank)
    model = Factors(float(label.mean()), np.zeros(side.shape[1]), *tables)
    centred, n = label - model.mean, len(label)
    gram, spread = side.T @ side, float(label.std()) or 1.0
    weights_s, weights_t = np.r_[p.s, np.full(p.rank, p.w)], np.r_[p.t, np.full(p.rank, p.h)]

    def product() -> np.ndarray:
        return (model.source[source][:, 1:] * model.target[target][:, 1:]).sum(1)

    def objective() -> float:
        wrong = label - model.predict(source, target, side)
        owned = (model.source[source] ** 2 @ weights_s).sum() + (model.target[target] ** 2 @ weights_t).sum()
        return float(wrong @ wrong + owned + n * p.z * model.side @ model.side)

    guess = model.predict(source, target, side)
    for _ in range(rounds):
        left = centred - model.source[source, 0] - model.target[target, 0] - product()
        model.side = ridge(gram, side.T @ left, np.full(side.shape[1], n * p.z))
        model.objectives.append(objective())
        rest = centred - side @ model.side
        others = np.c_[np.ones(n), model.target[target][:, 1:]]
        model.source = _by_key(source, len(names[0]), others, rest - model.target[target, 0], weights_s)
        model.objectives.append(objective())
        others = np.c_[np.ones(n), model.source[source][:, 1:]]
        model.target = _by_key(target, len(names[1]), others, rest - model.source[source, 0], weights_t)
        model.objectives.append(objective())
        now = model.predict(source, target, side)
        if np.abs(now - guess).max() <= settled * spread:
            break
        guess = now
    return model


# --- the same turns in Spark ------------------------------------------------------------------


def fit_scanned(rows: DataFrame, p: Penalties, seed: int, width: int, rounds: int, settled: float | None = None) -> tuple[float, np.ndarray, DataFrame, DataFrame]:
    """Mean, side weights and the tables (key, bias and factors) of sources and targets, from rows in Spark.

    ``rows`` has ``src_key``, ``tgt``, ``side`` (array of ``width``) and ``label``. A key's normal equation is summed in
    each task before it is shuffled, so a key with very many rows is a few rows there.
    """
    settled = (SETTLED if p.rank else SETTLED_LINEAR) if settled is None else settled
    mean, spread, n = rows.agg(F.avg("label"), F.stddev_pop("label"), F.count(F.lit(1))).first()
    size = p.rank + 1

    def start(key: str, side: int) -> DataFrame:
        @F.pandas_udf("array<double>")
        def draw(names: pd.Series) -> pd.Series:
            return names.map(lambda k: [0.0, *first_factors(k, side, seed, p.rank)])

        return stage(rows.select(key).distinct().withColumn("v", draw(F.col(key))), "factors")

    tables = [start("src_key", 0), start("tgt", 1)]
    weights = np.zeros(width)
    gram_side = None

    def joined() -> DataFrame:
        out = join_bounded(rows, tables[0].withColumnRenamed("v", "vs"), ["src_key"], staged=True)
        return join_bounded(out, tables[1].withColumnRenamed("v", "vt"), ["tgt"], staged=True)

    def blocks(batches: Iterator[pd.DataFrame]):
        for b in batches:
            if len(b):
                yield b, np.vstack(b["vs"].to_numpy()), np.vstack(b["vt"].to_numpy()), np.vstack(b["side"].to_numpy()).reshape(len(b), width)

    def solve_side() -> np.ndarray:
        def partial(batches):
            gram, pull = np.zeros((width, width)), np.zeros(width)
            for b, s, t, z in blocks(batches):
                left = b["label"].to_numpy() - mean - s[:, 0] - t[:, 0] - (s[:, 1:] * t[:, 1:]).sum(1)
                gram += z.T @ z
                pull += z.T @ left
            yield pd.DataFrame({"gram": [gram.ravel()], "pull": [pull]})

        found = joined().mapInPandas(partial, "gram array<double>, pull array<double>")
        sums = [found.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x")).collect() for c in ("gram", "pull")]
        gram, pull = (np.zeros(k) for k in (width * width, width))
        for out, entries in zip((gram, pull), sums):
            for i, x in entries:
                out[i] = x
        return ridge(gram.reshape(width, width), pull, np.full(width, n * p.z))

    def solve_keys(key: str, mine: int, penalty: np.ndarray, side: np.ndarray) -> DataFrame:
        def partial(batches):
            for b, s, t, z in blocks(batches):
                other = (t, s)[mine]
                left = b["label"].to_numpy() - mean - z @ side - other[:, 0]
                x = np.c_[np.ones(len(b)), other[:, 1:]]
                keys, owner = np.unique(b[key].to_numpy(), return_inverse=True)
                order = np.argsort(owner, kind="stable")
                starts = np.searchsorted(owner[order], np.arange(len(keys)))
                gram = np.add.reduceat(x[order][:, :, None] * x[order][:, None, :], starts).reshape(len(keys), -1)
                pull = np.add.reduceat(x[order] * left[order, None], starts)
                yield pd.DataFrame({key: keys, "n": np.bincount(owner), "gram": list(gram), "pull": list(pull)})

        def solve(frame: pd.DataFrame) -> pd.DataFrame:
            gram, pull = (np.vstack(frame[c].to_numpy()).sum(0) for c in ("gram", "pull"))
            found = ridge(gram.reshape(size, size), pull, frame["n"].sum() * penalty)
            return pd.DataFrame({key: [frame[key].iloc[0]], "v": [found]})

        sums = joined().mapInPandas(partial, f"{key} string, n long, gram array<double>, pull array<double>")
        return stage(sums.groupBy(key).applyInPandas(solve, f"{key} string, v array<double>"), "factors")

    def guesses(side: np.ndarray) -> DataFrame:
        def work(batches):
            for b, s, t, z in blocks(batches):
                yield pd.DataFrame({"row": b["row"], "guess": z @ side + s[:, 0] + t[:, 0] + (s[:, 1:] * t[:, 1:]).sum(1)})

        return stage(joined().mapInPandas(work, "row long, guess double"), "guesses")

    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "cells")
    before = guesses(weights)
    for _ in range(rounds):
        weights = solve_side()
        tables[0] = solve_keys("src_key", 0, np.r_[p.s, np.full(p.rank, p.w)], weights)
        tables[1] = solve_keys("tgt", 1, np.r_[p.t, np.full(p.rank, p.h)], weights)
        now = guesses(weights)
        change = now.join(before.withColumnRenamed("guess", "old"), "row").agg(F.max(F.abs(F.col("guess") - F.col("old")))).first()[0]
        if change <= settled * (spread or 1.0):
            break
        before = now
    return mean, weights, tables[0], tables[1]


def predict_scanned(rows: DataFrame, fitted: tuple[float, np.ndarray, DataFrame, DataFrame], width: int) -> DataFrame:
    """``rows`` with ``prediction``."""
    mean, weights, sources, targets = fitted
    out = join_bounded(rows, sources.withColumnRenamed("v", "vs"), ["src_key"], "left", staged=True)
    out = join_bounded(out, targets.withColumnRenamed("v", "vt"), ["tgt"], "left", staged=True)
    side = F.lit(0.0)
    for i in range(width):
        side = side + F.col("side")[i] * float(weights[i])
    factors = [F.slice(v, 2, F.size(v)) for v in ("vs", "vt")]
    product = F.aggregate(F.zip_with(*factors, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    biases = F.coalesce(F.col("vs")[0], F.lit(0.0)) + F.coalesce(F.col("vt")[0], F.lit(0.0))
    return out.withColumn("prediction", F.lit(mean) + side + biases + F.coalesce(product, F.lit(0.0))).drop("vs", "vt")


# --- all runs of a protocol --------------------------------------------------------------------


def side_columns(chosen: list[str], least: int = LEAST_SIDE) -> list[str]:
    """Side-information columns; with fewer than ``least`` the size is left to the row key alone."""
    side = [c for c in chosen if c not in ("source_lang", "target_lang")]
    return [c for c in side if c != "dataset_size"] if len(side) < least else side


def _scaling(side: np.ndarray, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    mean, spread = side.mean(0), side.std(0)
    flat = spread <= np.abs(mean) * 1e-12
    spread[flat] = 1.0
    fixed = np.array([c not in scalable(columns) for c in columns], bool)
    mean[fixed], spread[fixed] = 0.0, 1.0
    return mean, spread


def cells(rows: DataFrame, columns: list[str], label: str, key: str) -> DataFrame:
    """``row`` (a dense number), ``key``, ``src_key``, ``tgt``, ``side`` and ``label`` of experiment rows, staged."""
    # task tables have no size; their matrix rows are the languages themselves
    sized = "dataset_size" in rows.columns
    source = sized_source(F.col("source_lang"), F.col("dataset_size")) if sized else F.col("source_lang")
    side = F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).cast("array<double>")
    numbered = seeded_rank(rows, [], F.col(key), 0, "_row")
    return stage(
        numbered.select((F.col("_row") - 1).alias("row"), F.col(key).alias("key"), source.alias("src_key"), F.col("target_lang").alias("tgt"),
                        side.alias("side"), F.col(f"`{label}`").cast("double").alias("label"), "source_lang"),
        "cells",
    )


def fit_protocol(
    rows: DataFrame, members: DataFrame, seeds: dict[str, int], combos: list[list[str]], label: str, config: dict, key: str,
    in_memory: int = BROADCAST_BYTES,
) -> DataFrame:
    """``run, combo, part, n, cv_rmse, rmse, extra`` of every run.

    ``members`` has (run, part, key): parts named ``fold<i>`` are training folds, others are tests. Side columns are scaled by a
    run's training rows. The chosen candidate is the first of lowest root of the mean of its folds' squared errors; it is fitted
    on 80 % of the training rows, stratified by source language. A training score of 0 counts as missing.
    ``config["least_side_columns"]`` says from how many columns on the size is side information too, ``config["rounds"]`` how
    many rounds of turns there are at most.
    """
    spark = rows.sparkSession
    sides = [side_columns(c, config.get("least_side_columns", LEAST_SIDE)) for c in combos]
    base = list(dict.fromkeys(c for side in sides for c in side))
    table = cells(rows, base, label, key)
    members = stage(members.join(table.select(F.col("key").alias(key), "row", "source_lang"), key), "members")
    numbered = F.create_map(*[F.lit(x) for r, s in seeds.items() for x in (r, s)])[F.col("run")]
    train = members.where("part LIKE 'fold%'").withColumn("_seed", numbered)
    inner = random_split(train, ["run"], ["source_lang"], F.col(key), F.col("_seed"), 0.2).where("NOT is_test")
    members = stage(members.select("run", "part", "row").unionByName(inner.select("run", F.lit("inner").alias("part"), "row")), "members")
    parts = part_sizes(members)
    runs = [r for r in sorted(parts) if any(map(is_fold, parts[r]))]
    options = {seed: search.candidates(config, seed) for seed in set(seeds.values())}
    settings = {seed: list(dict.fromkeys(map(penalties, found))) for seed, found in options.items()}
    trials = [
        (run, combo, fold, p, seeds[run]) for run in runs for combo in range(len(combos)) for p in settings[seeds[run]]
        for fold in range(config["cv"]) if f"fold{fold}" in parts[run]
    ]
    rounds = config.get("rounds", ROUNDS)
    small = table.count() * (8 * len(base) + 64) + 8 * sum(sum(p.values()) for p in parts.values()) <= in_memory
    if small:
        got = table.orderBy("row").select("src_key", "tgt", "side", "label").toPandas()
        names, numbers = zip(*[np.unique(got[c].to_numpy().astype(str), return_inverse=True) for c in ("src_key", "tgt")])
        side = np.vstack(got["side"].to_numpy()).astype(float) if len(got) else np.empty((0, len(base)))
        held = (numbers, tuple(n.tolist() for n in names), side.reshape(len(got), len(base)), got["label"].to_numpy(), part_rows(members))
        chosen = [np.array([base.index(c) for c in s], int) for s in sides]

        def one(value: tuple, spec: tuple) -> dict | None:
            (source, target), keys, every, labels, places = value
            run, combo, fold, p, seed = spec
            whole = training(places[run])
            mine = training(places[run], fold) if fold >= 0 else places[run].get("inner", np.empty(0, np.int64))
            mine = mine[labels[mine] != 0]
            if not len(mine):
                return None
            mean, spread = _scaling(every[whole][:, chosen[combo]], sides[combo])
            z = (every[:, chosen[combo]] - mean) / spread
            model = fit_factors(source[mine], target[mine], z[mine], labels[mine], keys, p, seed, rounds)
            found = {
                part: float(np.mean((labels[at] - model.predict(source[at], target[at], z[at])) ** 2)) for part, at in asked(places[run], fold).items() if len(at)
            }
            return {"part": list(found), "error": list(found.values())}

        def fit(specs: list[tuple]) -> list[dict[str, float]]:
            return [dict(zip(r.part, r.error)) if r is not None else {} for r in fit_all(spark, held, specs, one, "part array<string>, error array<double>")]
    else:

        def fit(specs: list[tuple]) -> list[dict[str, float]]:
            return [_fit_one(table, members, base, sides, spec, rounds) for spec in specs]

    errors: dict[tuple, list[float]] = {}
    for (run, combo, _, p, _), found in zip(trials, fit(trials)):
        errors.setdefault((run, combo, p), []).extend(found.values())
    finals, picked = [], []
    for run in runs:
        for combo in range(len(combos)):
            mine = options[seeds[run]]
            at, error = search.best_of([errors.get((run, combo, penalties(o)), []) for o in mine])
            finals.append((run, combo, -1, penalties(mine[at]), seeds[run]))
            picked.append((mine[at], error))
    results = []
    for (run, combo, *_), (params, error), found in zip(finals, picked, fit(finals)):
        n = sum(k for p, k in parts[run].items() if is_fold(p))
        results += [(run, combo, part, n, error, math.sqrt(e), {k: float(v) for k, v in params.items()}) for part, e in found.items()]
    schema = "run string, combo int, part string, n long, cv_rmse double, rmse double, extra map<string,double>"
    return stage(spark.createDataFrame(results, schema), "results")


def _fit_one(table: DataFrame, members: DataFrame, base: list[str], sides: list[list[str]], spec: tuple, rounds: int) -> dict[str, float]:
    """One fit by scans, with the same scaling and parts."""
    run, combo, fold, p, seed = spec
    columns = sides[combo]
    mine = members.where(F.col("run") == run)
    folds = mine.where("part LIKE 'fold%'").join(table, "row")
    places = [base.index(c) for c in columns]
    stats = folds.agg(F.count(F.lit(1)), *[f(F.col("side")[i]) for i in places for f in (F.avg, F.stddev_pop)]).first()[1:]
    scaled = []
    for k, (i, c) in enumerate(zip(places, columns)):
        mean, spread = stats[2 * k], stats[2 * k + 1]
        spread = 1.0 if spread <= abs(mean) * 1e-12 else spread
        scaled.append((F.col("side")[i] - mean) / spread if c in scalable(columns) else F.col("side")[i])

    def side(df: DataFrame) -> DataFrame:
        return df.select("part", "src_key", "tgt", F.array(*scaled).cast("array<double>").alias("side"), "label")

    train = folds.where(F.col("part") != f"fold{fold}") if fold >= 0 else mine.where("part = 'inner'").join(table, "row")
    fitted = fit_scanned(stage(side(train.where("label <> 0")), "train"), p, seed, len(columns), rounds, SETTLED)
    wanted = F.col("part") == f"fold{fold}" if fold >= 0 else ~(F.col("part").like("fold%") | (F.col("part") == "inner"))
    tests = predict_scanned(side(mine.where(wanted).join(table, "row")), fitted, len(columns))
    return dict(tests.groupBy("part").agg(F.avg(F.pow(F.col("label") - F.col("prediction"), F.lit(2)))).collect())
