"""Boosted-tree regressors in two parameter profiles, searched for all runs of a protocol at once.

A run is a training set with folds and test parts; a fit is a run, a choice of columns, a fold that is left out
and a setting. Settings that differ in the number of rounds only are prefixes of one fit. All fits of a search are
rows of one table, whatever the number of folds, candidates, seeds and languages: one job fits them, a second one
fits the chosen settings on all training rows.

Bins come from all rows handed in; they hold no labels. Trees do not depend on the scale of a column, so columns
are not scaled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.operators import search
from glossmark.operators.boosting import Fit, Gains, Layout, Policy, fit_local, fit_scanned
from glossmark.operators.fits import asked, fit_all, is_fold, part_rows, part_sizes, training
from glossmark.operators.ranking import seeded_rank
from glossmark.session import BROADCAST_BYTES, stage



def _step(params: dict, name: str, default: float) -> float:
    step = params.get(name, default)
    if not 0 < step <= 1:
        raise ValueError(f"{name} must be above 0 and at most 1, not {step}")
    return step


def depthwise(params: dict) -> Policy:
    """Profile of the depth-wise booster, with its own defaults."""
    return Policy(
        rounds=int(params.get("n_estimators", 100)), step=_step(params, "eta", 0.3), depth=int(params.get("max_depth", 6)), leaves=0,
        l1=float(params.get("reg_alpha", 0.0)), l2=float(params.get("reg_lambda", 1.0)), min_gain=float(params.get("gamma", 0.0)),
        min_hessian=float(params.get("min_child_weight", 1.0)), min_rows=1, rows=float(params.get("subsample", 1.0)),
        columns=float(params.get("colsample_bytree", 1.0)), bins=int(params.get("max_bin", 256)),
    )


def leafwise(params: dict) -> Policy:
    """Profile of the leaf-wise booster, with its own defaults; rows are sampled only if ``subsample_freq`` is above 0."""
    bagging = params.get("subsample_freq", 0) > 0
    return Policy(
        rounds=int(params.get("n_estimators", 100)), step=_step(params, "learning_rate", 0.1), depth=max(0, int(params.get("max_depth", -1))),
        leaves=int(params.get("num_leaves", 31)), l1=float(params.get("reg_alpha", 0.0)), l2=float(params.get("reg_lambda", 0.0)),
        min_gain=float(params.get("min_split_gain", 0.0)), min_hessian=float(params.get("min_child_weight", 1e-3)),
        min_rows=int(params.get("min_child_samples", 20)), rows=float(params.get("subsample", 1.0)) if bagging else 1.0,
        columns=float(params.get("colsample_bytree", 1.0)), bins=int(params.get("max_bin", 255)),
    )


PROFILES = {"xgb": depthwise, "lgbm": leafwise}


def borders(rows: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Upper ends of each column's bins: all its values if there are at most ``bins``, else quantiles from a mergeable sketch."""
    entries = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(columns)])).alias("e"))
    values = stage(entries.select("e.*").where("x IS NOT NULL").distinct(), "bin-values")
    sizes = dict(values.groupBy("i").count().collect())
    small = [i for i in range(len(columns)) if sizes.get(i, 0) <= bins]
    found = values.where(F.col("i").isin(small)).toPandas() if small else pd.DataFrame({"i": [], "x": []})
    edges = {i: np.sort(found["x"][found["i"] == i].to_numpy(np.float64)) for i in small}
    wide = [i for i in range(len(columns)) if i not in edges]
    if wide:
        shares = F.array(*[F.lit((k + 1) / bins) for k in range(bins)])
        cuts = rows.agg(*[F.percentile_approx(F.col(f"`{columns[i]}`").cast("double"), shares, 20 * bins).alias(f"c{i}") for i in wide]).first()
        edges.update({i: np.unique(np.array(cuts[f"c{i}"])) for i in wide})
    # a column without values still has one bin
    return [edges[i] if len(edges[i]) else np.zeros(1) for i in range(len(columns))]


def binned(rows: DataFrame, columns: list[str], label: str, edges: list[np.ndarray], key: str) -> DataFrame:
    """``row`` (a dense number in the order of the key's hash), ``key``, ``codes`` (each column's bin) and ``label``, staged.

    A null counts as smaller than every number.
    """
    numbered = seeded_rank(rows, [], F.col(key), 0, "_row")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.vstack(b["x"].to_numpy()).astype(np.float64)
            codes = np.stack([np.minimum(np.searchsorted(e, np.nan_to_num(x[:, i], nan=-np.inf)), len(e) - 1) for i, e in enumerate(edges)], 1)
            yield pd.DataFrame({"row": b["row"], "key": b["key"], "codes": list(codes.astype(np.int32)), "label": b["label"]})

    values = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in columns])
    table = numbered.select((F.col("_row") - 1).alias("row"), F.col(key).alias("key"), values.alias("x"), F.col(f"`{label}`").cast("double").alias("label"))
    return stage(table.mapInPandas(work, "row long, key string, codes array<int>, label double"), "binned")


@dataclass
class _Search:
    """What every fit of a search needs to know; small, and the same for all."""

    chosen: list[np.ndarray]  # per choice of columns
    layouts: list[Layout]
    folds: int


def _seed_options(config: dict, profile: str, seed: int) -> tuple[list[dict], list[tuple[Policy, list[int]]], list[tuple[int, int]]]:
    """Candidates of a seed; the distinct paths with the rounds asked of each; and each candidate's (path, rounds)."""
    options = search.candidates(config, seed)
    paths: dict[Policy, list[int]] = {}
    for params in options:
        policy = PROFILES[profile](params)
        paths.setdefault(replace(policy, rounds=0), []).append(policy.rounds)
    names = list(paths)
    placed = [(names.index(replace(PROFILES[profile](p), rounds=0)), PROFILES[profile](p).rounds) for p in options]
    return options, [(p, sorted(set(r))) for p, r in paths.items()], placed


def _fit_all(spark, table, plan: _Search, specs: list[tuple]) -> list[tuple[dict, Gains]]:
    """Fits (run, combo, fold or -1, policy, rounds, seed) in the order given; one job."""

    def one(held: tuple, spec: tuple) -> dict | None:
        codes, label, parts = held
        run, combo, fold, policy, rounds, seed = spec
        train, layout = training(parts[run], fold), plan.layouts[combo]
        if not len(train):
            return None
        laid = codes[:, plan.chosen[combo]] + layout.start[:-1]
        errors, gains = fit_local(laid, label, np.arange(len(label)), layout, train, asked(parts[run], fold), policy, rounds, seed)
        found = [(p, t, e) for p, by in errors.items() for t, e in by.items()]
        return {"part": [f[0] for f in found], "turn": [f[1] for f in found], "error": [f[2] for f in found], "uses": gains.uses, "gain": gains.gain}

    out = []
    for r in fit_all(spark, table, specs, one, "part array<string>, turn array<int>, error array<double>, uses array<double>, gain array<double>"):
        errors: dict[str, dict[int, float]] = {}
        gains = Gains(0)
        if r is not None:
            for p, t, e in zip(r.part, r.turn, r.error):
                errors.setdefault(p, {})[t] = e
            gains.uses, gains.gain = np.array(r.uses), np.array(r.gain)
        out.append((errors, gains))
    return out


def _scan_all(binned_rows: DataFrame, members: DataFrame, runs: list[str], parts: dict[str, list[str]], plan: _Search, specs: list[tuple]) -> list[tuple[dict, Gains]]:
    """The same by scans; one after the other for each choice of columns."""
    run_number = F.create_map(*[F.lit(x) for i, r in enumerate(runs) for x in (r, i)])[F.col("run")]
    marked = members.withColumn("no", run_number)
    folds = marked.where("part LIKE 'fold%'").groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("no", F.substring("part", 5, 9).cast("int")))).alias("in_fold")
    )
    tests = marked.where("part NOT LIKE 'fold%'").groupBy("row").agg(F.collect_list(F.concat_ws("|", F.col("no").cast("string"), "part")).alias("parts"))
    whole = binned_rows.join(folds, "row", "left").join(tests, "row", "left")
    out: list = [None] * len(specs)
    for combo, layout in enumerate(plan.layouts):
        at = [i for i, s in enumerate(specs) if s[1] == combo]
        codes = F.array(*[F.col("codes")[int(c)] + int(s) for c, s in zip(plan.chosen[combo], layout.start)])
        in_fold = F.array(*[F.coalesce(F.try_element_at("in_fold", F.lit(i)), F.lit(-1)) for i in range(len(runs))])
        rows = whole.select("row", codes.alias("codes"), "label", in_fold.alias("folds"), F.coalesce("parts", F.array().cast("array<string>")).alias("parts"))
        fits = [Fit(runs.index(s[0]), s[2], s[3], s[4], s[5]) for s in (specs[i] for i in at)]
        tested = {k: list(asked(parts[runs[f.run]], f.fold)) for k, f in enumerate(fits)}
        for i, result in zip(at, fit_scanned(stage(rows, "boosting"), layout, fits, tested)):
            out[i] = result
    return out


def fit_protocol(
    rows: DataFrame, members: DataFrame, seeds: dict[str, int], combos: list[list[str]], label: str, config: dict, profile: str, key: str,
    in_memory: int = BROADCAST_BYTES,
) -> DataFrame:
    """``run, combo, part, n, cv_rmse, rmse, extra`` of every run.

    ``members`` has (run, part, key): parts named ``fold<i>`` are training folds, others are tests. The chosen candidate is the
    first of lowest root of the mean of its folds' squared errors. ``extra`` holds its parameters and the columns' importances:
    shares of mean gain for the depth-wise profile, numbers of splits for the leaf-wise one. The binned rows go to the workers if
    they and the memberships take at most ``in_memory`` bytes; otherwise every level of all trees is a scan.
    """
    spark = rows.sparkSession
    base = list(dict.fromkeys(c for combo in combos for c in combo))
    choices = {seed: _seed_options(config, profile, seed) for seed in set(seeds.values())}
    edges = borders(rows, base, max(p.bins for _, paths, _ in choices.values() for p, _ in paths))
    table = binned(rows, base, label, edges, key)
    members = stage(members.join(table.select(F.col("key").alias(key), "row"), key).select("run", "part", "row"), "members")
    parts = part_sizes(members)
    chosen = [np.array([base.index(c) for c in combo]) for combo in combos]
    plan = _Search(chosen, [Layout([len(edges[i]) for i in c]) for c in chosen], config["cv"])

    small = table.count() * (4 * len(base) + 8) + 8 * sum(sum(p.values()) for p in parts.values()) <= in_memory
    if small:
        got = table.orderBy("row").select("codes", "label").toPandas()
        codes = np.vstack(got["codes"].to_numpy()).astype(np.int32) if len(got) else np.empty((0, len(base)), np.int32)
        held = (codes, got["label"].to_numpy(), part_rows(members))

    def fit(specs: list[tuple]) -> list[tuple[dict, Gains]]:
        if small:
            return _fit_all(spark, held, plan, specs)
        return _scan_all(table, members, sorted(parts), parts, plan, specs)

    runs = [r for r in sorted(parts) if any(map(is_fold, parts[r]))]
    trials = [
        (run, combo, fold, policy, rounds, seeds[run])
        for run in runs for combo in range(len(combos)) for policy, rounds in choices[seeds[run]][1]
        for fold in range(plan.folds) if f"fold{fold}" in parts[run]
    ]
    found: dict[tuple, dict[int, dict[int, float]]] = {}
    for (run, combo, fold, policy, _, _), (errors, _) in zip(trials, fit(trials)):
        found.setdefault((run, combo, policy), {})[fold] = errors.get(f"fold{fold}", {})
    finals, picked = [], []
    for run in runs:
        options, paths, placed = choices[seeds[run]]
        for combo in range(len(combos)):
            scores = []
            for path, rounds in placed:
                by_fold = found.get((run, combo, paths[path][0]), {})
                scores.append([by_fold[f][rounds] for f in by_fold if rounds in by_fold[f]])
            at, error = search.best_of(scores)
            finals.append((run, combo, -1, paths[placed[at][0]][0], [placed[at][1]], seeds[run]))
            picked.append((options[at], error))
    results = []
    for (run, combo, _, _, rounds, _), (params, error), (errors, gains) in zip(finals, picked, fit(finals)):
        n = sum(k for p, k in parts[run].items() if is_fold(p))
        numbers = {k: float(v) for k, v in params.items()}
        numbers |= {f"{c}_importance": float(v) for c, v in zip(combos[combo], gains.importances(profile == "lgbm"))}
        results += [(run, combo, part, n, error, math.sqrt(by[rounds[0]]), numbers) for part, by in errors.items() if rounds[0] in by]
    schema = "run string, combo int, part string, n long, cv_rmse double, rmse double, extra map<string,double>"
    return stage(spark.createDataFrame(results, schema), "results")
