"""Whole jobs on files: corpus preparation, features, scoring and harvesting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.functions import keys
from glossmark.functions.text import bags, mteval_tokens, plain_tokens, strip
from glossmark.operators import harvest as hv
from glossmark.operators import metrics as mt
from glossmark.operators.shifts import ter_counts, ter_score
from glossmark.operators import stats
from glossmark.operators.corpus import filter_pairs, first_pairs
from glossmark.session import stage
from glossmark.sources import reports, text

RESAMPLES = 1000
CORPUS_PARTITIONS = ["lang", "split", "corpus"]


def prepare_corpus(
    spark: SparkSession,
    out: str,
    corpus: dict[str, str],
    source_path: str,
    target_path: str | None = None,
    source_lang: str = "",
    size: int = 0,
) -> DataFrame:
    """Align, filter and cut one corpus; the raw files stay untouched. Returns what was written.

    A corpus that ``out`` already holds is left as it is; any number of corpora share one output.
    Two paths are aligned text files, whose line ends count in the length filter; one path
    holds translation records. ``corpus`` gives the partition values. ``size`` limits
    training pairs (0: no limit).
    """
    if target_path is not None:
        pairs = filter_pairs(text.read_parallel(spark, source_path, target_path), count_newline=True)
    else:
        pairs = filter_pairs(text.read_translations(spark, source_path, source_lang))
    pairs = pairs.withColumns({k: F.lit(corpus[k]) for k in CORPUS_PARTITIONS})
    pairs = first_pairs(pairs, CORPUS_PARTITIONS, size)
    return text.write_pairs(pairs, out, {k: corpus[k] for k in CORPUS_PARTITIONS})


def prepare_corpora(sources: DataFrame, targets: DataFrame, out: str, size: int = 0) -> DataFrame:
    """Align, filter and cut any number of corpora at once; returns all corpora that ``out`` then holds.

    Both sides have ``CORPUS_PARTITIONS``, ``line_no`` and ``text`` of raw text files, whose line ends count in the length
    filter. Corpora that ``out`` already holds are left as they are. ``size`` limits the training pairs of each (0: no limit).
    """
    pairs = filter_pairs(text.zip_lines(sources, targets, CORPUS_PARTITIONS), count_newline=True)
    return text.write_corpora(first_pairs(pairs, CORPUS_PARTITIONS, size), out, CORPUS_PARTITIONS)


def corpus_name(lang: Column, split: str, corpus: Column, side: Column, size: Column | None = None) -> Column:
    """Identity of a corpus file: ``<lang>/<split>/<corpus>/<split>_<side>[_<size>]``."""
    file = [F.lit(split), side] + ([size.cast("string")] if size is not None else [])
    return F.concat_ws("/", lang, F.lit(split), corpus, F.concat_ws("_", *file))


def read_corpora(spark: SparkSession, root: str) -> DataFrame:
    """All corpus files below ``root``: ``(corpus, line_no, text)``, lines stripped."""
    lines = text.read_lines(spark, root, glob="*.txt")
    name = F.regexp_extract("path", r"([^/]+/(?:train|dev|test)/[^/]+/[^/]+)\.txt$", 1)
    return lines.select(name.alias("corpus"), "line_no", strip(F.col("text")).alias("text")).filter("corpus <> ''")


def featurise(
    experiments: DataFrame, corpora: DataFrame, vectors: DataFrame | None = None, tokeniser="char"
) -> DataFrame:
    """Add the corpus features to experiment rows.

    The rows name languages, training corpus, its size, and test corpus; the text is
    always the target side.
    """
    lang = keys.other_lang(F.col("source_lang"), F.col("target_lang"))
    side = F.col("target_lang")
    named = experiments.withColumns(
        {
            "train_corpus": corpus_name(lang, "train", F.col("train_dataset"), side, F.col("dataset_size")),
            "dev_corpus": corpus_name(lang, "dev", keys.dev_corpus(F.col("train_dataset")), side),
            "test_corpus": corpus_name(lang, "test", F.col("test_dataset"), side),
        }
    )
    used = named.selectExpr("explode(array(train_corpus, dev_corpus, test_corpus)) AS corpus").distinct()
    wanted = corpora.join(used, "corpus", "left_semi")
    table = stats.experiment_features(named, bags(wanted, tokeniser), vectors)
    return table.drop("train_corpus", "dev_corpus", "test_corpus", "train_size")


def _metrics(subword: Callable[[Column], Column] | None, smooth: bool, shifts: bool) -> tuple[dict, dict, list[tuple]]:
    """What is counted of a segment, the numbers read off the counts, and the rows of the report.

    A row is its name, its part of the numbers, their columns, and the score of their sums. The counts are structs over the
    texts, so that one pass works all of them out. The counts of chrF2++ hold those of chrF2.
    """
    hyp, ref = F.col("hyp"), F.col("ref")
    name, cut = ("BLEU-mteval", mteval_tokens) if subword is None else ("spBLEU", subword)
    chars, words = mt.chrf_counts(hyp, ref, 2)
    rates = ["edits", "ref_words"]
    counts = {
        "_first": mt.bleu_counts(hyp, [ref], cut), "_bleu": mt.bleu_counts(hyp, [ref], plain_tokens),
        "_chars": chars, "_words": words, "_edit": mt.edit_counts(hyp, ref),
    }
    numbers = {
        "_first": [F.col(f"_first.{c}") for c in mt.BLEU_COLUMNS], "_bleu": [F.col(f"_bleu.{c}") for c in mt.BLEU_COLUMNS],
        "_grams": mt.chrf_fields(2, ["_chars", "_words"]), "_edit": [F.col(f"_edit.{c}") for c in rates],
    }
    rows = [
        (name, "_first", mt.BLEU_COLUMNS, mt.bleu_score(smooth)),
        ("BLEU", "_bleu", mt.BLEU_COLUMNS, mt.bleu_score(smooth)),
        ("chrF2++", "_grams", mt.chrf_columns(2), mt.chrf_score(2)),
        ("chrF2", "_grams", mt.chrf_columns(0), mt.chrf_score(0)),
        ("edit_rate", "_edit", rates, mt.edit_rate()),
    ]
    if shifts:
        counts["_ter"] = ter_counts(hyp, ref)
        numbers["_ter"] = [F.col(f"_ter.{c}") for c in rates]
        rows.append(("TER", "_ter", rates, ter_score()))
    return counts, numbers, rows


def metric_report(
    segments: DataFrame,
    group: list[str],
    subword: Callable[[Column], Column] | None = None,
    resamples: int = RESAMPLES,
    smooth: bool = False,
    shifts: bool = False,
    exact: bool = False,
) -> DataFrame:
    """Long metric rows ``(group, metric, mean, se)`` of hypotheses against one reference.

    ``segments`` has ``(seg_id, group, hyp, ref)``. ``subword`` is the tokeniser behind spBLEU, such as
    ``sentence_pieces``; without one that row is BLEU over mteval words and named so. The edit rate knows no block shifts;
    with ``shifts`` there is a row TER, which does.
    The means and half-widths come from resampling, one pass over the counts of all metrics side by side; with ``exact``
    a resample has exactly as many segments as its group. Without
    ``smooth`` a resample in which some order of n-grams has no match scores 0.
    """
    counts, numbers, metrics = _metrics(subword, smooth, shifts)
    columns = {part: own for _, part, own, _ in reversed(metrics)}
    counted = segments.select("seg_id", *group, *[c.alias(name) for name, c in counts.items()])
    named = {f"{part}_{c}": number for part in numbers for c, number in zip(columns[part], numbers[part])}
    table = stage(counted.select("seg_id", *group, *[number.alias(name) for name, number in named.items()]), "segment-stats")
    sums = stage(mt.resampled(table, group, F.col("seg_id").cast("string"), [*named], resamples, exact=exact), "resamples")
    out = None
    for name, part, own, score in metrics:
        mine = sums.select(*group, "resample", *[F.col(f"{part}_{c}").alias(c) for c in own])
        found = mt.confidence(mine.select(*group, "resample", score.alias("score")), group, resamples)
        row = found.selectExpr(*group, f"'{name}' AS metric", "confidence_mean AS mean", "confidence_var AS se")
        out = row if out is None else out.unionByName(row)
    return out


def read_hypotheses(spark: SparkSession, root: str) -> DataFrame:
    """Hypotheses of all generator logs: ``(folder, test_dataset, seg_id, hyp)``."""
    lines = text.read_lines(spark, root, glob="output_*.txt")
    named = lines.select(
        reports.path_part(F.col("path"), 3).alias("folder"),
        reports.test_name(F.col("path"), "output", "txt").alias("test_dataset"),
        "text",
    )
    return text.hypotheses(named, ["folder", "test_dataset"])


def score_hypotheses(hyps: DataFrame, references: DataFrame, resamples: int = RESAMPLES, **options) -> DataFrame:
    """Metric rows per folder and test set.

    Hypotheses in number order meet the reference lines of the same position:
    ``references`` has ``(test_dataset, line_no, ref)``.
    """
    joined = hyps.join(references, [hyps.test_dataset == references.test_dataset, hyps.seg_id == references.line_no])
    segments = joined.select(
        F.concat_ws("|", hyps.folder, hyps.test_dataset, hyps.seg_id.cast("string")).alias("seg_id"),
        hyps.folder, hyps.test_dataset, "hyp", "ref",
    )
    return metric_report(segments, ["folder", "test_dataset"], resamples=resamples, **options)


def harvest_folder(spark: SparkSession, root: str, by_language: bool = False) -> DataFrame:
    """One row per experiment and test set below ``root``.

    Only folders holding their own ``<folder>.json`` count. The by-language layout has no
    model prefix in folder names.
    """
    marked = reports.marked_folders(spark, root)
    first = 0 if by_language else 1
    key = reports.folder_key(F.col("folder"), first)

    def keyed(df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c != "folder"]
        return df.join(marked, "folder", "left_semi").select(*[v.alias(k) for k, v in key.items()], *others)

    metrics = keyed(reports.parse_reports(reports.read_reports(spark, root)))
    scores = keyed(reports.parse_segment_scores(reports.read_segment_lines(spark, root)))
    return hv.harvest(metrics, scores, hv.REPORT_KEYS)
