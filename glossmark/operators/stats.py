"""Corpus statistics over train, dev and test corpora."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.functions.keys import ratio
from glossmark.functions.text import bagged, bags
from glossmark.session import join_bounded, stage

SPLITS = ["train", "dev", "test"]
PAIRS = list(combinations(SPLITS, 2))

# Smooth idf of a term found in one of two documents; a term in both has idf 1.
RARE_IDF = 1 + math.log(1.5)


def token_counts(tokenised: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, token, n)`` from lines with ``tokens`` or ``bag``; lines are counted before anything is a row."""
    rows = bagged(tokenised).select(*keys, F.inline("bag"))
    return rows.groupBy(*keys, "token").agg(F.sum("n").alias("n"))


def clean_counts(
    counts: DataFrame, stop_words: list[str] | DataFrame, lemmas: DataFrame | None = None
) -> DataFrame:
    """Drop stop words and replace forms by lemmas, on counted tokens.

    ``lemmas`` has ``(form, lemma)``. Working after the count keeps a frequent
    token a single row in the join.
    """
    keys = [c for c in counts.columns if c not in ("token", "n")]
    if isinstance(stop_words, DataFrame):
        counts = counts.join(stop_words, "token", "left_anti")
    else:
        counts = counts.filter(~F.col("token").isin(stop_words))
    if lemmas is None:
        return counts
    joined = counts.join(lemmas.withColumnRenamed("form", "token"), "token", "left")
    return joined.groupBy(*keys, F.coalesce("lemma", "token").alias("token")).agg(F.sum("n").alias("n"))


def side_counts(counts: DataFrame, group: list[str]) -> DataFrame:
    """``(group, token, train, dev, test)``: one row per token with its three counts."""
    per_split = [
        F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(s) for s in SPLITS
    ]
    return counts.groupBy(*group, "token").agg(*per_split)


def corpus_sizes(lines: DataFrame, group: list[str]) -> DataFrame:
    """Line counts ``(group, train_size, dev_size, test_size)``."""
    return lines.groupBy(*group).agg(
        *[F.count(F.when(F.col("split") == s, 1)).alias(f"{s}_size") for s in SPLITS]
    )


def vocabulary_stats(sides: DataFrame, group: list[str]) -> DataFrame:
    """Vocabulary sizes, token totals and shared vocabulary per pair."""
    seen = {s: F.col(s) > 0 for s in SPLITS}
    return sides.groupBy(*group).agg(
        *[F.count(F.when(seen[s], 1)).alias(f"{s}_word_vocab_size") for s in SPLITS],
        *[F.sum(s).alias(f"{s}_tokens") for s in SPLITS],
        *[F.count(F.when(seen[a] & seen[b], 1)).alias(f"{a}_{b}_shared") for a, b in PAIRS],
    )


#: Distinct tokens, as a power of two, up to which the sketches of a corpus are exact; about 0.2 % of error beyond.
SKETCH_SIZE = 18


def sketched_vocabulary_stats(tokenised: DataFrame, group: list[str], size: int = SKETCH_SIZE) -> DataFrame:
    """The columns of ``vocabulary_stats`` from mergeable sketches of distinct tokens, without a row per token and corpus.

    Shared vocabularies are set intersections of the sketches. Only sketches are shuffled, of 2^``size`` entries at most each.
    """
    rows = bagged(tokenised).select(*group, "split", F.inline("bag"))
    sketches = rows.groupBy(*group).agg(
        *[F.theta_sketch_agg(F.when(F.col("split") == s, F.col("token")), size).alias(f"_{s}") for s in SPLITS],
        *[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(f"{s}_tokens") for s in SPLITS],
    )

    def number(sketch: Column) -> Column:
        return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("long")

    return sketches.select(
        *group, *[number(F.col(f"_{s}")).alias(f"{s}_word_vocab_size") for s in SPLITS], *[f"{s}_tokens" for s in SPLITS],
        *[number(F.theta_intersection(f"_{a}", f"_{b}")).alias(f"{a}_{b}_shared") for a, b in PAIRS],
    )


def overlap(shared: Column, a: Column, b: Column) -> Column:
    """Shared vocabulary over the sum (not the union) of both vocabularies."""
    return ratio(shared, a + b)


def ttr_distance(a: Column, b: Column) -> Column:
    return F.pow(1 - ratio(a, b), F.lit(2))


def derived_stats(stats: DataFrame) -> DataFrame:
    """Add sentence lengths, overlap, type-token ratios and their distances."""
    vocab = {s: F.col(f"{s}_word_vocab_size") for s in SPLITS}
    new = {f"avg_{s}_sentence_length": ratio(F.col(f"{s}_tokens"), F.col(f"{s}_size")) for s in SPLITS}
    new |= {f"{a}_{b}_word_overlap": overlap(F.col(f"{a}_{b}_shared"), vocab[a], vocab[b]) for a, b in PAIRS}
    stats = stats.withColumns(new)
    stats = stats.withColumns({f"ttr_{s}": ratio(vocab[s], F.col(f"{s}_tokens")) for s in SPLITS})
    return stats.withColumns(
        {f"{a}_{b}_ttr_distance": ttr_distance(F.col(f"ttr_{a}"), F.col(f"ttr_{b}")) for a, b in PAIRS}
    )


def _divergence(p: Column, q: Column) -> Column:
    """Terms of both relative entropies against the mean distribution."""
    m = (p + q) / 2
    left = F.when(p > 0, p * F.ln(p / m)).otherwise(F.lit(0.0))
    right = F.when(q > 0, q * F.ln(q / m)).otherwise(F.lit(0.0))
    return left + right


def jensen_shannon(sides: DataFrame, totals: DataFrame, group: list[str]) -> DataFrame:
    """Jensen-Shannon distance (natural log, square root) of each pair of corpora.

    ``totals`` has one row per group with ``<split>_tokens``; null where a side is empty.
    """
    small = totals.select(*group, *[f"{s}_tokens" for s in SPLITS])
    joined = join_bounded(sides, small, group)
    share = {s: ratio(F.col(s), F.col(f"{s}_tokens")) for s in SPLITS}
    sums = [F.sum(_divergence(share[a], share[b])).alias(f"{a}_{b}") for a, b in PAIRS]
    filled = joined.groupBy(*group).agg(*sums, *[F.max(f"{s}_tokens").alias(f"_{s}") for s in SPLITS])
    return filled.select(
        *group,
        *[
            F.when(
                (F.col(f"_{a}") > 0) & (F.col(f"_{b}") > 0),
                F.sqrt(F.greatest(F.col(f"{a}_{b}"), F.lit(0.0)) / 2),
            ).alias(f"{a}_{b}_jsd")
            for a, b in PAIRS
        ],
    )


def pair_plan(sizes: DataFrame, group: list[str]) -> DataFrame:
    """Which corpus is walked in chunks (``doc1``) and which is compared (``doc2``).

    Only dev and test are put longest first; training text always comes first.
    """
    dev_first = F.col("dev_size") > F.col("test_size")
    plans = F.array(
        F.struct(F.lit("train_dev").alias("pair"), F.lit("train").alias("doc1"), F.lit("dev").alias("doc2")),
        F.struct(F.lit("train_test").alias("pair"), F.lit("train").alias("doc1"), F.lit("test").alias("doc2")),
        F.struct(
            F.lit("dev_test").alias("pair"),
            F.when(dev_first, "dev").otherwise("test").alias("doc1"),
            F.when(dev_first, "test").otherwise("dev").alias("doc2"),
        ),
    )

    def size_of(doc: str) -> Column:
        return F.coalesce(*[F.when(F.col(doc) == s, F.col(f"{s}_size")) for s in SPLITS])

    return (
        sizes.select(*group, *[f"{s}_size" for s in SPLITS], F.inline(plans))
        .withColumn("len1", size_of("doc1"))
        .withColumn("len2", size_of("doc2"))
        .select(*group, "pair", "doc1", "doc2", "len1", "len2")
    )


def tfidf_pairs(tokenised: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean TF-IDF cosine distance between chunks of ``corpus1`` and ``corpus2``.

    ``tokenised`` has ``(corpus, line_no, bag)`` (or ``tokens``) with dense numbers, ``pairs`` has
    ``(corpus1, corpus2, len1, len2)``. Chunks of corpus1 have the length of corpus2; a
    short last chunk meets the same number of corpus2 lines. With two documents the
    smooth idf is 1 for shared and ``RARE_IDF`` for other terms, so each chunk needs only
    its own counts and the corpus2 counts of the terms they share. A chunk without tokens
    on either side has no distance and is left out of the mean; so is an empty corpus2.
    """
    both = ["corpus1", "corpus2"]
    tokenised = bagged(tokenised)
    live = stage(pairs.filter("len1 > 0 AND len2 > 0").withColumn("_pair", F.monotonically_increasing_id()), "pairs")
    # Chunk counts depend on the walked corpus and the chunk length only, so pairs share them. Walks and pairs go by number
    # wherever there is a row per token.
    walked = live.selectExpr("corpus1 AS corpus", "len1", "len2").distinct()
    walks = stage(walked.withColumn("_walk", F.monotonically_increasing_id()), "walks")
    chunked = (
        join_bounded(tokenised, walks, ["corpus"], staged=True)
        .selectExpr("_walk", "line_no div len2 AS chunk", "inline(bag) AS (token, n)")
        .groupBy("_walk", "chunk", "token")
        .agg(F.sum("n").cast("double").alias("c1"))
    )
    of_walk = live.join(walks.withColumnRenamed("corpus", "corpus1"), ["corpus1", "len1", "len2"])
    doc1 = join_bounded(chunked, of_walk.selectExpr("_walk", "_pair", "len1 div len2 AS last"), ["_walk"]).drop("_walk")
    compared = join_bounded(tokenised, live.selectExpr("corpus2 AS corpus", "_pair", "len1 % len2 AS tail"), ["corpus"])
    doc2 = stage(
        compared.selectExpr("_pair", "if(line_no < tail, 1, 0) AS in_tail", "inline(bag) AS (token, n)")
        .groupBy("_pair", "token")
        .agg(F.sum("n").cast("double").alias("full"), F.sum(F.col("n") * F.col("in_tail")).cast("double").alias("part")),
        "doc2-counts",
    )
    norms = doc2.groupBy("_pair").agg(F.expr("sum(full * full)").alias("full_sq"), F.expr("sum(part * part)").alias("part_sq"))
    k2 = RARE_IDF**2
    chunks = (
        doc1.join(doc2, ["_pair", "token"], "left")
        .withColumn("c2", F.expr("coalesce(if(chunk = last, part, full), 0)"))
        .groupBy("_pair", "chunk", "last")
        .agg(
            F.expr("sum(c1 * c2)").alias("dot"),
            F.expr(f"sum(c1 * c1 * if(c2 > 0, 1, {k2}D))").alias("sq1"),
            F.expr("sum(c2 * c2)").alias("shared_sq"),
        )
    )
    scored = join_bounded(chunks, norms, ["_pair"]).withColumn(
        "sq2", F.expr(f"if(chunk = last, part_sq, full_sq) * {k2}D - shared_sq * {k2 - 1}D")
    )
    scored = join_bounded(scored, live.select("_pair", *both), ["_pair"], staged=True)
    distance = 1 - ratio(F.col("dot"), F.sqrt("sq1") * F.sqrt("sq2"))
    return scored.groupBy(*both).agg(F.avg(distance).alias("distance"))


def tfidf_distance(tokenised: DataFrame, sizes: DataFrame, group: list[str]) -> DataFrame:
    """``tfidf_pairs`` over the three splits of each group, one column per pair."""

    def corpus(split: str) -> Column:
        return F.concat_ws("|", *group, split)

    plan = pair_plan(sizes, group).withColumns({"corpus1": corpus("doc1"), "corpus2": corpus("doc2")})
    plan = stage(plan, "plan")
    named = bagged(tokenised).select(corpus("split").alias("corpus"), "line_no", "bag")
    scored = tfidf_pairs(named, plan.select("corpus1", "corpus2", "len1", "len2"))
    found = plan.join(scored, ["corpus1", "corpus2"], "left")
    return found.groupBy(*group).agg(
        *[F.max(F.when(F.col("pair") == f"{a}_{b}", F.col("distance"))).alias(f"{a}_{b}_tf_idf") for a, b in PAIRS]
    )


def mean_vectors(vectors: DataFrame, keys: list[str], embedding: str = "embedding") -> DataFrame:
    """``(keys, mean)``: mean embedding as an array, summed vector by vector."""
    vectors = vectors.where(F.col(embedding).isNotNull())
    rows = vectors.select(*keys, array_to_vector(F.col(embedding).cast("array<double>")).alias("_v"))
    return rows.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(*keys, vector_to_array("_m").alias("mean"))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine of two arrays; null if either is null or zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda total, i: total + i)

    return 1 - ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def embedding_distance(vectors: DataFrame, group: list[str], embedding: str = "embedding") -> DataFrame:
    """Cosine distance between the mean embeddings of each pair of corpora."""
    means = mean_vectors(vectors, [*group, "split"], embedding)
    wide = means.groupBy(*group).agg(*[F.first(F.when(F.col("split") == s, F.col("mean")), True).alias(s) for s in SPLITS])
    return wide.select(*group, *[cosine_distance(F.col(a), F.col(b)).alias(f"{a}_{b}_st_similarity") for a, b in PAIRS])


# Output columns of the feature job, in their fixed order.
FEATURES = (
    ["dev_size", "test_size"]
    + [f"{s}_word_vocab_size" for s in SPLITS]
    + [f"avg_{s}_sentence_length" for s in SPLITS]
    + [f"{a}_{b}_word_overlap" for a, b in PAIRS]
    + [f"ttr_{s}" for s in SPLITS]
    + [f"{a}_{b}_ttr_distance" for a, b in PAIRS]
    + [f"{a}_{b}_jsd" for a, b in PAIRS]
    + [f"{a}_{b}_tf_idf" for a, b in PAIRS]
    + [f"{a}_{b}_st_similarity" for a, b in PAIRS]
)


def corpus_features(
    lines: DataFrame, vectors: DataFrame, group: list[str], tokeniser: str = "char"
) -> DataFrame:
    """The 26 features of each group from numbered lines and sentence embeddings."""
    tokenised = stage(bags(lines, tokeniser), "bags")
    sizes = stage(corpus_sizes(tokenised, group), "sizes")
    sides = stage(side_counts(token_counts(tokenised, [*group, "split"]), group), "sides")
    stats = stage(vocabulary_stats(sides, group), "vocabulary")
    table = derived_stats(sizes.join(stats, group, "left"))
    for part in (
        jensen_shannon(sides, stats, group),
        tfidf_distance(tokenised, sizes, group),
        embedding_distance(vectors, group),
    ):
        table = table.join(part, group, "left")
    return table.select(*group, "train_size", *FEATURES)


def corpus_profiles(tokenised: DataFrame, counts: DataFrame) -> DataFrame:
    """``(corpus, size, tokens, vocab)`` of each corpus."""
    sizes = tokenised.groupBy("corpus").agg(F.count(F.lit(1)).alias("size"))
    words = counts.groupBy("corpus").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("vocab"))
    return sizes.join(words, "corpus", "left").fillna(0, ["tokens", "vocab"])


def vocabulary_pairs(counts: DataFrame, profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(corpus1, corpus2, shared, jsd)`` from token counts of single corpora.

    Only counted vocabularies are repeated per pair, never text.
    """
    both = ["corpus1", "corpus2"]
    # pairs go by number wherever there is a row per token
    pairs = stage(pairs.select(*both).distinct().withColumn("_pair", F.monotonically_increasing_id()), "pairs")

    def side(own: str, a: str, b: str) -> DataFrame:
        named = join_bounded(counts, pairs.selectExpr(f"{own} AS corpus", "_pair"), ["corpus"])
        return named.selectExpr("_pair", "token", f"{a} AS a", f"{b} AS b")

    merged = (
        side("corpus1", "n", "0").unionByName(side("corpus2", "0", "n"))
        .groupBy("_pair", "token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    totals = pairs.join(profiles.selectExpr("corpus AS corpus1", "tokens AS total1"), "corpus1").join(
        profiles.selectExpr("corpus AS corpus2", "tokens AS total2"), "corpus2"
    )
    shared = join_bounded(merged, totals.select("_pair", "total1", "total2"), ["_pair"])
    p, q = ratio(F.col("a"), F.col("total1")), ratio(F.col("b"), F.col("total2"))
    sums = shared.groupBy("_pair").agg(
        F.count(F.when((F.col("a") > 0) & (F.col("b") > 0), 1)).alias("shared"),
        F.sum(_divergence(p, q)).alias("_d"),
        F.min(F.least("total1", "total2")).alias("_least"),
    )
    sums = join_bounded(sums, pairs, ["_pair"], staged=True)
    return sums.selectExpr(*both, "shared", "if(_least > 0, sqrt(greatest(_d, 0) / 2), NULL) AS jsd")


def embedding_pairs(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(corpus1, corpus2, similarity)``: cosine distance of mean embeddings."""
    means = stage(mean_vectors(vectors, ["corpus"]), "means")
    left, right = (means.selectExpr(f"corpus AS corpus{i}", f"mean AS m{i}") for i in (1, 2))
    joined = pairs.select("corpus1", "corpus2").distinct().join(left, "corpus1").join(right, "corpus2")
    return joined.select("corpus1", "corpus2", cosine_distance(F.col("m1"), F.col("m2")).alias("similarity"))


def experiment_features(experiments: DataFrame, tokenised: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Attach the features to experiment rows naming a train, dev and test corpus.

    ``experiments`` has ``train_corpus, dev_corpus, test_corpus``; ``tokenised`` has
    ``(corpus, line_no, bag)`` (or ``tokens``) and ``vectors`` ``(corpus, embedding)``. Every corpus and
    every pair of corpora is worked out once, however many rows use it.
    """
    tokenised = stage(bagged(tokenised), "bags")
    counts = stage(token_counts(tokenised, ["corpus"]), "counts")
    profiles = stage(corpus_profiles(tokenised, counts), "profiles")
    names = [f"{s}_corpus" for s in SPLITS]
    triples = stage(experiments.select(*names).distinct(), "triples")
    table = triples
    for s in SPLITS:
        own = profiles.selectExpr(
            f"corpus AS {s}_corpus", f"size AS {s}_size", f"tokens AS {s}_tokens", f"vocab AS {s}_word_vocab_size"
        )
        table = table.join(own, f"{s}_corpus", "left")
    table = stage(table, "triples")
    pairs = [
        table.selectExpr(f"{a}_corpus AS corpus1", f"{b}_corpus AS corpus2", f"{a}_size AS len1", f"{b}_size AS len2")
        for a, b in PAIRS
    ]
    # Dev against test is walked from the longer of the two.
    walk = [pairs[0], pairs[1], pairs[2].selectExpr(
        "if(len1 > len2, corpus1, corpus2) AS corpus1", "if(len1 > len2, corpus2, corpus1) AS corpus2",
        "greatest(len1, len2) AS len1", "least(len1, len2) AS len2",
    )]
    every = stage(pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct(), "pairs")
    walked = walk[0].unionByName(walk[1]).unionByName(walk[2]).distinct()
    found = [
        (vocabulary_pairs(counts, profiles, every), {"shared": "shared", "jsd": "jsd"}),
    ]
    if vectors is not None:
        found.append((embedding_pairs(vectors, every), {"similarity": "st_similarity"}))
    for part, columns in found:
        part = stage(part, "pair-features")
        for a, b in PAIRS:
            own = [f"{c} AS {a}_{b}_{name}" for c, name in columns.items()]
            table = table.join(
                part.selectExpr(f"corpus1 AS {a}_corpus", f"corpus2 AS {b}_corpus", *own), [f"{a}_corpus", f"{b}_corpus"], "left"
            )
    distances = stage(tfidf_pairs(tokenised, walked), "tfidf")
    for a, b in PAIRS:
        swap = (a, b) == ("dev", "test")
        first = "if(dev_size > test_size, dev_corpus, test_corpus)" if swap else f"{a}_corpus"
        second = "if(dev_size > test_size, test_corpus, dev_corpus)" if swap else f"{b}_corpus"
        keyed = table.withColumns({"_first": F.expr(first), "_second": F.expr(second)})
        own = distances.selectExpr("corpus1 AS _first", "corpus2 AS _second", f"distance AS {a}_{b}_tf_idf")
        table = keyed.join(own, ["_first", "_second"], "left").drop("_first", "_second")
    table = derived_stats(table)
    kept = [c for c in FEATURES if c in table.columns]
    return join_bounded(experiments, table.select(*names, "train_size", *kept), names, "left")
