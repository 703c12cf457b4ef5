"""Registered corpus queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.functions import keys
from glossmark.functions.text import bags, normalise, tokenise
from glossmark.operators import corpus, stats
from glossmark.plans import fixtures as fx
from glossmark.session import join_bounded, stage
from glossmark.sources.text import zip_lines

LANG = ["lang"]


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def pair_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = corpus.filter_pairs(fx.chat_pairs(spark, sf_dir), count_newline=True)
    return pairs.select(
        "conv_id", "turn", F.length("source_text").alias("source_chars"), F.length("target_text").alias("target_chars")
    )


PAIRS_SQL = """
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS source_text, a.text AS target_text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
kept AS (
  SELECT * FROM pairs
  WHERE length(source_text) + 1 >= 2 AND length(target_text) + 1 >= 2
    AND len(string_split(source_text, ' ')) <= 1023 AND len(string_split(target_text, ' ')) <= 1023)"""

PAIR_LENGTH_SQL = f"""WITH {PAIRS_SQL}
SELECT conv_id, turn, length(source_text)::INTEGER AS source_chars, length(target_text)::INTEGER AS target_chars FROM kept"""


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.numbered_corpus_lines(spark, sf_dir)
    return lines.select("lang", "split", F.col("line_no").cast("long").alias("line_no"), F.md5("text").alias("text_md5"))


NUMBERED_SQL = f"WITH {fx.LINES_SQL} SELECT lang, split, line_no, md5(text) AS text_md5 FROM lines"


def corpus_prefix(spark: SparkSession, sf_dir: str, size: int = 100) -> DataFrame:
    """The train-size limit: the first pairs of each corpus, ordered by conversation."""
    pairs = corpus.filter_pairs(fx.chat_pairs(spark, sf_dir), count_newline=True)
    numbered = pairs.withColumn("corpus", F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string"))).withColumn(
        "line_no", F.col("conv_id") * 1000 + F.col("turn")
    )
    kept = corpus.first_pairs(numbered, ["corpus"], size)
    return kept.select("corpus", "line_no", F.md5("source_text").alias("source_md5"))


CORPUS_PREFIX_SQL = f"""WITH {PAIRS_SQL},
ranked AS (
  SELECT 'c' || CAST(conv_id % 3 AS VARCHAR) AS corpus, conv_id * 1000 + turn AS line_no, source_text,
    row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id, turn) AS r FROM kept)
SELECT corpus, line_no, md5(source_text) AS source_md5 FROM ranked WHERE r <= 100"""


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dev and test lines of a language zipped by number, cut to the shorter corpus."""
    lines = stage(fx.numbered_corpus_lines(spark, sf_dir).filter("split <> 'train'"), "lines")
    zipped = zip_lines(lines.filter("split = 'dev'"), lines.filter("split = 'test'"), LANG)
    return zipped.select(
        "lang", F.col("line_no").cast("long").alias("line_no"),
        F.md5("source_text").alias("source_md5"), F.md5("target_text").alias("target_md5"),
    )


POSITIONAL_ZIP_SQL = f"""WITH {fx.LINES_SQL}
SELECT d.lang, d.line_no, md5(d.text) AS source_md5, md5(t.text) AS target_md5
FROM lines d JOIN lines t ON d.lang = t.lang AND d.line_no = t.line_no
WHERE d.split = 'dev' AND t.split = 'test'"""


def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(normalise("text")).alias("norm_md5"))


NORMALISED_SQL = r"""SELECT doc_id,
md5(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}\s]', '', 'g')) AS norm_md5 FROM documents"""


def _counts(spark: SparkSession, sf_dir: str, tokeniser: str) -> DataFrame:
    return stats.token_counts(bags(fx.corpus_lines(spark, sf_dir), tokeniser), ["lang", "split"])


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, "char")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, "word")


COUNTS_SQL = "SELECT lang, split, token, count(*) AS n FROM toks GROUP BY lang, split, token"
TOKEN_COUNTS_SQL = f"WITH {fx.LINES_SQL}, {fx.CHAR_TOKENS_SQL} {COUNTS_SQL}"
WORD_COUNTS_SQL = f"WITH {fx.LINES_SQL}, {fx.WORD_TOKENS_SQL} {COUNTS_SQL}"

# A parameter of the query, not a shipped list.
STOP_WORDS = ["the", "and", "of", "to", "in", "is", "that", "it", "for", "was"]


def clean_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop words dropped; lemmas from a table of benchmark word forms without endings."""
    counts = _counts(spark, sf_dir, "word").filter("lang = 'en'")
    forms = tokenise(fx.table(spark, sf_dir, "benchmark").select("text"), "word")
    lemmas = forms.select(F.explode("tokens").alias("form")).distinct().select(
        "form", F.regexp_replace("form", "(.)(ing|ed|s)$", "$1").alias("lemma")
    )
    return stats.clean_counts(counts, STOP_WORDS, lemmas).select("lang", "split", "token", "n")


CLEAN_WORDS_SQL = rf"""WITH {fx.LINES_SQL}, {fx.WORD_TOKENS_SQL},
forms AS (
  SELECT DISTINCT unnest(string_split_regex(
    regexp_replace(strip_accents(lower(text)), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+')) AS form FROM benchmark),
lemmas AS (SELECT form, regexp_replace(form, '(.)(ing|ed|s)$', '\1') AS lemma FROM forms WHERE form <> '')
SELECT lang, split, coalesce(lemma, token) AS token, count(*) AS n
FROM toks LEFT JOIN lemmas ON token = form
WHERE lang = 'en' AND token NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})
GROUP BY lang, split, coalesce(lemma, token)"""


def _sides(spark: SparkSession, sf_dir: str, tokeniser: str = "char") -> DataFrame:
    return stage(stats.side_counts(_counts(spark, sf_dir, tokeniser), LANG), "sides")


def corpus_vocab_ttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary, mean sentence length, overlap, TTR and TTR distances of words."""
    lines = fx.corpus_lines(spark, sf_dir)
    sizes = stats.corpus_sizes(lines, LANG)
    sides = stats.side_counts(stats.token_counts(bags(lines, "word"), ["lang", "split"]), LANG)
    vocabulary = stats.vocabulary_stats(sides, LANG)
    table = stats.derived_stats(sizes.join(vocabulary, LANG, "left"))
    floats = [c for c, t in table.dtypes if t == "double"]
    return rounded(table, floats)


def corpus_vocab_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from sketches of distinct words, which are exact for vocabularies of this size."""
    lines = fx.corpus_lines(spark, sf_dir)
    vocabulary = stats.sketched_vocabulary_stats(bags(lines, "word"), LANG)
    table = stats.derived_stats(stats.corpus_sizes(lines, LANG).join(vocabulary, LANG, "left"))
    return rounded(table, [c for c, t in table.dtypes if t == "double"])


SIDES_SQL = """
sides AS (
  SELECT lang, token, count(*) FILTER (WHERE split = 'train') AS train,
    count(*) FILTER (WHERE split = 'dev') AS dev, count(*) FILTER (WHERE split = 'test') AS test
  FROM toks GROUP BY lang, token)"""

STATS_SQL = """
sizes AS (
  SELECT lang, count(*) FILTER (WHERE split = 'train') AS train_size,
    count(*) FILTER (WHERE split = 'dev') AS dev_size, count(*) FILTER (WHERE split = 'test') AS test_size
  FROM lines GROUP BY lang),
vocab AS (
  SELECT lang, count(*) FILTER (WHERE train > 0) AS train_word_vocab_size,
    count(*) FILTER (WHERE dev > 0) AS dev_word_vocab_size,
    count(*) FILTER (WHERE test > 0) AS test_word_vocab_size,
    CAST(sum(train) AS BIGINT) AS train_tokens, CAST(sum(dev) AS BIGINT) AS dev_tokens,
    CAST(sum(test) AS BIGINT) AS test_tokens,
    count(*) FILTER (WHERE train > 0 AND dev > 0) AS train_dev_shared,
    count(*) FILTER (WHERE train > 0 AND test > 0) AS train_test_shared,
    count(*) FILTER (WHERE dev > 0 AND test > 0) AS dev_test_shared
  FROM sides GROUP BY lang),
base_stats AS (
  SELECT s.*, v.* EXCLUDE (lang),
    train_tokens / nullif(train_size, 0)::DOUBLE AS avg_train_sentence_length,
    dev_tokens / nullif(dev_size, 0)::DOUBLE AS avg_dev_sentence_length,
    test_tokens / nullif(test_size, 0)::DOUBLE AS avg_test_sentence_length,
    train_dev_shared / nullif(train_word_vocab_size + dev_word_vocab_size, 0)::DOUBLE AS train_dev_word_overlap,
    train_test_shared / nullif(train_word_vocab_size + test_word_vocab_size, 0)::DOUBLE AS train_test_word_overlap,
    dev_test_shared / nullif(dev_word_vocab_size + test_word_vocab_size, 0)::DOUBLE AS dev_test_word_overlap,
    train_word_vocab_size / nullif(train_tokens, 0)::DOUBLE AS ttr_train,
    dev_word_vocab_size / nullif(dev_tokens, 0)::DOUBLE AS ttr_dev,
    test_word_vocab_size / nullif(test_tokens, 0)::DOUBLE AS ttr_test
  FROM sizes s LEFT JOIN vocab v ON s.lang = v.lang),
all_stats AS (
  SELECT *, pow(1 - ttr_train / nullif(ttr_dev, 0), 2) AS train_dev_ttr_distance,
    pow(1 - ttr_train / nullif(ttr_test, 0), 2) AS train_test_ttr_distance,
    pow(1 - ttr_dev / nullif(ttr_test, 0), 2) AS dev_test_ttr_distance
  FROM base_stats)"""

_COUNT_COLUMNS = (
    [f"{s}_size" for s in stats.SPLITS]
    + [f"{s}_word_vocab_size" for s in stats.SPLITS]
    + [f"{s}_tokens" for s in stats.SPLITS]
    + [f"{a}_{b}_shared" for a, b in stats.PAIRS]
)
_RATIO_COLUMNS = (
    [f"avg_{s}_sentence_length" for s in stats.SPLITS]
    + [f"{a}_{b}_word_overlap" for a, b in stats.PAIRS]
    + [f"ttr_{s}" for s in stats.SPLITS]
    + [f"{a}_{b}_ttr_distance" for a, b in stats.PAIRS]
)


def _round_sql(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


VOCAB_TTR_SQL = f"""WITH {fx.LINES_SQL}, {fx.WORD_TOKENS_SQL}, {SIDES_SQL}, {STATS_SQL}
SELECT lang, {", ".join(_COUNT_COLUMNS)}, {_round_sql(_RATIO_COLUMNS)} FROM all_stats"""


def corpus_jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _sides(spark, sf_dir, "word")
    table = stats.jensen_shannon(sides, stats.vocabulary_stats(sides, LANG), LANG)
    return rounded(table, [f"{a}_{b}_jsd" for a, b in stats.PAIRS])


def _jsd_sql(a: str, b: str) -> str:
    p, q = f"({a} / nullif({a}_tokens, 0)::DOUBLE)", f"({b} / nullif({b}_tokens, 0)::DOUBLE)"
    terms = (
        f"sum(CASE WHEN {p} > 0 THEN {p} * ln({p} / (({p} + {q}) / 2)) ELSE 0 END "
        f"+ CASE WHEN {q} > 0 THEN {q} * ln({q} / (({p} + {q}) / 2)) ELSE 0 END)"
    )
    return f"CASE WHEN max({a}_tokens) > 0 AND max({b}_tokens) > 0 THEN sqrt(greatest({terms}, 0) / 2) END AS {a}_{b}_jsd"


JSD_TABLE_SQL = f"""
jsd AS (
  SELECT s.lang, {", ".join(_jsd_sql(a, b) for a, b in stats.PAIRS)}
  FROM sides s JOIN vocab v ON s.lang = v.lang GROUP BY s.lang)"""
_JSD_COLUMNS = [f"{a}_{b}_jsd" for a, b in stats.PAIRS]
JSD_SQL = f"""WITH {fx.LINES_SQL}, {fx.WORD_TOKENS_SQL}, {SIDES_SQL}, {STATS_SQL}, {JSD_TABLE_SQL}
SELECT lang, {_round_sql(_JSD_COLUMNS)} FROM jsd"""


def corpus_tfidf_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenised = stage(bags(fx.numbered_corpus_lines(spark, sf_dir), "word"), "bags")
    table = stats.tfidf_distance(tokenised, stage(stats.corpus_sizes(tokenised, LANG), "sizes"), LANG)
    return rounded(table, [f"{a}_{b}_tf_idf" for a, b in stats.PAIRS])


# Written from the definition: idf per chunk pair over both documents, then the cosine.
TFIDF_TABLES_SQL = """
plan AS (
  SELECT lang, 'train_dev' AS pair, 'train' AS doc1, 'dev' AS doc2, train_size AS len1, dev_size AS len2 FROM sizes
  UNION ALL SELECT lang, 'train_test', 'train', 'test', train_size, test_size FROM sizes
  UNION ALL SELECT lang, 'dev_test', CASE WHEN dev_size > test_size THEN 'dev' ELSE 'test' END,
    CASE WHEN dev_size > test_size THEN 'test' ELSE 'dev' END,
    greatest(dev_size, test_size), least(dev_size, test_size) FROM sizes),
live AS (SELECT * FROM plan WHERE len1 > 0 AND len2 > 0),
d1 AS (
  SELECT p.lang, p.pair, t.line_no // p.len2 AS chunk, t.token, count(*) AS c1
  FROM toks t JOIN live p ON t.lang = p.lang AND t.split = p.doc1 GROUP BY ALL),
chunks AS (
  SELECT DISTINCT d1.lang, d1.pair, chunk, least(len2, len1 - chunk * len2) AS lines2
  FROM d1 JOIN live p ON d1.lang = p.lang AND d1.pair = p.pair),
heads AS (SELECT DISTINCT lang, pair, lines2 FROM chunks),
head_counts AS (
  SELECT h.lang, h.pair, h.lines2, t.token, count(*) AS c2
  FROM heads h JOIN live p ON h.lang = p.lang AND h.pair = p.pair
  JOIN toks t ON t.lang = p.lang AND t.split = p.doc2 AND t.line_no < h.lines2 GROUP BY ALL),
d2 AS (
  SELECT c.lang, c.pair, c.chunk, h.token, h.c2
  FROM chunks c JOIN head_counts h ON c.lang = h.lang AND c.pair = h.pair AND c.lines2 = h.lines2),
terms AS (
  SELECT coalesce(d1.lang, d2.lang) AS lang, coalesce(d1.pair, d2.pair) AS pair,
    coalesce(d1.chunk, d2.chunk) AS chunk, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2,
    CASE WHEN c1 IS NOT NULL AND c2 IS NOT NULL THEN ln(3.0 / 3.0) + 1 ELSE ln(3.0 / 2.0) + 1 END AS idf
  FROM d1 FULL JOIN d2 ON d1.lang = d2.lang AND d1.pair = d2.pair AND d1.chunk = d2.chunk AND d1.token = d2.token),
dist AS (
  SELECT lang, pair, chunk,
    1 - sum(c1 * idf * c2 * idf) / nullif(sqrt(sum(pow(c1 * idf, 2))) * sqrt(sum(pow(c2 * idf, 2))), 0) AS d
  FROM terms GROUP BY lang, pair, chunk),
tfidf AS (
  SELECT lang, avg(d) FILTER (WHERE pair = 'train_dev') AS train_dev_tf_idf,
    avg(d) FILTER (WHERE pair = 'train_test') AS train_test_tf_idf,
    avg(d) FILTER (WHERE pair = 'dev_test') AS dev_test_tf_idf FROM dist GROUP BY lang)"""
_TFIDF_COLUMNS = [f"{a}_{b}_tf_idf" for a, b in stats.PAIRS]
TFIDF_SQL = f"""WITH {fx.LINES_SQL}, {fx.WORD_TOKENS_SQL}, {SIDES_SQL}, {STATS_SQL}, {TFIDF_TABLES_SQL}
SELECT lang, {_round_sql(_TFIDF_COLUMNS)} FROM tfidf"""


def embedding_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stats.embedding_distance(fx.embedding_splits(spark, sf_dir), [])
    return rounded(table, [f"{a}_{b}_st_similarity" for a, b in stats.PAIRS])


EMBED_TABLES_SQL = """
dims AS (
  SELECT CASE WHEN label < 7 THEN 'train' WHEN label < 9 THEN 'dev' ELSE 'test' END AS split,
    unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (
  SELECT pos, avg(x) FILTER (WHERE split = 'train') AS train, avg(x) FILTER (WHERE split = 'dev') AS dev,
    avg(x) FILTER (WHERE split = 'test') AS test FROM dims GROUP BY pos),
emb AS (
  SELECT 1 - sum(train * dev) / (sqrt(sum(train * train)) * sqrt(sum(dev * dev))) AS train_dev_st_similarity,
    1 - sum(train * test) / (sqrt(sum(train * train)) * sqrt(sum(test * test))) AS train_test_st_similarity,
    1 - sum(dev * test) / (sqrt(sum(dev * dev)) * sqrt(sum(test * test))) AS dev_test_st_similarity FROM means)"""
_EMBED_COLUMNS = [f"{a}_{b}_st_similarity" for a, b in stats.PAIRS]
EMBED_SQL = f"WITH {EMBED_TABLES_SQL} SELECT {_round_sql(_EMBED_COLUMNS)} FROM emb"


def corpus_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 26 features per language; vectors are dealt to the languages by id."""
    lines = fx.numbered_corpus_lines(spark, sf_dir)
    vectors = fx.embedding_splits(spark, sf_dir).withColumn(
        "lang", F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), (F.col("vec_id") % 4 + 1).cast("int"))
    )
    table = stats.corpus_features(lines, vectors, LANG)
    return rounded(table, [c for c in stats.FEATURES if dict(table.dtypes)[c] == "double"])


_EMBED_BY_LANG_SQL = EMBED_TABLES_SQL.replace(
    "SELECT CASE WHEN label", "SELECT ['de', 'en', 'es', 'fr'][vec_id % 4 + 1] AS lang, CASE WHEN label"
).replace("SELECT pos, avg", "SELECT lang, pos, avg").replace("GROUP BY pos)", "GROUP BY lang, pos)").replace(
    "SELECT 1 - sum(train * dev)", "SELECT lang, 1 - sum(train * dev)"
).replace("FROM means)", "FROM means GROUP BY lang)")

FEATURES_SQL = f"""WITH {fx.LINES_SQL}, {fx.CHAR_TOKENS_SQL}, {SIDES_SQL}, {STATS_SQL}, {JSD_TABLE_SQL},
{TFIDF_TABLES_SQL}, {_EMBED_BY_LANG_SQL}
SELECT a.lang, train_size, dev_size, test_size, {", ".join(f"{s}_word_vocab_size" for s in stats.SPLITS)},
{_round_sql(_RATIO_COLUMNS + _JSD_COLUMNS + _TFIDF_COLUMNS + _EMBED_COLUMNS)}
FROM all_stats a LEFT JOIN jsd ON a.lang = jsd.lang LEFT JOIN tfidf ON a.lang = tfidf.lang LEFT JOIN emb ON a.lang = emb.lang"""


def attach_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus statistics computed once per corpus, then joined to every experiment row."""
    sides = _sides(spark, sf_dir, "word")
    vocabulary = stats.vocabulary_stats(sides, LANG).select("lang", "train_word_vocab_size", "test_word_vocab_size")
    rows = (
        fx.table(spark, sf_dir, "orders")
        .select("o_orderkey", F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr", "xx")]),
                                           (F.col("o_custkey") % 5 + 1).cast("int")).alias("lang"))
    )
    return join_bounded(rows, vocabulary, LANG, "left").select(
        "o_orderkey", "lang", "train_word_vocab_size", "test_word_vocab_size"
    )


ATTACH_SQL = f"""WITH {fx.LINES_SQL}, {fx.WORD_TOKENS_SQL}, {SIDES_SQL}, {STATS_SQL},
rows AS (SELECT o_orderkey, ['de', 'en', 'es', 'fr', 'xx'][o_custkey % 5 + 1] AS lang FROM orders)
SELECT o_orderkey, rows.lang, train_word_vocab_size, test_word_vocab_size
FROM rows LEFT JOIN vocab ON rows.lang = vocab.lang"""


def key_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing, other-language and naming rules over the experiment lines."""
    rows = fx.sales(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "source_lang", "target_lang",
        F.when(F.col("train_dataset") == "d0", "cc_aligned").when(F.col("train_dataset") == "d1", "MT560_news")
        .otherwise(F.col("train_dataset")).alias("train_dataset"),
        "test_dataset", F.col("l_partkey").alias("size"),
    )
    source, target, size = F.col("source_lang"), F.col("target_lang"), F.col("size")
    return rows.select(
        "l_orderkey", "l_linenumber",
        keys.other_lang(target, source).alias("other_lang"),
        keys.dev_corpus(F.col("train_dataset")).alias("dev_dataset"),
        keys.subword_vocab_size(size * 30).alias("subword_vocab"),
        keys.folder_name("m2m100", source, target, F.col("train_dataset"), size).alias("folder"),
        keys.untuned_folder_name("m2m100", source, target).alias("untuned_folder"),
        keys.cell_key(source, size, target).alias("cell"),
        keys.same_domain(F.col("train_dataset"), F.col("test_dataset")).cast("int").alias("same_domain"),
    )


KEY_RULES_SQL = f"""WITH {fx.SALES_SQL},
r AS (SELECT *, CASE train_dataset WHEN 'd0' THEN 'cc_aligned' WHEN 'd1' THEN 'MT560_news' ELSE train_dataset END AS tr FROM sales)
SELECT l_orderkey, l_linenumber, CASE WHEN target_lang <> 'eng' THEN target_lang ELSE source_lang END AS other_lang,
  CASE WHEN tr = 'cc_aligned' OR starts_with(tr, 'MT560') THEN 'flores' ELSE tr END AS dev_dataset,
  least((l_partkey * 30) // 2, 10000) AS subword_vocab,
  'm2m100_' || source_lang || '_' || target_lang || '_' || tr || '_' || l_partkey AS folder,
  'm2m100_' || source_lang || '_' || target_lang || '_no_finetune' AS untuned_folder,
  source_lang || '_' || l_partkey || '_' || target_lang AS cell,
  CASE WHEN tr = test_dataset THEN 1 ELSE 0 END AS same_domain FROM r"""


def experiment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as experiments: training and test language differ, so corpora are shared widely."""
    langs = "array('de', 'en', 'es', 'fr')"
    rows = fx.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        f"concat({langs}[cast(o_custkey % 4 AS int)], '|train') AS train_corpus",
        f"concat({langs}[cast(o_custkey % 4 AS int)], '|dev') AS dev_corpus",
        f"concat({langs}[cast(o_orderkey % 4 AS int)], '|test') AS test_corpus",
    )
    lines = fx.numbered_corpus_lines(spark, sf_dir).selectExpr("concat(lang, '|', split) AS corpus", "line_no", "text")
    table = stats.experiment_features(rows, bags(lines, "word"))
    return rounded(table, [c for c in stats.FEATURES if c in table.columns and dict(table.dtypes)[c] == "double"])


def _pair_sql() -> str:
    """Statistics of corpora named ``lang|split`` and of pairs of them."""
    share = "(a / nullif(t1, 0)::DOUBLE)", "(b / nullif(t2, 0)::DOUBLE)"
    term = "CASE WHEN {0} > 0 THEN {0} * ln({0} / (({0} + {1}) / 2)) ELSE 0 END"
    return f"""
ct AS (SELECT lang || '|' || split AS corpus, line_no, token FROM toks),
cc AS (SELECT corpus, token, count(*) AS n FROM ct GROUP BY ALL),
cs AS (SELECT lang || '|' || split AS corpus, count(*) AS size FROM lines GROUP BY 1),
cp AS (SELECT cs.corpus, size, coalesce(sum(n), 0)::BIGINT AS tokens, count(n) AS vocab FROM cs LEFT JOIN cc USING (corpus) GROUP BY ALL),
rows AS (
  SELECT o_orderkey, ['de', 'en', 'es', 'fr'][o_custkey % 4 + 1] || '|train' AS train_corpus,
    ['de', 'en', 'es', 'fr'][o_custkey % 4 + 1] || '|dev' AS dev_corpus,
    ['de', 'en', 'es', 'fr'][o_orderkey % 4 + 1] || '|test' AS test_corpus FROM orders),
ps AS (
  SELECT DISTINCT train_corpus AS corpus1, dev_corpus AS corpus2 FROM rows
  UNION SELECT DISTINCT train_corpus, test_corpus FROM rows UNION SELECT DISTINCT dev_corpus, test_corpus FROM rows),
sizes2 AS (
  SELECT corpus1, corpus2, a.size AS s1, b.size AS s2, a.tokens AS t1, b.tokens AS t2
  FROM ps JOIN cp a ON a.corpus = corpus1 JOIN cp b ON b.corpus = corpus2),
voc AS (
  SELECT p.corpus1, p.corpus2, p.t1, p.t2, coalesce(x.token, y.token) AS token, coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS b
  FROM (SELECT s.*, c.token, c.n FROM sizes2 s JOIN cc c ON c.corpus = s.corpus1) x
  FULL JOIN (SELECT s.*, c.token, c.n FROM sizes2 s JOIN cc c ON c.corpus = s.corpus2) y
    ON x.corpus1 = y.corpus1 AND x.corpus2 = y.corpus2 AND x.token = y.token
  JOIN sizes2 p ON p.corpus1 = coalesce(x.corpus1, y.corpus1) AND p.corpus2 = coalesce(x.corpus2, y.corpus2)),
vp AS (
  SELECT corpus1, corpus2, count(*) FILTER (WHERE a > 0 AND b > 0) AS shared,
    sqrt(greatest(sum({term.format(*share)} + {term.format(*reversed(share))}), 0) / 2) AS jsd FROM voc GROUP BY corpus1, corpus2),
wp AS (
  SELECT corpus1, corpus2, CASE WHEN corpus1 LIKE '%dev' AND s1 <= s2 THEN corpus2 ELSE corpus1 END AS w1,
    CASE WHEN corpus1 LIKE '%dev' AND s1 <= s2 THEN corpus1 ELSE corpus2 END AS w2,
    CASE WHEN corpus1 LIKE '%dev' THEN greatest(s1, s2) ELSE s1 END AS l1, CASE WHEN corpus1 LIKE '%dev' THEN least(s1, s2) ELSE s2 END AS l2
  FROM sizes2),
e1 AS (SELECT corpus1, corpus2, line_no // l2 AS chunk, least(l2, l1 - line_no // l2 * l2) AS head, token, count(*) AS c1
  FROM wp JOIN ct ON ct.corpus = w1 GROUP BY ALL),
hd AS (SELECT DISTINCT corpus1, corpus2, head FROM e1),
e2 AS (SELECT corpus1, corpus2, head, token, count(*) AS c2
  FROM hd JOIN wp USING (corpus1, corpus2) JOIN ct ON ct.corpus = w2 AND ct.line_no < head GROUP BY ALL),
ch AS (SELECT DISTINCT corpus1, corpus2, chunk, head FROM e1),
e3 AS (SELECT ch.corpus1, ch.corpus2, chunk, token, c2 FROM ch JOIN e2 USING (corpus1, corpus2, head)),
tm AS (
  SELECT coalesce(e1.corpus1, e3.corpus1) AS corpus1, coalesce(e1.corpus2, e3.corpus2) AS corpus2,
    coalesce(e1.chunk, e3.chunk) AS chunk, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2,
    CASE WHEN c1 IS NOT NULL AND c2 IS NOT NULL THEN 1 ELSE ln(1.5) + 1 END AS idf
  FROM e1 FULL JOIN e3 ON e1.corpus1 = e3.corpus1 AND e1.corpus2 = e3.corpus2 AND e1.chunk = e3.chunk AND e1.token = e3.token),
td AS (
  SELECT corpus1, corpus2, chunk,
    1 - sum(c1 * idf * c2 * idf) / nullif(sqrt(sum(pow(c1 * idf, 2))) * sqrt(sum(pow(c2 * idf, 2))), 0) AS d FROM tm GROUP BY ALL),
tp AS (SELECT corpus1, corpus2, avg(d) AS tf_idf FROM td GROUP BY ALL)"""


def _experiment_sql() -> str:
    columns, joins = [], []
    for s in stats.SPLITS:
        joins.append(f"LEFT JOIN cp p_{s} ON p_{s}.corpus = {s}_corpus")
        columns += [f"p_{s}.size AS {s}_size", f"p_{s}.vocab AS {s}_word_vocab_size"]
        columns.append(f"round(p_{s}.tokens / nullif(p_{s}.size, 0)::DOUBLE, 6) AS avg_{s}_sentence_length")
        columns.append(f"round(p_{s}.vocab / nullif(p_{s}.tokens, 0)::DOUBLE, 6) AS ttr_{s}")
    for a, b in stats.PAIRS:
        joins.append(f"LEFT JOIN vp v_{a}_{b} ON v_{a}_{b}.corpus1 = {a}_corpus AND v_{a}_{b}.corpus2 = {b}_corpus")
        joins.append(f"LEFT JOIN tp t_{a}_{b} ON t_{a}_{b}.corpus1 = {a}_corpus AND t_{a}_{b}.corpus2 = {b}_corpus")
        ratio = f"(p_{a}.vocab / nullif(p_{a}.tokens, 0)::DOUBLE) / nullif(p_{b}.vocab / nullif(p_{b}.tokens, 0)::DOUBLE, 0)"
        columns += [
            f"round(v_{a}_{b}.shared / nullif(p_{a}.vocab + p_{b}.vocab, 0)::DOUBLE, 6) AS {a}_{b}_word_overlap",
            f"round(pow(1 - {ratio}, 2), 6) AS {a}_{b}_ttr_distance",
            f"round(v_{a}_{b}.jsd, 6) AS {a}_{b}_jsd", f"round(t_{a}_{b}.tf_idf, 6) AS {a}_{b}_tf_idf",
        ]
    return f"""WITH {fx.LINES_SQL}, {fx.WORD_TOKENS_SQL}, {_pair_sql()}
SELECT o_orderkey, train_corpus, dev_corpus, test_corpus, {", ".join(columns)} FROM rows {" ".join(joins)}"""


QUERIES = {
    "pair_length_filter": (pair_length_filter, PAIR_LENGTH_SQL),
    "numbered_lines": (numbered_lines, NUMBERED_SQL),
    "corpus_prefix": (corpus_prefix, CORPUS_PREFIX_SQL),
    "positional_zip": (positional_zip, POSITIONAL_ZIP_SQL),
    "normalised_text": (normalised_text, NORMALISED_SQL),
    "token_counts": (token_counts, TOKEN_COUNTS_SQL),
    "word_counts": (word_counts, WORD_COUNTS_SQL),
    "clean_word_counts": (clean_word_counts, CLEAN_WORDS_SQL),
    "corpus_vocab_ttr": (corpus_vocab_ttr, VOCAB_TTR_SQL),
    "corpus_vocab_sketched": (corpus_vocab_sketched, VOCAB_TTR_SQL),
    "corpus_jsd": (corpus_jsd, JSD_SQL),
    "corpus_tfidf_distance": (corpus_tfidf_distance, TFIDF_SQL),
    "embedding_distance": (embedding_distance, EMBED_SQL),
    "corpus_features_26": (corpus_features, FEATURES_SQL),
    "experiment_features": (experiment_features, _experiment_sql()),
    "attach_features": (attach_features, ATTACH_SQL),
    "key_rules": (key_rules, KEY_RULES_SQL),
}
