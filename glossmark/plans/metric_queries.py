"""Registered metric and harvest queries with their check SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.functions import text
from glossmark.operators import harvest as hv
from glossmark.operators import metrics as mt
from glossmark.operators import shifts as sh
from glossmark.operators.corpus import filter_pairs
from glossmark.plans import fixtures as fx
from glossmark.plans import jobs
from glossmark.plans.corpus_queries import PAIRS_SQL, rounded
from glossmark.session import spread, stage
from glossmark.sources import reports, tables
from glossmark.sources import text as text_source

SEG = ["seg_id", "lang"]
BLEU_OUT = ["bleu"] + [f"precision_{k}" for k in range(1, 5)] + ["brevity_penalty"]


def mteval_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    tokens = text.mteval_tokens(F.col("text"))
    return docs.select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5"))


def _mteval_sql(column: str) -> str:
    sql = column
    for pattern, replacement in text.MTEVAL_CLEANUP:
        pattern = pattern.replace("\\n", "\n")
        sql = f"replace({sql}, '{pattern}', '{replacement}')"
    sql = f"' ' || {sql} || ' '"
    for pattern, replacement in text.MTEVAL_RULES:
        sql = f"regexp_replace({sql}, '{pattern}', '{replacement.replace('$', chr(92))}', 'g')"
    return rf"trim(regexp_replace({sql}, '\s+', ' ', 'g'))"


MTEVAL_SQL = f"""WITH t AS (SELECT doc_id, {_mteval_sql("text")} AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n_tokens, md5(t) AS tokens_md5 FROM t"""


def bleu_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = mt.bleu_stats(fx.hyp_ref(spark, sf_dir), SEG, ["ref0", "ref1"])
    return rounded(mt.corpus_bleu(stats, ["lang"]), BLEU_OUT)


def bleu_lowercase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower-case option, without tokenisation and with smoothing."""
    rows = fx.hyp_ref(spark, sf_dir)
    stats = mt.bleu_stats(rows, SEG, ["ref0"], text.plain_tokens, lowercase=True)
    return rounded(mt.corpus_bleu(stats, ["lang"], smooth=True), BLEU_OUT)


def _gram_tables(tokens: str, refs: list[str], orders: int, separator: str = " ") -> str:
    sides = ["hyp", *refs]
    union = " UNION ALL ".join(f"SELECT seg_id, lang, {i} AS side, {s} AS w FROM {tokens}" for i, s in enumerate(sides))
    best = "greatest(" + ", ".join(f"c{i}" for i in range(1, len(sides))) + ", 0)"
    over = "OVER (PARTITION BY seg_id, side ORDER BY p)"
    parts = ["t"] + [f"lead(t, {j}) {over}" for j in range(1, orders)]
    runs = " UNION ALL ".join(
        "SELECT * FROM (SELECT seg_id, lang, side, {} AS n, {} AS gram FROM spots) g WHERE gram IS NOT NULL".format(
            n, f" || '{separator}' || ".join(parts[:n])
        )
        for n in range(1, orders + 1)
    )
    return f"""
side_words AS ({union}),
spots AS (
  SELECT seg_id, lang, side, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM side_words),
grams AS ({runs}),
counts AS (
  SELECT seg_id, lang, n, gram,
    {", ".join(f"count(*) FILTER (WHERE side = {i}) AS c{i}" for i in range(len(sides)))}
  FROM grams GROUP BY seg_id, lang, n, gram),
seg_sums AS (
  SELECT seg_id, lang, n, sum(c0) AS h, sum(c1) AS r, sum(least(c0, {best})) AS m
  FROM counts GROUP BY seg_id, lang, n)"""


_LENGTHS = """
lens AS (
  SELECT seg_id, lang, len(hyp) AS hyp_len, {closest} AS ref_len FROM toks)"""


def _bleu_sql(token_sql, refs: list[str], smooth: bool) -> str:
    if len(refs) == 2:
        closest = (
            "CASE WHEN abs(len(ref0) - len(hyp)) < abs(len(ref1) - len(hyp)) THEN len(ref0) "
            "WHEN abs(len(ref0) - len(hyp)) > abs(len(ref1) - len(hyp)) THEN len(ref1) "
            "ELSE least(len(ref0), len(ref1)) END"
        )
    else:
        closest = "len(ref0)"
    words = ", ".join(
        f"list_filter(string_split({token_sql(c)}, ' '), lambda x: x <> '') AS {c}" for c in ["hyp", *refs]
    )
    logs, missing = [], []
    for k in range(1, 5):
        missing.append(f"(CASE WHEN h{k} > 0 AND m{k} = 0 THEN 1 ELSE 0 END)")
        none = f"CASE WHEN h{k} > 0 THEN -ln(pow(2, {' + '.join(missing)}) * h{k}) ELSE -9999999999 END" if smooth else "-9999999999"
        logs.append(f"CASE WHEN h{k} > 0 AND m{k} > 0 THEN ln(m{k} / h{k}::DOUBLE) ELSE {none} END")
    bp = "CASE WHEN hyp_len = 0 OR ref_len = 0 THEN 0 WHEN hyp_len < ref_len THEN exp(1 - ref_len / hyp_len::DOUBLE) ELSE 1 END"
    sums = ", ".join(f"coalesce(sum(h) FILTER (WHERE n = {k}), 0) AS h{k}, coalesce(sum(m) FILTER (WHERE n = {k}), 0) AS m{k}" for k in range(1, 5))
    return f"""WITH {fx.HYP_REF_SQL},
toks AS (SELECT seg_id, lang, {words} FROM hr),
{_gram_tables("toks", refs, 4)}, {_LENGTHS.format(closest=closest)},
len_sums AS (SELECT lang, sum(hyp_len)::BIGINT AS hyp_len, sum(ref_len)::BIGINT AS ref_len FROM lens GROUP BY lang),
match_sums AS (SELECT lang, {sums} FROM seg_sums GROUP BY lang)
SELECT l.lang, round(100 * {bp} * exp(({" + ".join(logs)}) / 4), 6) AS bleu,
  {", ".join(f"round(coalesce(100 * m{k} / nullif(h{k}, 0)::DOUBLE, 0), 6) AS precision_{k}" for k in range(1, 5))},
  round({bp}, 6) AS brevity_penalty, hyp_len, ref_len
FROM len_sums l LEFT JOIN match_sums m ON l.lang = m.lang"""


BLEU_SQL = _bleu_sql(_mteval_sql, ["ref0", "ref1"], False)


def _plain_lower(column: str) -> str:
    return rf"regexp_replace(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\s+', ' ', 'g')"


BLEU_LOWER_SQL = _bleu_sql(_plain_lower, ["ref0"], True)


def _chrf(spark: SparkSession, sf_dir: str, word_order: int) -> DataFrame:
    stats = mt.chrf_stats(fx.hyp_ref(spark, sf_dir), SEG, "ref0", word_order)
    return rounded(mt.corpus_chrf(stats, ["lang"], word_order), ["chrf"])


def chrf_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chrf(spark, sf_dir, 0)


def chrf_words_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chrf(spark, sf_dir, 2)


def _edge_words_sql(column: str) -> str:
    marks = text.PUNCTUATION.replace("'", "''")
    words = rf"list_filter(string_split(regexp_replace({column}, '\s+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""flatten(list_transform({words}, lambda x: CASE WHEN length(x) = 1 THEN [x]
      WHEN instr('{marks}', right(x, 1)) > 0 THEN [left(x, length(x) - 1), right(x, 1)]
      WHEN instr('{marks}', left(x, 1)) > 0 THEN [left(x, 1), right(x, length(x) - 1)] ELSE [x] END))"""


def _chrf_sql(word_order: int) -> str:
    chars = r"list_filter(string_split(regexp_replace({c}, '\s+', '', 'g'), ''), lambda x: x <> '')"
    orders = 6 + word_order

    def named(prefix: str, n: int, source: str, separator: str) -> str:
        body = _gram_tables(source, ["ref0"], n, separator)
        for name in ("side_words", "spots", "grams", "counts", "seg_sums"):
            body = body.replace(name, f"{prefix}_{name}")
        return body

    parts = [
        fx.HYP_REF_SQL,
        "ctoks AS (SELECT seg_id, lang, {}, {} FROM hr)".format(
            chars.format(c="hyp") + " AS hyp", chars.format(c="ref0") + " AS ref0"
        ),
        named("c", 6, "ctoks", ""),
    ]
    union = "SELECT lang, n AS k, h, r, m FROM c_seg_sums"
    if word_order:
        parts.append(f"wtoks AS (SELECT seg_id, lang, {_edge_words_sql('hyp')} AS hyp, {_edge_words_sql('ref0')} AS ref0 FROM hr)")
        parts.append(named("w", word_order, "wtoks", " "))
        union += " UNION ALL SELECT lang, n + 6, h, r, m FROM w_seg_sums"
    return f"""WITH {", ".join(parts)},
per_order AS (
  SELECT lang, k, sum(CASE WHEN r > 0 THEN h ELSE 0 END) AS h, sum(r) AS r, sum(m) AS m FROM ({union}) u GROUP BY lang, k),
pr AS (
  SELECT lang, avg(m / h::DOUBLE) FILTER (WHERE h > 0 AND r > 0) AS p, avg(m / r::DOUBLE) FILTER (WHERE h > 0 AND r > 0) AS q
  FROM per_order WHERE k <= {orders} GROUP BY lang)
SELECT lang, round(coalesce(100 * 5 * p * q / nullif(4 * p + q, 0), 0), 6) AS chrf FROM pr"""


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as references; hypotheses with words replaced, inserted or left out, by document."""
    docs = spread(fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    words = docs.select("doc_id", "lang", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("w"))
    changed = "transform(w, (x, i) -> if(i % 7 = doc_id % 7, '■', x))"
    inserted = f"flatten(transform({changed}, (x, i) -> if(i % 13 = 5, array(x, '□'), array(x))))"
    shorter = "filter(w, (x, i) -> i % 5 <> doc_id % 5)"
    return words.selectExpr(
        "doc_id AS seg_id", "lang", "array_join(w, ' ') AS ref0",
        f"array_join(CASE doc_id % 4 WHEN 0 THEN {changed} WHEN 1 THEN {inserted} WHEN 2 THEN {shorter} ELSE array() END, ' ') AS hyp",
    )


def edit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = mt.edit_stats(_edited(spark, sf_dir), SEG, "ref0")
    return rounded(mt.corpus_edit_rate(stats, ["lang"]), ["edit_rate"])


# Signs put in occur in no reference, so a replaced word costs one edit wherever it is and so does
# an inserted one; a hypothesis that only lacks words costs one for each, an empty one all.
EDIT_SQL = r"""WITH d AS (
  SELECT doc_id, lang, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS n FROM documents),
hits AS (
  SELECT d.*, (SELECT count(*) FROM range(n) AS t(i) WHERE i % 7 = doc_id % 7) AS replaced,
    (SELECT count(*) FROM range(n) AS t(i) WHERE i % 13 = 5) AS inserted,
    (SELECT count(*) FROM range(n) AS t(i) WHERE i % 5 = doc_id % 5) AS dropped FROM d),
e AS (
  SELECT lang, n, CASE doc_id % 4 WHEN 0 THEN replaced WHEN 1 THEN replaced + inserted WHEN 2 THEN dropped ELSE n END AS edits FROM hits)
SELECT lang, sum(edits)::BIGINT AS edits, sum(n)::BIGINT AS ref_words, round(100 * sum(edits) / sum(n)::DOUBLE, 6) AS edit_rate
FROM e GROUP BY lang"""


def bleu_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = mt.bleu_stats(fx.hyp_ref(spark, sf_dir), SEG, ["ref0"], text.plain_tokens)
    scores = mt.bootstrap_scores(stats, ["lang"], F.col("seg_id").cast("string"), mt.BLEU_COLUMNS, mt.bleu_score(), jobs.RESAMPLES)
    return rounded(mt.confidence(scores, ["lang"], jobs.RESAMPLES), ["confidence_mean", "confidence_var"])


def _plain(column: str) -> str:
    return rf"regexp_replace({column}, '\s+', ' ', 'g')"


# Poisson(1) weights of 32-bit draws: weight k from the k-th bound on.
def _poisson_weight(u: str) -> str:
    bounds, below = [], 0.0
    for k in range(16):
        below += math.exp(-1) / math.factorial(k)
        if int(below * 2**32) >= 2**32 - 1:
            break
        bounds.append(int(below * 2**32))
    return " + ".join(f"(CASE WHEN {u} >= {b} THEN 1 ELSE 0 END)" for b in bounds)


def _resampled(seg: str, names: list[str], score: str) -> str:
    """Mean and half-width per language from ``seg`` (``... seg AS (SELECT seg_id, lang, names)``)."""
    n, cut = jobs.RESAMPLES, jobs.RESAMPLES // 40
    return f"""{seg},
drawn AS (SELECT seg_id, b, md5('12345|' || b || '|' || seg_id) AS d FROM (SELECT DISTINCT seg_id FROM seg), unnest(range({-(-n // 4)})) AS t(b)),
weights AS (
  SELECT seg_id, b * 4 + j AS resample, ('0x' || substr(d, 1 + 8 * j, 8))::BIGINT AS u FROM drawn, unnest(range(4)) AS t(j) WHERE b * 4 + j < {n}),
w AS (SELECT seg.*, resample, {_poisson_weight("u")} AS wt FROM seg JOIN weights USING (seg_id)),
sums AS (SELECT lang, resample, {", ".join(f"sum({c} * wt) AS {c}" for c in names)} FROM w WHERE wt > 0 GROUP BY lang, resample),
scores AS (SELECT lang, {score} AS score FROM sums),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score) AS r FROM scores)
SELECT lang, round(avg(score), 6) AS mean,
  round((max(score) FILTER (WHERE r = {n - cut}) - max(score) FILTER (WHERE r = {cut + 1})) / 2, 6) AS se
FROM ranked GROUP BY lang"""


def _bleu_resampled(token_sql) -> str:
    head = _bleu_sql(token_sql, ["ref0"], False).split("len_sums AS")[0].rstrip().rstrip(",")
    per_seg = ", ".join(f"coalesce(sum(h) FILTER (WHERE n = {k}), 0) AS h{k}, coalesce(sum(m) FILTER (WHERE n = {k}), 0) AS m{k}" for k in range(1, 5))
    logs = " + ".join(f"CASE WHEN h{k} > 0 AND m{k} > 0 THEN ln(m{k} / h{k}::DOUBLE) ELSE -9999999999 END" for k in range(1, 5))
    seg = f"""{head},
seg AS (SELECT l.seg_id, l.lang, hyp_len, ref_len, {per_seg}
  FROM lens l LEFT JOIN seg_sums s ON l.seg_id = s.seg_id GROUP BY l.seg_id, l.lang, hyp_len, ref_len)"""
    score = f"""CASE WHEN hyp_len = 0 OR ref_len = 0 THEN 0 ELSE
    100 * CASE WHEN hyp_len < ref_len THEN exp(1 - ref_len / hyp_len::DOUBLE) ELSE 1 END * exp(({logs}) / 4) END"""
    return _resampled(seg, ["hyp_len", "ref_len"] + [f"{x}{k}" for k in range(1, 5) for x in "hm"], score)


def _chrf_resampled(word_order: int) -> str:
    head = _chrf_sql(word_order).split("per_order AS")[0].rstrip().rstrip(",")
    orders = 6 + word_order
    union = "SELECT seg_id, lang, n AS k, h, r, m FROM c_seg_sums" + (
        " UNION ALL SELECT seg_id, lang, n + 6, h, r, m FROM w_seg_sums" if word_order else ""
    )
    names = [f"{x}{k}" for k in range(1, orders + 1) for x in "hrm"]
    value = {"h": "CASE WHEN r > 0 THEN h ELSE 0 END", "r": "r", "m": "m"}
    sums = ", ".join(f"coalesce(sum({value[c[0]]}) FILTER (WHERE k = {c[1:]}), 0) AS {c}" for c in names)
    seg = f"{head},\nseg AS (SELECT seg_id, lang, {sums} FROM ({union}) u GROUP BY seg_id, lang)"
    have = [f"h{k} > 0 AND r{k} > 0" for k in range(1, orders + 1)]
    count = " + ".join(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for c in have)
    share = {
        x: "(" + " + ".join(f"(CASE WHEN {c} THEN m{k} / {x}{k}::DOUBLE ELSE 0 END)" for k, c in enumerate(have, 1)) + f") / nullif({count}, 0)"
        for x in "hr"
    }
    score = f"coalesce(100 * 5 * ({share['h']}) * ({share['r']}) / nullif(4 * ({share['h']}) + ({share['r']}), 0), 0)"
    return _resampled(seg, names, score)


def _edits_resampled() -> str:
    words = "len(list_filter(string_split({}, ' '), lambda x: x <> ''))"
    hyp, ref = words.format(_plain("hyp")), words.format(_plain("ref0"))
    seg = f"WITH {fx.HYP_REF_SQL},\nseg AS (SELECT seg_id, lang, {ref} - {hyp} AS e, {ref} AS n FROM hr)"
    return _resampled(seg, ["e", "n"], "100 * e / nullif(n, 0)::DOUBLE")


BOOTSTRAP_SQL = f"SELECT lang, mean AS confidence_mean, se AS confidence_var FROM ({_bleu_resampled(_plain)}) q"


def task_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and F1 of a length rule against the document labels, per language."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id").select(
        "lang",
        F.when(F.col("quality") == 1, "good").otherwise("O").alias("label"),
        F.when(F.col("n_chars") > 1000, "good").otherwise("O").alias("predicted"),
    )
    both = mt.accuracy(rows, ["lang"]).join(mt.micro_f1(rows, ["lang"]), "lang")
    return rounded(both, ["accuracy", "f1"])


TASK_SCORES_SQL = """WITH r AS (
  SELECT lang, quality = 1 AS y, n_chars > 1000 AS p FROM documents JOIN labels USING (doc_id))
SELECT lang, round(100 * avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(200 * count(*) FILTER (WHERE y AND p) / nullif(count(*) FILTER (WHERE y) + count(*) FILTER (WHERE p), 0)::DOUBLE, 6) AS f1
FROM r GROUP BY lang"""


def generator_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses cut out of a log made of documents: source, hypothesis and detail lines."""
    docs = fx.table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    body = F.regexp_replace("text", "[ \n]", "\t")
    log = docs.select(
        F.explode(
            F.array(
                F.concat(F.lit("S-"), number, F.lit("\t"), body),
                F.concat(F.lit("H-"), number, F.lit("\t-0.5\t"), body),
                F.concat(F.lit("D-"), number, F.lit("\t-0.5\t"), body),
            )
        ).alias("text")
    )
    return text_source.hypotheses(log).select("seg_id", F.md5("hyp").alias("hyp_md5"))


GENERATOR_SQL = """SELECT doc_id AS seg_id, md5(replace(replace(text, chr(10), chr(9)), ' ', chr(9))) AS hyp_md5 FROM documents"""


def translation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat pairs as translation records, read back and length-filtered."""
    pairs = fx.chat_pairs(spark, sf_dir)
    record = F.struct(F.create_map(F.lit("ind"), "source_text", F.lit("eng"), "target_text").alias("translation"))
    lines = pairs.select("conv_id", "turn", F.to_json(record).alias("text"))
    parsed = filter_pairs(text_source.parse_translations(lines, "ind"))
    return parsed.select("conv_id", "turn", F.md5("source_text").alias("source_md5"), F.md5("target_text").alias("target_md5"))


TRANSLATION_SQL = f"""WITH {PAIRS_SQL}
SELECT conv_id, turn, md5(source_text) AS source_md5, md5(target_text) AS target_md5 FROM kept
WHERE length(source_text) >= 2 AND length(target_text) >= 2"""


def task_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.document_splits(spark, sf_dir)
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("label_text"))
    rows = tables.task_rows(docs.join(labels, "doc_id"), "intent", "test")
    return rows.select(F.md5("prompt").alias("prompt_md5"), "response")


TASK_PROJECTION_SQL = """SELECT md5(text) AS prompt_md5, 'q' || quality AS response
FROM documents JOIN labels USING (doc_id) WHERE doc_id % 10 = 9"""


def _score() -> F.Column:
    """A segment score with many digits, so rounding to four has no ties."""
    return F.col("l_extendedprice") * 0.0000314159


SCORE_SQL = "(l_extendedprice * 0.0000314159::DOUBLE)"


def segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score lines of every line item, parsed and summarised per experiment."""
    lines = fx.sales(spark, sf_dir).select(
        *fx.EXPERIMENT_IDS,
        F.concat(
            F.lit('"COMET": '),
            F.when(F.col("l_linenumber") == 7, F.concat(F.lit("-"), _score().cast("string")))
            .when(F.col("l_linenumber") == 6, F.lit("1"))
            .otherwise(F.concat(_score().cast("string"), F.lit(', "COMET": 0.99'))),
        ).alias("text"),
    )
    return hv.segment_summary(reports.parse_segment_scores(lines), fx.EXPERIMENT_IDS)


SEGMENT_SQL = f"""WITH {fx.SALES_SQL}
SELECT source_lang, target_lang, train_dataset, test_dataset,
  round_even(avg({SCORE_SQL}), 4) AS comet_score_mean, round_even(stddev_pop({SCORE_SQL}), 4) AS comet_score_se
FROM sales WHERE l_linenumber NOT IN (6, 7) GROUP BY ALL"""


def _report_text(mean, se) -> F.Column:
    """A report in the shape the scoring tool prints: two metric lists around other text."""

    def metric(name: str, tok: str | None, with_confidence: bool):
        parts = [F.lit(f'{{\n "name": "{name}"')]
        if tok:
            parts.append(F.lit(f',\n "tok": "{tok}"'))
        if with_confidence:
            parts += [F.lit(',\n "confidence_mean": '), mean.cast("string"), F.lit(',\n "confidence_var": '), se.cast("string")]
        return F.concat(*parts, F.lit("\n}"))

    first = F.concat(F.lit("log line\n[\n"), metric("BLEU", "flores200", True), F.lit(",\n"), metric("chrF2++", None, True), F.lit("\n]\n"))
    second = F.concat(
        F.lit("[\n"), metric("BLEU", "none", True), F.lit(",\n"), metric("chrF2", None, True), F.lit(",\n"),
        metric("TER", None, False), F.lit("\n]\nend\n"),
    )
    return F.concat(first, second)


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per experiment, in a folder named after it."""
    rows = fx.experiments(spark, sf_dir)
    folder = F.concat_ws("_", F.lit("m2m100"), "source_lang", "target_lang", F.lit("corpus"), "train_dataset", F.col("dataset_size").cast("string"))
    return rows.select(
        folder.alias("folder"),
        "test_dataset",
        _report_text(F.col("dataset_size") / 1000, F.col("eng_target").cast("double")).alias("content"),
    )


def _keyed(df: DataFrame) -> DataFrame:
    others = [c for c in df.columns if c != "folder"]
    return df.select(*[v.alias(k) for k, v in reports.folder_key(F.col("folder")).items()], *others)


def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(reports.parse_reports(_reports(spark, sf_dir)))


_REPORT_KEYS_SQL = "source_lang, target_lang, 'corpus_' || train_dataset AS train_dataset, CAST(dataset_size AS VARCHAR) AS dataset_size, test_dataset"
REPORT_SQL = f"""{fx.EXPERIMENTS_SQL},
names AS (SELECT unnest(['spBLEU', 'chrF2++', 'BLEU', 'chrF2', 'TER']) AS metric)
SELECT {_REPORT_KEYS_SQL}, metric, CASE WHEN metric = 'TER' THEN 0 ELSE dataset_size / 1000.0 END::DOUBLE AS mean,
  CASE WHEN metric = 'TER' THEN 0 ELSE eng_target END::DOUBLE AS se FROM exp_all, names"""


def harvest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports joined with segment scores; experiments with an odd size have no score file."""
    metrics = stage(report_metrics(spark, sf_dir), "metrics")
    sizes = fx.experiments(spark, sf_dir).select(*fx.EXPERIMENT_IDS, "dataset_size")
    lines = fx.sales(spark, sf_dir).select(*fx.EXPERIMENT_IDS, F.concat(F.lit('"COMET": '), _score().cast("string")).alias("text"))
    scores = (
        reports.parse_segment_scores(lines)
        .join(sizes.filter("(dataset_size / 1000) % 2 = 0"), fx.EXPERIMENT_IDS)
        .withColumn("train_dataset", F.concat(F.lit("corpus_"), "train_dataset"))
        .withColumn("dataset_size", F.col("dataset_size").cast("string"))
    )
    return hv.harvest(metrics, scores, hv.REPORT_KEYS)


HARVEST_SQL = f"""{fx.EXPERIMENTS_SQL},
seg AS (
  SELECT source_lang, target_lang, train_dataset, test_dataset, round_even(avg({SCORE_SQL}), 4) AS comet_score_mean,
    round_even(stddev_pop({SCORE_SQL}), 4) AS comet_score_se FROM sales GROUP BY ALL)
SELECT {_REPORT_KEYS_SQL},
  {", ".join(f'''{"0.0" if m == "TER" else "dataset_size / 1000.0"}::DOUBLE AS "{m}_mean", {"0.0" if m == "TER" else "eng_target"}::DOUBLE AS "{m}_se"''' for m in hv.REPORT_METRICS)},
  comet_score_mean, comet_score_se
FROM exp_all JOIN seg USING (source_lang, target_lang, train_dataset, test_dataset) WHERE (dataset_size / 1000) % 2 = 0"""


PROXY_COLUMNS = [("m2m100_ft", "spBLEU"), ("trfm", "spBLEU"), ("small100_ft", "spBLEU"), ("m2m100_noft", "spBLEU")]


def proxy_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long scores of four models to one wide row; the untuned model joins without corpus."""
    rows = stage(fx.experiments(spark, sf_dir), "experiments")
    keys = [*fx.EXPERIMENT_IDS]

    def scores(model: str, tuned: bool, mean: str, se) -> F.Column:
        return F.struct(
            F.lit(model).alias("model"), F.lit(tuned).alias("tuned"), F.lit("spBLEU").alias("metric"),
            F.col(mean).alias("mean"), se.alias("se"),
        )

    none = F.lit(0.0)
    long = rows.select(
        *keys,
        F.inline(
            F.array(
                scores("m2m100", True, "m2m100_ft_spBLEU_mean", F.col("m2m100_ft_spBLEU_se")),
                scores("trfm", True, "trfm_spBLEU_mean", none),
                scores("small100", True, "small100_ft_spBLEU_mean", none),
            )
        ),
    )
    untuned = rows.groupBy("source_lang", "target_lang", "test_dataset").agg(F.max("ttr_test").alias("mean")).select(
        "source_lang", "target_lang", F.lit(None).cast("string").alias("train_dataset"), "test_dataset",
        F.lit("m2m100").alias("model"), F.lit(False).alias("tuned"), F.lit("spBLEU").alias("metric"), "mean", F.lit(0.0).alias("se"),
    )
    wide = hv.proxy_wide(long.unionByName(untuned), keys, ["source_lang", "target_lang", "test_dataset"], PROXY_COLUMNS)
    return rounded(wide, ["m2m100_ft_spBLEU_se"])


PROXY_SQL = f"""{fx.EXPERIMENTS_SQL},
u AS (SELECT source_lang, target_lang, test_dataset, max(ttr_test) AS m FROM exp_all GROUP BY ALL)
SELECT e.source_lang, e.target_lang, train_dataset, e.test_dataset,
  m2m100_ft_spBLEU_mean, round(m2m100_ft_spBLEU_se, 6) AS "m2m100_ft_spBLEU_se",
  trfm_spBLEU_mean, 0.0::DOUBLE AS "trfm_spBLEU_se",
  small100_ft_spBLEU_mean, 0.0::DOUBLE AS "small100_ft_spBLEU_se",
  m AS "m2m100_noft_spBLEU_mean", 0.0::DOUBLE AS "m2m100_noft_spBLEU_se"
FROM exp_all e JOIN u ON e.source_lang = u.source_lang AND e.target_lang = u.target_lang AND e.test_dataset = u.test_dataset"""


def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics with confidence, per language, as the scoring job writes them."""
    segments = fx.hyp_ref(spark, sf_dir).selectExpr("seg_id", "lang", "hyp", "ref0 AS ref")
    return rounded(jobs.metric_report(segments, ["lang"]), ["mean", "se"])


REPORT_PARTS = {
    "BLEU-mteval": _bleu_resampled(_mteval_sql), "BLEU": _bleu_resampled(_plain), "chrF2++": _chrf_resampled(2), "chrF2": _chrf_resampled(0),
    "edit_rate": _edits_resampled(),
}
METRIC_REPORT_SQL = "\nUNION ALL\n".join(f"SELECT lang, '{name}' AS metric, mean, se FROM ({sql}) q" for name, sql in REPORT_PARTS.items())


def metric_report_without_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU rows of a corpus in which no two neighbouring words agree: without smoothing they are 0."""
    docs = spread(fx.table(spark, sf_dir, "documents").select("doc_id", "lang"))
    segments = docs.selectExpr("doc_id AS seg_id", "lang", "'a b c d e f' AS hyp", "'a x c y e z' AS ref")
    found = jobs.metric_report(segments, ["lang"]).where("metric LIKE 'BLEU%'")
    return rounded(found, ["mean", "se"])


WITHOUT_MATCH_SQL = """SELECT lang, metric, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS se
FROM (SELECT DISTINCT lang FROM documents), (SELECT unnest(['BLEU', 'BLEU-mteval']) AS metric)"""


def translation_edit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits with block shifts in percent of reference words, all segments of every document, per language.

    The hypotheses have the last third of their words in front, so whole runs stand in the wrong place.
    """
    words = "split(hyp, ' ')"
    cut = f"cast(size({words}) * 2 / 3 AS int)"
    turned = f"array_join(concat(slice({words}, {cut} + 1, size({words})), slice({words}, 1, {cut})), ' ')"
    segments = fx.hyp_ref(spark, sf_dir).selectExpr("seg_id", "lang", f"{turned} AS hyp", "ref0 AS ref")
    return rounded(sh.corpus_ter(sh.ter_stats(segments, ["seg_id", "lang"], "ref"), ["lang"]), ["ter"])


def subword_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU over the pieces of a sentence-piece model, whole segments of every document, per language."""
    import public_tokenizers

    segments = fx.hyp_ref(spark, sf_dir).selectExpr("seg_id", "lang", "hyp", "ref0 AS ref")
    stats = mt.bleu_stats(segments, ["seg_id", "lang"], ["ref"], text.sentence_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    scores = mt.corpus_bleu(stats, ["lang"])
    return rounded(scores, [c for c, t in scores.dtypes if t == "double"])


QUERIES = {
    "mteval_tokens": (mteval_tokens, MTEVAL_SQL),
    "bleu_corpus": (bleu_corpus, BLEU_SQL),
    "bleu_lowercase": (bleu_lowercase, BLEU_LOWER_SQL),
    "chrf_corpus": (chrf_corpus, _chrf_sql(0)),
    "chrf_words_corpus": (chrf_words_corpus, _chrf_sql(2)),
    "edit_rate": (edit_rate, EDIT_SQL),
    "bleu_bootstrap": (bleu_bootstrap, BOOTSTRAP_SQL),
    "subword_bleu": (subword_bleu, None),
    "translation_edit_rate": (translation_edit_rate, None),
    "metric_report": (metric_report, METRIC_REPORT_SQL),
    "metric_report_without_match": (metric_report_without_match, WITHOUT_MATCH_SQL),
    "task_scores": (task_scores, TASK_SCORES_SQL),
    "generator_log": (generator_log, GENERATOR_SQL),
    "translation_records": (translation_records, TRANSLATION_SQL),
    "task_projection": (task_projection, TASK_PROJECTION_SQL),
    "segment_scores": (segment_scores, SEGMENT_SQL),
    "report_metrics": (report_metrics, REPORT_SQL),
    "harvest_table": (harvest_table, HARVEST_SQL),
    "proxy_wide": (proxy_wide, PROXY_SQL),
}
