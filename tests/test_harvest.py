"""Report parsing and the file jobs."""

import json

import pytest
from pyspark.sql import functions as F

from glossmark.operators import harvest as hv
from glossmark.plans import jobs
from glossmark.sources import reports, tables
from glossmark.sources import text as sources
from glossmark.sources.text import read_lines, read_parallel

REPORT = """sacreBLEU says hello
[
{"name": "BLEU", "tok": "flores200", "confidence_mean": 20.5, "confidence_var": 0.5},
{"name": "chrF2++", "confidence_mean": 40.0}
]
more text
[
{"name": "BLEU", "tok": "none", "confidence_mean": 15.0, "confidence_var": 0.25},
{"name": "chrF2"},
{"name": "TER", "confidence_mean": 70.0, "confidence_var": 1.0}
]
"""


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")


def test_parse_reports(spark):
    df = spark.createDataFrame([("x", REPORT)], "folder string, content string")
    got = {r.metric: (r["mean"], r.se) for r in reports.parse_reports(df).collect()}
    assert got == {"spBLEU": (20.5, 0.5), "chrF2++": (40.0, 0.0), "BLEU": (15.0, 0.25), "chrF2": (0.0, 0.0), "TER": (70.0, 1.0)}


def test_segment_scores(spark):
    lines = ['"COMET": 0.85', '"COMET": -0.12', '"COMET": 1', '"COMET": 0.5, "COMET": 0.9', "x"]
    df = spark.createDataFrame([(t,) for t in lines], "text string")
    scores = reports.parse_segment_scores(df)
    assert sorted(r.score for r in scores.collect()) == [0.5, 0.85]
    row = hv.segment_summary(scores, []).first()
    assert (row.comet_score_mean, row.comet_score_se) == (0.675, 0.175)


@pytest.mark.parametrize(
    "folder, first, want",
    [
        ("m2m100_ind_eng_bible_1000", 1, ("ind", "eng", "bible", "1000")),
        ("m2m100_ind_eng_MT560_news_x_1000", 1, ("ind", "eng", "MT560_news_x", "1000")),
        ("m2m100_ind_eng_no_finetune", 1, ("ind", "eng", "no", "finetune")),
        ("ind_eng_bible_1000", 0, ("ind", "eng", "bible", "1000")),
    ],
)
def test_folder_key(spark, folder, first, want):
    key = reports.folder_key(F.lit(folder), first)
    assert tuple(spark.range(1).select(*[c.alias(n) for n, c in key.items()]).first()) == want


def test_harvest_folder(spark, tmp_path):
    full, unmarked = tmp_path / "m_ind_eng_bible_10", tmp_path / "m_ind_eng_bible_20"
    for folder in (full, unmarked):
        write(folder / "outputs" / "sacrebleu_flores.txt", REPORT)
        write(folder / "outputs" / "comet_flores.json", '"COMET": 0.25\n"COMET": 0.75\n')
    write(full / f"{full.name}.json", "{}")
    write(full / "outputs" / "sacrebleu_ntrex.txt", REPORT)  # no segment scores
    rows = jobs.harvest_folder(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.source_lang, row.dataset_size, row.test_dataset) == ("ind", "10", "flores")
    assert (row.spBLEU_mean, row.TER_se, row.comet_score_mean, row.comet_score_se) == (20.5, 1.0, 0.5, 0.25)


def test_proxy_wide_joins_untuned_without_corpus(spark):
    rows = [
        ("a", "b", "c1", "t", "m", True, "spBLEU", 1.0, 0.1),
        ("a", "b", "c2", "t", "m", True, "spBLEU", 2.0, 0.1),
        ("a", "b", None, "t", "m", False, "spBLEU", 9.0, 0.3),
        ("a", "b", "c1", "t", "trfm", True, "spBLEU", 5.0, 0.2),
    ]
    keys = ["source_lang", "target_lang", "train_dataset", "test_dataset"]
    long = spark.createDataFrame(
        rows, ", ".join(f"{k} string" for k in keys) + ", model string, tuned boolean, metric string, mean double, se double"
    )
    columns = [("m_ft", "spBLEU"), ("trfm", "spBLEU"), ("m_noft", "spBLEU")]
    wide = hv.proxy_wide(long, keys, ["source_lang", "target_lang", "test_dataset"], columns)
    got = {r.train_dataset: (r.m_ft_spBLEU_mean, r.trfm_spBLEU_mean, r.m_noft_spBLEU_se) for r in wide.collect()}
    assert got == {"c1": (1.0, 5.0, 0.3), "c2": (2.0, None, 0.3)}


def test_lines_keep_file_order_over_blocks(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    write(tmp_path / "a.txt", "\n".join(lines) + "\n")
    write(tmp_path / "b.txt", "one\ntwo\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by_file = {name: [r.text for r in sorted(got, key=lambda r: r.line_no) if r.path.endswith(name)] for name in ("a.txt", "b.txt")}
    assert by_file == {"a.txt": lines, "b.txt": ["one", "two"]}
    assert read_parallel(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")).count() == 2


def test_prepare_corpus(spark, tmp_path):
    write(tmp_path / "s.txt", "aa\n\nbb\ncc\n")
    write(tmp_path / "t.txt", "1\n2\n3\n4\n5\n")
    corpus = {"lang": "ind", "split": "train", "corpus": "bible"}
    args = (str(tmp_path / "out"), corpus, str(tmp_path / "s.txt"), str(tmp_path / "t.txt"))
    rows = jobs.prepare_corpus(spark, *args, size=2).orderBy("line_no").collect()
    assert [(r.source_text, r.target_text) for r in rows] == [("aa", "1"), ("bb", "3")]
    assert jobs.prepare_corpus(spark, *args, size=1).count() == 2  # an existing output is kept
    other = {"lang": "ind", "split": "train", "corpus": "news/2020"}
    assert jobs.prepare_corpus(spark, args[0], other, *args[2:]).count() == 3  # a second corpus of the same output
    assert jobs.prepare_corpus(spark, *args).count() == 2
    whole = spark.read.parquet(args[0])
    assert {(r.corpus, r["count"]) for r in whole.groupBy("corpus").count().collect()} == {("bible", 2), ("news/2020", 3)}
    record = {"translation": {"ind": "satu", "eng": "one"}}
    write(tmp_path / "r.json", "\n".join([json.dumps(record), json.dumps({"translation": {"ind": "x", "eng": "long"}})]) + "\n")
    test = jobs.prepare_corpus(spark, str(tmp_path / "out2"), {**corpus, "split": "test"}, str(tmp_path / "r.json"), source_lang="ind")
    assert [(r.source_text, r.target_text) for r in test.collect()] == [("satu", "one")]


def test_featurise_files(spark, tmp_path):
    base = tmp_path / "dataset" / "ind"
    write(base / "train" / "cc_aligned" / "train_eng_10.txt", "abc\nbcd\n")
    write(base / "dev" / "flores" / "dev_eng.txt", "ab\n")
    write(base / "test" / "ntrex" / "test_eng.txt", "cd x\n")
    rows = spark.createDataFrame(
        [("ind", "eng", "cc_aligned", 10, "ntrex"), ("eng", "eng", "none", 1, "none")],
        "source_lang string, target_lang string, train_dataset string, dataset_size long, test_dataset string",
    )
    got = {r.train_dataset: r for r in jobs.featurise(rows, jobs.read_corpora(spark, str(tmp_path / "dataset"))).collect()}
    row = got["cc_aligned"]
    assert (row.train_word_vocab_size, row.dev_word_vocab_size, row.test_word_vocab_size) == (4, 2, 3)
    assert row.train_dev_word_overlap == 2 / 6 and row.avg_train_sentence_length == 3.0
    assert 0 < row.train_test_tf_idf < 1 and got["none"].dev_size is None


def test_metric_job(spark, tmp_path):
    log = "S-0\tx\nH-1\t-0.1\tthe dog ran far away\nH-0\t-0.2\tthe cat sat on the mat\n"
    write(tmp_path / "m_ind_eng_bible_10" / "outputs" / "output_flores.txt", log)
    refs = spark.createDataFrame(
        [("flores", 0, "the cat sat on the mat"), ("flores", 1, "the dog ran far away")],
        "test_dataset string, line_no long, ref string",
    )
    out = jobs.score_hypotheses(jobs.read_hypotheses(spark, str(tmp_path)), refs, resamples=40)
    got = {r.metric: r["mean"] for r in out.collect()}
    assert got["BLEU"] == pytest.approx(100) and got["chrF2++"] == pytest.approx(100) and got["edit_rate"] == 0


def test_tables(spark, tmp_path):
    write(tmp_path / "e.csv", "source_lang,target_lang,dataset_size,genetic\na,b,10,0.5\nc,d,,0.1\n")
    table = tables.read_experiments(spark, str(tmp_path / "e.csv"), ["source_lang", "target_lang", "dataset_size", "genetic"])
    assert [tuple(r) for r in table.collect()] == [("a", "b", 10, 0.5)]
    tables.write_csv(table, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.csv"))) == 1
    mapping = spark.createDataFrame(
        [(0, "ace", "ace_Arab"), (1, "ace", "ace_Latn"), (2, None, "x"), (3, "afr", None)], "n int, code string, long string"
    )
    codes = {r.code: r.long for r in tables.first_code(mapping, "code", "long", "n").collect()}
    assert codes == {"ace": "ace_Arab", "afr": None}
    rows = spark.createDataFrame([("q", "r", "test"), ("x", "y", "train")], "utt string, annot_utt string, split string")
    assert [tuple(r) for r in tables.task_rows(rows, "slot", "test").collect()] == [("q", "r")]


def test_text_sets_keep_their_line_order(spark, tmp_path):
    """Many corpora in one job; a large one is several files, whose lines are numbered through, also over blocks of files."""
    rows = [("en", "dev", i, f"line {i} é" if i % 3 else "") for i in range(4000)] + [("d/e", "dev", i, f"x{i}") for i in range(7)] + [("d/e", "test", 0, " y ")]
    lines = spark.createDataFrame(rows, "lang string, split string, line_no long, text string").repartition(5)
    sources.write_sets(lines, str(tmp_path / "sets"), ["lang", "split"])
    assert len(list((tmp_path / "sets" / "lang=en" / "split=dev").glob("part-*"))) > 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted(tuple(r) for r in sources.read_sets(spark, str(tmp_path / "sets"), ["lang", "split"]).collect()) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_prepare_corpora_together(spark, tmp_path):
    def side(corpora):
        rows = [(lang, "train", corpus, i, t) for (lang, corpus), texts in corpora.items() for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "lang string, split string, corpus string, line_no long, text string")

    source = {("ind", "bible"): ["aa", "", "bb", "cc"], ("jav", "news/2020"): ["a b", "c"]}
    target = {("ind", "bible"): list("12345"), ("jav", "news/2020"): ["x", "y", "z"]}
    out = str(tmp_path / "out")
    got = jobs.prepare_corpora(side(source), side(target), out, size=2)
    want = {("ind", 0, "aa", "1"), ("ind", 2, "bb", "3"), ("jav", 0, "a b", "x"), ("jav", 1, "c", "y")}
    assert {(r.lang, r.line_no, r.source_text, r.target_text) for r in got.collect()} == want
    more = {("ind", "bible"): ["other"] * 9, ("sun", "cc"): ["ok"]}
    again = jobs.prepare_corpora(side(more), side(more), out)  # what is there stays, the new corpus comes in
    assert {(r.lang, r.line_no, r.source_text, r.target_text) for r in again.collect()} == want | {("sun", 0, "ok", "ok")}
