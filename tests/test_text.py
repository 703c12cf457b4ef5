"""Text functions against hand-computed values."""

import unicodedata

from pyspark.sql import functions as F

from glossmark.functions import keys, text
from glossmark.operators.corpus import filter_pairs, first_pairs
from glossmark.sources.text import hypotheses, number_lines, parse_translations, zip_lines


def test_length_filter_counts_newline_and_empty_pieces(spark):
    long_ok, long_bad = " ".join(["a"] * 1023), " ".join(["a"] * 1024)
    spaced = "a" + " " * 1023  # 1024 pieces, most of them empty
    rows = [(0, "a", "bb"), (1, "", "bb"), (2, "aa", "bb"), (3, long_ok, "bb"), (4, long_bad, "bb"), (5, "bb", spaced)]
    df = spark.createDataFrame(rows, "id int, source_text string, target_text string")
    kept = lambda newline: sorted(r.id for r in filter_pairs(df, newline).collect())
    assert kept(False) == [2, 3]
    assert kept(True) == [0, 2, 3]


def test_prefix_sizes(spark):
    df = spark.range(20000).selectExpr("id AS line_no", "if(id % 3 = 0, 'a', 'b') AS corpus")
    for size in (0, 10, 6667, 50000):
        got = {r.corpus: r["count"] for r in first_pairs(df, ["corpus"], size).groupBy("corpus").count().collect()}
        total = {"a": 6667, "b": 13333}
        assert got == {c: n if size == 0 else min(n, size) for c, n in total.items()}
    smallest = first_pairs(df, ["corpus"], 10).filter("corpus = 'b'").agg(F.max("line_no")).first()[0]
    assert smallest == 14


def test_normalise_matches_definition(spark):
    samples = ["Élan, ÇA va?", "İstanbul ß ½ ²", "नमस्ते दुनिया", "한국어 텍스트", "a\tb c", "x—y_z", "", "１２ Ⅷ"]
    df = spark.createDataFrame([(s,) for s in samples], "text string")

    def direct(s):
        s = unicodedata.normalize("NFD", s.lower())
        return "".join(c for c in s if c.isspace() or (unicodedata.category(c) != "Mn" and c.isalnum()))

    rows = df.select("text", text.normalise("text").alias("n")).collect()
    assert {r.text: r.n for r in rows} == {s: direct(s) for s in samples}
    chars = {r["id"]: r.tokens for r in text.tokenise(df.selectExpr("text AS id", "text")).collect()}
    assert chars == {s: list("".join(direct(s).split())) for s in samples}
    words = {r["id"]: r.tokens for r in text.tokenise(df.selectExpr("text AS id", "text"), "word").collect()}
    assert words == {s: direct(s).split() for s in samples}


def test_pluggable_tokeniser(spark):
    df = spark.createDataFrame([("A-b c",)], "text string")
    assert text.tokenise(df, lambda t: F.split(t, "c")).first().tokens == ["ab ", ""]


def test_mteval_tokens(spark):
    cases = {
        "Hello, world.": ["Hello", ",", "world", "."],
        "1,000.5 and 3-4": ["1,000.5", "and", "3", "-", "4"],
        "&quot;a&quot; &amp; b<skipped>": ['"', "a", '"', "&", "b"],
        "$5 (x/y) it's": ["$", "5", "(", "x", "/", "y", ")", "it's"],
        "": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.w for r in df.select("t", text.mteval_tokens(F.col("t")).alias("w")).collect()}
    assert got == cases


def test_key_rules(spark):
    df = spark.createDataFrame(
        [("eng", "ind", "cc_aligned", 7), ("ind", "eng", "MT560_x", 30000), ("a", "b", "bible", 9)],
        "s string, t string, c string, n long",
    )
    rows = df.select(
        keys.other_lang(F.col("s"), F.col("t")).alias("o"), keys.dev_corpus(F.col("c")).alias("d"),
        keys.subword_vocab_size(F.col("n")).alias("v"), keys.cell_key(F.col("s"), F.col("n"), F.col("t")).alias("k"),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("ind", "flores", 3, "eng_7_ind"), ("ind", "flores", 10000, "ind_30000_eng"), ("a", "bible", 4, "a_9_b"),
    ]


def test_line_numbers_follow_blocks(spark):
    rows = [("f", 100, 7, "c"), ("f", 0, 90, "a"), ("f", 0, 91, "b"), ("g", 0, 1, "x")]
    raw = spark.createDataFrame(rows, "path string, block long, seq long, text string")
    assert {(r.path, r.line_no, r.text) for r in number_lines(raw).collect()} == {
        ("f", 0, "a"), ("f", 1, "b"), ("f", 2, "c"), ("g", 0, "x"),
    }


def test_zip_is_cut_to_the_shorter(spark):
    side = lambda n: spark.range(n).selectExpr("id AS line_no", "string(id) AS text")
    assert zip_lines(side(5), side(3)).count() == 3


def test_generator_log_and_records(spark):
    log = ["S-1\tx", "H-10\t-0.3\tten\ttabs", "H-2\t-0.1\ttwo", "D-2\t-0.1\tno", "T-2\tref"]
    df = spark.createDataFrame([(t,) for t in log], "text string")
    assert [(r.seg_id, r.hyp) for r in hypotheses(df).orderBy("seg_id").collect()] == [(2, "two"), (10, "ten\ttabs")]
    record = spark.createDataFrame([('{"translation": {"ind": "satu", "eng": "one"}}',)], "text string")
    assert tuple(parse_translations(record, "ind").first()) == ("satu", "one")


def test_batches_become_strings_a_piece_at_a_time(monkeypatch):
    """Strings and counts of a whole batch are never held at once; pieces give what the batch gives, nulls too."""
    import pyarrow as pa

    from glossmark.functions import text as tx

    monkeypatch.setattr(tx, "PIECE_BYTES", 40)
    texts = pa.array([None, "", "Éa b" * 9, None] + [f"w{i} w w" for i in range(60)])
    pieces = list(tx._pieces(texts))
    assert [t for p in pieces for t in p] == texts.to_pylist()
    assert max(sum(len(t or "") for t in p) for p in pieces if len(p) > 1) <= 40 and len(pieces) > 5
    assert tx._mapped(tx._clean, texts).to_pylist() == [None if t is None else tx._clean(t) for t in texts.to_pylist()]
    bags = tx._bagged((None if t is None else t.split() for t in p) for p in tx._pieces(texts)).to_pylist()
    assert bags[0] is None and bags[1] == [] and bags[5] == [{"token": "w1", "n": 1}, {"token": "w", "n": 2}]
    assert tx._mapped(tx._clean, pa.array([], pa.string())).to_pylist() == []
