"""Text predicates, normalisation and tokenisation."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PIECES = 1023
MIN_CHARS = 2
# Text, and rows of tokens, of a batch that are objects at a time.
PIECE_BYTES = 1 << 20
PIECE_ROWS = 512

# Everything Python's str.strip() removes, for the JVM regex engine.
_BLANK = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def keep_pair(source: Column, target: Column, count_newline: bool = False) -> Column:
    """Length filter of an aligned pair.

    Pieces are cut at every single space, so runs of spaces give empty pieces.
    ``count_newline`` adds the line end to the length, as for raw text lines.
    """
    extra = 1 if count_newline else 0

    def fits(text: Column) -> Column:
        return (F.length(text) + extra >= MIN_CHARS) & (
            F.size(F.split(text, " ", -1)) <= MAX_PIECES
        )

    return fits(source) & fits(target)


class _KeepTable(dict):
    """Code point -> itself or None, filled on first use."""

    def __missing__(self, code):
        char = chr(code)
        wanted = char.isspace() or (char.isalnum() and unicodedata.category(char) != "Mn")
        self[code] = code if wanted else None
        return self[code]


_keep_table = _KeepTable()


def _clean(text: str) -> str:
    return unicodedata.normalize("NFD", text.lower()).translate(_keep_table)


def _pieces(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch as strings, ``PIECE_BYTES`` at a time, one text at least; so few are held besides the batch."""
    start, held = 0, 0
    for i, size in enumerate(pc.binary_length(texts).fill_null(0).to_numpy().tolist()):
        if held and held + size > PIECE_BYTES:
            yield texts.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += size
    yield texts.slice(start).to_pylist()


def _mapped(function: Callable[[str], str], texts: pa.Array) -> pa.Array:
    """``function`` of each text; null stays null."""
    return pa.concat_arrays([pa.array([None if t is None else function(t) for t in piece], pa.string()) for piece in _pieces(texts)])


@F.arrow_udf(T.StringType())
def normalise(texts: pa.Array) -> pa.Array:
    """Lower case, decompose, then keep letters, numbers and white space."""
    return _mapped(_clean, texts)


@F.arrow_udf(T.StringType())
def _packed(texts: pa.Array) -> pa.Array:
    return _mapped(lambda t: "".join(_clean(t).split()), texts)


@F.arrow_udf(T.StringType())
def _spaced(texts: pa.Array) -> pa.Array:
    return _mapped(lambda t: " ".join(_clean(t).split()), texts)


def _cut(text: Column, separator: str) -> Column:
    """Split; blank text has no tokens."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, separator, -1))


def tokenise(lines: DataFrame, tokeniser: str | Callable[[Column], Column] = "char") -> DataFrame:
    """Replace ``text`` by ``tokens`` of its normalised form.

    ``char``: one token per non-blank character; ``word``: pieces between white space;
    or any function from the normalised text to an array of tokens.
    """
    keys = [c for c in lines.columns if c != "text"]
    clean = {"char": _packed, "word": _spaced}.get(tokeniser, normalise)
    cut = {"char": lambda t: _cut(t, ""), "word": lambda t: _cut(t, " ")}.get(tokeniser, tokeniser)
    return lines.select(*keys, clean("text").alias("text")).select(*keys, cut(F.col("text")).alias("tokens"))


_BAG = "array<struct<token:string,n:int>>"


def _bagged(pieces: Iterator[Iterable]) -> pa.Array:
    """Token counts per row, from rows a piece at a time; null stays null. Counts leave as flat arrays, not as objects."""
    parts = []
    for rows in pieces:
        tokens, numbers, ends, empty = [], [], [0], []
        for r in rows:
            empty.append(r is None)
            if r is not None:
                counted = Counter(r)
                tokens += counted
                numbers += counted.values()
            ends.append(len(tokens))
        held = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(numbers, pa.int32())], ["token", "n"])
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held, mask=pa.array(empty, pa.bool_())))
    return pa.concat_arrays(parts)


def bags(lines: DataFrame, tokeniser: str | Callable[[Column], Column] = "char") -> DataFrame:
    """Replace ``text`` by ``bag``: each token of the line once, with its count.

    The tokenisers of this module clean, cut and count a line in one pass, so a line's tokens
    never exist as rows or arrays outside the batch.
    """
    keys = [c for c in lines.columns if c != "text"]

    @F.arrow_udf(_BAG)
    def chars(texts: pa.Array) -> pa.Array:
        return _bagged((None if t is None else "".join(_clean(t).split()) for t in piece) for piece in _pieces(texts))

    @F.arrow_udf(_BAG)
    def words(texts: pa.Array) -> pa.Array:
        return _bagged((None if t is None else _clean(t).split() for t in piece) for piece in _pieces(texts))

    own = {"char": chars, "word": words}
    if tokeniser in own:
        return lines.select(*keys, own[tokeniser]("text").alias("bag"))
    return bagged(tokenise(lines, tokeniser))


def bagged(tokenised: DataFrame) -> DataFrame:
    """Replace ``tokens`` by ``bag``; a table that has bags is left alone."""
    if "bag" in tokenised.columns:
        return tokenised

    @F.arrow_udf(_BAG)
    def counted(tokens: pa.Array) -> pa.Array:
        return _bagged(tokens.slice(a, PIECE_ROWS).to_pylist() for a in range(0, max(len(tokens), 1), PIECE_ROWS))

    keys = [c for c in tokenised.columns if c != "tokens"]
    return tokenised.select(*keys, counted("tokens").alias("bag"))


# Fixed values of the mteval-13a scheme: clean-up rewrites, then punctuation rules.
MTEVAL_CLEANUP = [
    (r"<skipped>", ""),
    (r"-\n", ""),
    (r"\n", " "),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
]
MTEVAL_RULES = [
    (r"([\{-~\[-` -&\(-\+:-@/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]


def sentence_pieces(path: str) -> Callable[[Column], Column]:
    """A tokeniser into the pieces of a sentence-piece model, as its library gives them; null counts as empty.

    ``path`` is within reach of all executors.
    """

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            yield pa.array(model.encode([t or "" for t in batch.to_pylist()], out_type=str, num_threads=1), pa.list_(pa.string()))

    return lambda text: cut(text)


def mteval_text(text: Column) -> Column:
    """A text rewritten by the mteval-13a scheme; its tokens stand between white space."""
    for literal, replacement in MTEVAL_CLEANUP:
        text = F.replace(text, F.lit(literal.replace(r"\n", "\n")), F.lit(replacement))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, replacement in MTEVAL_RULES:
        # a blank stays one: blanks around it change no token and no match of a later rule
        text = F.regexp_replace(text, pattern.replace(" -&", "!-&"), replacement)
    return text


def mteval_texts(texts: pa.Array) -> pa.Array:
    """``mteval_text`` of the texts of a batch."""
    for literal, replacement in MTEVAL_CLEANUP:
        texts = pc.replace_substring(texts, literal.replace(r"\n", "\n"), replacement)
    texts = pc.binary_join_element_wise(" ", texts, " ", "")
    for pattern, replacement in MTEVAL_RULES:
        texts = pc.replace_substring_regex(texts, pattern.replace(" -&", "!-&"), replacement.replace("$", "\\"))
    return texts


def mteval_tokens(text: Column) -> Column:
    """Tokens of the mteval-13a scheme."""
    return plain_tokens(mteval_text(text))


def plain_tokens(text: Column) -> Column:
    """No tokenisation beyond white space."""
    return F.array_remove(F.split(text, r"\s+"), "")


# ASCII punctuation, a fixed value of the word n-gram part of chrF++.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def edge_split_words(text: Column) -> Column:
    """Words with one trailing, else one leading, punctuation mark cut off."""

    def cut(word: Column) -> Column:
        last, first = F.substring(word, -1, 1), F.substring(word, 1, 1)
        marks = F.lit(PUNCTUATION)
        return (
            F.when(F.length(word) == 1, F.array(word))
            .when(F.instr(marks, last) > 0, F.array(F.left(word, F.length(word) - 1), last))
            .when(F.instr(marks, first) > 0, F.array(first, F.right(word, F.length(word) - 1)))
            .otherwise(F.array(word))
        )

    return F.flatten(F.transform(plain_tokens(text), cut))
