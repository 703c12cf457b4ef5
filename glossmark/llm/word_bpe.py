"""Ids of words under a byte-level BPE with word ends, in Python workers.

The tokenizer's file says: compose, make white space one blank, lower-case, cut by a pattern, merge bytes where the last
byte of a piece is another symbol than the same byte inside. White space is dropped and nothing is joined across it, so a
text's ids are those of its stretches without white space.

A worker encodes the distinct stretches of a slice of texts and puts the texts together from them. Stretches of plain Latin letters are
merged together by the encoder made for ranks: a sign that they do not have stands for the end of a piece, its merges
come first, and the others follow in the order of the file. That gives the merges of the file as long as every merged token
is what its own bytes merge to (``plain`` checks it). All other stretches go to the library of the file.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from glossmark.llm.alignment import byte_alphabet

#: Signs below this, where composing and lower-casing look at one sign only.
LATIN = 0x250
_END = "\x01"


def _merged(symbols: list[str], order: dict[tuple[str, str], int]) -> list[str]:
    """The listed merges applied to symbols, lowest first."""
    while len(symbols) > 1:
        ranks = [order.get(p, 1 << 62) for p in zip(symbols, symbols[1:])]
        at = min(range(len(ranks)), key=lambda i: (ranks[i], i))
        if ranks[at] == 1 << 62:
            break
        symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
    return symbols


def _symbols(token: str, suffix: str) -> list[str]:
    """The bytes of a token as the file writes them; the last one with the mark of a word's end if the token has it."""
    if token.endswith(suffix):
        body = token[: -len(suffix)]
        return [*body[:-1], body[-1] + suffix]
    return list(token)


class WordBpe:
    """Encoder of whole texts given as UTF-8."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.ranked = None
        cut = self._pattern(spec)
        model = spec["model"]
        suffix, vocabulary = model.get("end_of_word_suffix"), model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", [])]
        if cut and suffix and self.plain(merges, suffix):
            self._rank(vocabulary, merges, suffix)
            self.pieces = regex.compile(cut).findall

    @staticmethod
    def _pattern(spec: dict) -> str | None:
        """The cutting pattern, if the file has the form this encoder stands in for."""
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
            return None
        ends = [t["content"] for t in spec["added_tokens"] if not (t["content"].startswith("<|") and t["content"].endswith("|>"))]
        split, level = cuts
        same = split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"] and not ends
        return split["pattern"].get("Regex") if same else None

    @staticmethod
    def plain(merges: list[tuple[str, str]], suffix: str) -> bool:
        """Whether every merged token is what its bytes merge to. Then a pair of neighbours whose bytes are a token's is always
        the listed pair: where both borders stand, the bytes between them have merged as they do alone."""
        order = {m: i for i, m in reversed(list(enumerate(merges)))}
        return all(_merged(_symbols(a + b, suffix), order) == [a + b] for a, b in merges)

    def _rank(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        import tiktoken

        signs = byte_alphabet()

        def raw(token: str) -> bytes:
            body, end = (token[: -len(suffix)], _END.encode()) if token.endswith(suffix) else (token, b"")
            return bytes(signs[c] for c in body) + end

        bytes_of = {b: c for c, b in signs.items()}
        first = [bytes_of[b] for b in range(256)] + [bytes_of[b] + suffix for b in range(256)]
        ranked = list(dict.fromkeys([*first, *(a + b for a, b in merges)]))
        ranks: dict[bytes, int] = {}
        for i, token in enumerate(ranked):
            ranks.setdefault(raw(token), i)
        self.ids = np.array([vocabulary[t] for t in ranked])
        self.line = ranks[b"\n" + _END.encode()]
        self.ranked = tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})

    def fast(self, text: str) -> bool:
        """Whether the text has visible plain Latin signs only, and nothing that may be a special token."""
        return (text.isascii() or max(text) < chr(LATIN)) and text.isprintable() and "<|" not in text

    def stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of stretches without ASCII white space: all ids, where each stretch's begin, and how many it has."""
        quick = np.ones(len(texts), bool)
        if self.ranked is None:
            quick[:] = False
        elif not self.fast("".join(texts)):
            quick = np.fromiter(map(self.fast, texts), bool, len(texts))
        flat_q, sizes_q = self._together([t for t, q in zip(texts, quick) if q])
        flat_s, sizes_s = self._library([t for t, q in zip(texts, quick) if not q])
        starts, sizes = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        for mine, own, before in ((quick, sizes_q, 0), (~quick, sizes_s, len(flat_q))):
            sizes[mine] = own
            starts[mine] = np.cumsum(own) - own + before
        return np.concatenate([flat_q, flat_s]), starts, sizes

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        return np.array(list(chain.from_iterable(found)), self.kind), np.array(list(map(len, found)), np.int64)

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Every piece gets its end sign; a line end, a piece of its own, stands between texts."""
        if not texts:
            return np.empty(0, self.kind), np.empty(0, np.int64)
        words = "\n".join(texts).lower().split("\n")
        pieces = [w if w.isalpha() else _END.join(self.pieces(w)) for w in words]
        found = np.array(self.ranked.encode_ordinary(f"{_END}\n{_END}".join(pieces) + _END), np.int64)
        lines = found == self.line
        at = np.flatnonzero(lines)
        ends = np.r_[at - np.arange(len(at)), len(found) - len(at)]
        return self.ids[found[~lines]].astype(self.kind), np.diff(np.r_[0, ends])

    def encode(self, texts: pa.Array, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, each followed by ``stop`` if given, and the texts' numbers of ids.

        Distinct stretches of the array are encoded once; the texts are put together by their places.
        """
        lists = pc.ascii_split_whitespace(texts)
        ends = np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()
        words = lists.flatten().dictionary_encode()
        count = len(words.dictionary)
        whole = pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), words.dictionary)
        known = pc.binary_join(whole, "\n")[0].as_py().split("\n") if count else []
        flat, starts, sizes = self.stretches(known)
        index = np.asarray(words.indices)
        if stop is not None:
            flat, starts, sizes = np.append(flat, np.array([stop], self.kind)), np.append(starts, len(flat)), np.append(sizes, 1)
            index = np.insert(index, ends, count)
            ends = ends + np.arange(1, len(ends) + 1)
        each = sizes[index]
        upto = np.r_[0, np.cumsum(each)]
        place = np.repeat(starts[index] - upto[:-1], each)
        place += np.arange(len(place))
        return flat[place], np.diff(upto[np.r_[0, ends]])
