"""Translation edit rate: word edits with block shifts, found by greedy search.

A shift moves a run of hypothesis words that also occurs in the reference to where the reference has it and
counts as one edit. As long as some shift lowers the edit distance, the best one is made: that of the largest
gain, then the longest, then the earliest run and place. A run is a candidate only if it holds a word that is
wrong where it stands and its place in the reference is not yet right.

Runs are looked up in an index of the reference's words; a run has at most ``MOST_WORDS`` words and moves over at most
``MOST_STEPS`` places (fixed values of the published metric, as is ``MOST_TRIED``, which ends the search of a segment).
Distances are computed on bit vectors, one step per word of the hypothesis, so a segment's work stays bounded.

Shifts that cannot win are not measured, which changes no result: moving k words over s others changes the distance by 2k and by
2s at most; no order of the hypothesis's words is closer than its length and the words both sides share allow; and a round that
uses up ``MOST_TRIED`` makes no shift, whatever its shifts would gain.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.functions.keys import ratio
from glossmark.operators.segments import distance, places, steps

# Fixed values of the metric.
MOST_WORDS = 10
MOST_STEPS = 50
MOST_TRIED = 1000

#: Shifts measured at a time.
TOGETHER = 16


class Reference:
    """A reference's words, where each stands, and the same as bits."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            self.places.setdefault(w, []).append(i)
        self.bits = places(words)

    def distance(self, hyp: list[str]) -> int:
        return distance(hyp, self.bits, len(self.words))

    def states(self, hyp: list[str]) -> list[tuple[int, int, int, int, int]]:
        """What is known of the distance before the first word, after it, after the second and so on."""
        return steps(hyp, self.bits, len(self.words))

    def least(self, hyp: list[str]) -> int:
        """The words' distance cannot fall below this in any order."""
        counts = Counter(hyp)
        shared = sum(min(counts[w], len(at)) for w, at in self.places.items())
        return max(len(hyp), len(self.words)) - shared

    def aligned(self, hyp: list[str], states: list[tuple] | None = None) -> tuple[list[int], list[bool], list[bool]]:
        """For each reference word the hypothesis place it meets or follows; and which words of either side are wrong.

        Of equally cheap ways a match or replacement comes first, then a word too many, then a word too few. The way is read
        off the differences between neighbouring distances.
        """
        states = states or self.states(hyp)
        ref, n, m = self.words, len(hyp), len(self.words)
        place, wrong_ref, wrong_hyp = [-1] * m, [True] * m, [True] * n
        i, j = n, m
        while i or j:
            if not j:
                i -= 1
                continue
            if i:
                bit = j - 1
                # the distance of one word less of the hypothesis, then of one less of the reference too
                across = (states[i][3] >> bit & 1) - (states[i][4] >> bit & 1)
                down = (states[i - 1][0] >> bit & 1) - (states[i - 1][1] >> bit & 1)
                wrong = hyp[i - 1] != ref[bit]
                if across + down == wrong:
                    i, j = i - 1, bit
                    place[j] = i
                    wrong_ref[j] = wrong_hyp[i] = wrong
                    continue
                if across == 1:
                    i -= 1
                    continue
            j -= 1
            place[j] = i - 1
        return place, wrong_ref, wrong_hyp

    def distances(self, orders: list[list[str]], start: int, stop: int, states: list[tuple]) -> list[int]:
        """The distances of several orders of the words of ``states``, all as there before ``start`` and alike from ``stop`` on.

        All are worked out at once, side by side in the bits of one number; a lane has room for a carry and for the counts.
        """
        n, size = len(self.words), len(orders[0])
        width = max(n + 1, size.bit_length() + 1)
        ones = sum(1 << width * k for k in range(len(orders)))
        mask, last = ones * ((1 << n) - 1), n - 1
        plus, minus, base = ones * states[start][0], ones * states[start][1], states[start][2]
        get, more, less, backwards = self.bits.get, 0, 0, orders[::-1]
        for at in range(start, size):
            if at < stop:
                same = 0
                for words in backwards:
                    same = same << width | get(words[at], 0)
            else:
                same = ones * get(orders[0][at], 0)
            either = same | minus
            across = (((same & plus) + plus) ^ plus) | either
            up, down = minus | (~(across | plus) & mask), plus & across
            more += up >> last & ones
            less += down >> last & ones
            up = up << 1 | ones
            plus, minus = (down << 1 | ~(either | up)) & mask, up & either & mask
        lane = (1 << width) - 1
        return [base + (more >> k & lane) - (less >> k & lane) for k in range(0, width * len(orders), width)]


def target(start: int, length: int, to: int) -> int:
    """Where a run from ``start`` begins once it is put before the word that stands at ``to``."""
    return to if to <= start else max(start, to - length)


def moved(words: list[str], start: int, length: int, to: int) -> list[str]:
    """The run from ``start`` put before the word that stands at ``to``."""
    run, rest = words[start : start + length], words[:start] + words[start + length :]
    at = target(start, length, to)
    return rest[:at] + run + rest[at:]


def shifts(hyp: list[str], ref: Reference, states: list[tuple], tried: int) -> tuple[set[tuple[int, int, int]], int]:
    """(length, start, place moved to) of the shifts to try, and how many were tried then."""
    place, wrong_ref, wrong_hyp = ref.aligned(hyp, states)
    found: set[tuple[int, int, int]] = set()
    words, n, m, spots = ref.words, len(hyp), len(ref.words), [0, *[p + 1 for p in place]]
    to_wrong_hyp, to_wrong_ref = _to_next(wrong_hyp), _to_next(wrong_ref)
    for i, word in enumerate(hyp):
        if to_wrong_hyp[i] >= MOST_WORDS:
            continue
        for j in ref.places.get(word, ()):
            # a run holds a wrong word on either side
            least = max(to_wrong_hyp[i], to_wrong_ref[j]) + 1
            most = min(MOST_WORDS, n - i, m - j)
            if least > most or abs(i - j) > MOST_STEPS or hyp[i : i + least] != words[j : j + least]:
                continue
            for length in range(least, most + 1):
                if hyp[i + length - 1] != words[j + length - 1] or i <= place[j] < i + length:
                    break
                last = -1
                for to in spots[j : j + length + 1]:
                    if to == last:
                        continue
                    last = to
                    found.add((length, i, to))
                    tried += 1
                if tried >= MOST_TRIED:
                    return found, tried
    return found, tried


def _to_next(wrong: list[bool]) -> list[int]:
    """How far it is from every place to the next wrong one."""
    out, far = [0] * len(wrong), MOST_WORDS
    for at in range(len(wrong) - 1, -1, -1):
        far = 0 if wrong[at] else far + 1
        out[at] = far
    return out


def best_shift(hyp: list[str], ref: Reference, tried: int) -> tuple[int, list[str], int]:
    """What the best shift takes off the distance, the words after it, and the shifts tried so far.

    No shift is made where none can take anything off, or where ``MOST_TRIED`` is used up.
    """
    states = ref.states(hyp)
    before = states[-1][2]
    most = before - ref.least(hyp)
    if most <= 0:
        return 0, hyp, tried
    found, tried = shifts(hyp, ref, states, tried)
    if tried >= MOST_TRIED:
        return 0, hyp, tried
    best, words = (0, 0, 0, 0), hyp
    waiting = sorted(found, key=lambda s: (-s[0], s[1], s[2]))
    known: dict[tuple[int, int, int], int] = {}
    for first in range(0, len(waiting), TOGETHER):
        batch = []
        for length, i, to in waiting[first : first + TOGETHER]:
            at = target(i, length, to)
            # ties go to the longer run, then the earlier one
            if (min(2 * length, 2 * abs(at - i), most), length, -i, -to) > best:
                # two neighbouring runs change places, whichever of them is said to move
                batch.append(((length, i, to), (i, i + length, at + length) if at > i else (at, i, i + length)))
        fresh = list(dict.fromkeys(swap for _, swap in batch if swap not in known))
        if fresh:
            orders = [hyp[:a] + hyp[b:c] + hyp[a:b] + hyp[c:] for a, b, c in fresh]
            known.update(zip(fresh, ref.distances(orders, min(a for a, _, _ in fresh), max(c for _, _, c in fresh), states)))
        for (length, i, to), swap in batch:
            score = (before - known[swap], length, -i, -to)
            if score[0] > 0 and score > best:
                best, words = score, moved(hyp, i, length, to)
    return best[0], words, tried


def edits(hyp: list[str], ref_words: list[str]) -> int:
    """Shifts and word edits that turn the hypothesis into the reference."""
    if not ref_words:
        return int(bool(hyp))
    ref, made, tried = Reference(ref_words), 0, 0
    while True:
        gain, words, tried = best_shift(hyp, ref, tried)
        if gain <= 0 or tried >= MOST_TRIED:
            break
        hyp, made = words, made + 1
    return made + distance(hyp, ref.bits, len(ref_words))


def _counted(hyp: Column, ref: Column) -> Column:
    @F.arrow_udf("bigint")
    def count(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        return pa.array([edits(h.lower().split(), r.lower().split()) for h, r in zip(hyp.to_pylist(), ref.to_pylist())], pa.int64())

    return count(hyp, ref)


def ter_counts(hyp: Column, ref: Column) -> Column:
    """Struct ``edits`` (shifts among them) and ``ref_words``; words are lower-cased and cut at white space, null is empty."""
    hyp, ref = (F.coalesce(c, F.lit("")) for c in (hyp, ref))
    # the words of Python's split, as the metric counts them
    words = F.regexp_count(ref, F.lit(r"(?U)[^\s\x1c-\x1f]+")).cast("long")
    return F.struct(_counted(hyp, ref).alias("edits"), words.alias("ref_words"))


def ter_stats(segments: DataFrame, keys: list[str], ref: str) -> DataFrame:
    """``edits`` (shifts among them) and ``ref_words`` of each segment."""
    return segments.select(*keys, ter_counts(F.col("hyp"), F.col(ref)).alias("_s")).select(*keys, "_s.edits", "_s.ref_words")


def ter_score() -> Column:
    """Edits in percent of the reference's words; 0 without any edit, 100 if there are edits but no reference words."""
    empty = F.when(F.col("edits") > 0, 100.0).otherwise(0.0)
    return F.when(F.col("ref_words") > 0, 100 * ratio(F.col("edits"), F.col("ref_words"))).otherwise(empty)


def corpus_ter(stats: DataFrame, group: list[str]) -> DataFrame:
    sums = stats.groupBy(*group).agg(F.sum("edits").alias("edits"), F.sum("ref_words").alias("ref_words"))
    return sums.select(*group, "edits", "ref_words", ter_score().alias("ter"))
