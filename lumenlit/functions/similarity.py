"""Sequence similarity of short texts, and the texts or pairs that reach a threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlit.functions.calendar import strict_date
from lumenlit.functions.text import collapsed

UNKNOWN = -(10**9)  # the day of an unknown date
SLACK = 1e-6  # what rounding may take from a bound
SHAPE = "k long, t string, day int"
BLOCK, FIRST_WORDS = 32, 10  # texts whose letters are compared at once, and the words of their signatures that are looked at first
GROUP = 512  # rows of a greedy pass whose likely copies are found together
SLICE_ROWS, SLICE_CHARACTERS = 16_000, 8_000_000  # of the texts that a task holds at once

_COMMON = " etaoinsrl"
_LETTERS = "hdcumfpgwybvkxjqz0123456789.,-" + _COMMON
_OTHERS = 16
_MOST = [(24 if c in "hdcumfpg" else 64 if c in _COMMON else 8) for c in _LETTERS] + [8] * _OTHERS
_COLUMN = np.repeat(np.arange(len(_MOST)), _MOST)
_LEVEL = np.concatenate([np.arange(m) for m in _MOST])
WORDS = -(-len(_COLUMN) // 64)
_PLACE = np.full(128, -1)
_PLACE[[ord(c) for c in _LETTERS]] = range(len(_LETTERS))


def signatures(texts: list[str]) -> np.ndarray:
    """Bits (words x texts): for each letter and number whether the text has more than that many of it, so differing bits are never more than letters to insert or delete."""
    out = np.zeros((WORDS, len(texts)), np.uint64)
    for begin in range(0, len(texts), 2048):
        some = texts[begin : begin + 2048]
        codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        place = np.where(codes < 128, _PLACE[np.minimum(codes, 127)], -1)
        place = np.where(place < 0, len(_LETTERS) + codes % _OTHERS, place)
        owner = np.repeat(np.arange(len(some)), [len(t) for t in some])
        counts = np.bincount(owner * len(_MOST) + place, minlength=len(some) * len(_MOST)).reshape(len(some), -1)
        bits = np.zeros((len(some), WORDS * 64), bool)
        bits[:, : len(_COLUMN)] = counts[:, _COLUMN] > _LEVEL
        out[:, begin : begin + len(some)] = np.packbits(bits, axis=1).view(np.uint64).T
    return out


class Likeness:
    """Texts among which those are found that a new text resembles: exactly the ones whose ratio reaches the threshold.

    Twice the common characters over all characters is at least the threshold only
    if few characters are to be inserted or deleted.  Lengths, then counts of
    letters, then the longest common subsequence bound their number from below;
    what passes all three is compared.  No bound loses a pair.
    """

    def __init__(self, texts: list[str], threshold: float, days: list[int] | None = None, most_days: int | None = None):
        self.order = np.argsort([len(t) for t in texts], kind="stable")
        self.texts = [texts[i] for i in self.order]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.bits = signatures(self.texts)
        self.by_text = np.ascontiguousarray(self.bits.T)
        self.threshold, self.most_days = threshold, most_days
        self.days = None if most_days is None else np.array(days, np.int64)[self.order]

    def likely(self, sizes: np.ndarray, bits: np.ndarray, days: np.ndarray, among: np.ndarray | None = None) -> list[np.ndarray]:
        """For each new text (its size, signature and day) the places of those that dates, lengths and letters admit, the likest letters first; ``among`` may exclude some."""
        t, order = self.threshold, np.argsort(sizes, kind="stable")
        found = [np.zeros(0, np.int64)] * len(sizes)
        for begin in range(0, len(sizes), BLOCK):
            rows = order[begin : begin + BLOCK]
            small, large = int(sizes[rows[0]]), int(sizes[rows[-1]])
            low = np.searchsorted(self.lengths, math.ceil(small * t / (2 - t) - SLACK))
            high = np.searchsorted(self.lengths, math.floor(large * (2 - t) / t + SLACK), "right")
            places = np.arange(low, high) if among is None else low + np.flatnonzero(among[low:high])
            most = np.minimum((1 - t) * (large + self.lengths[places]) + SLACK, 255).astype(np.uint8)
            apart = np.zeros((len(rows), len(places)), np.uint8)
            for word in range(FIRST_WORDS):  # what exceeds a byte starts again at 0 and is admitted
                apart += np.bitwise_count(self.bits[word, places] ^ bits[rows, word, None])
            new, at = np.nonzero(apart <= most)
            new, at = rows[new], places[at]
            apart = np.bitwise_count(self.by_text[at] ^ bits[new]).sum(axis=1, dtype=np.int64)
            passed = apart <= (1 - t) * (sizes[new] + self.lengths[at]) + SLACK
            if self.days is not None:
                passed &= (days[new] == UNKNOWN) | (self.days[at] == UNKNOWN) | (np.abs(self.days[at] - days[new]) <= self.most_days)
            new, at, apart = new[passed], at[passed], apart[passed]
            sorted_ = np.lexsort((apart, new))
            new, at = new[sorted_], at[sorted_]
            for row, begin_, end in zip(rows, np.searchsorted(new, rows), np.searchsorted(new, rows, "right")):
                found[row] = at[begin_:end]
        return found

    def confirmed(self, text: str, places: np.ndarray) -> Iterator[tuple[int, float]]:
        """(number, ratio) of the texts in these places that the new text is like."""
        if not len(places):
            return
        size, t = len(text), self.threshold
        bits_of: dict[str, int] = {}
        for i, c in enumerate(text):
            bits_of[c] = bits_of.get(c, 0) | 1 << i
        for at in places:
            other = self.texts[at]
            if other == text:
                yield int(self.order[at]), 1.0
            elif reaches(bits_of, size, other, math.ceil(t * (size + len(other)) / 2 - SLACK)):
                ratio = SequenceMatcher(None, text, other).ratio()
                if ratio >= t:
                    yield int(self.order[at]), ratio

    def like(self, text: str, bits: np.ndarray, among: np.ndarray | None = None) -> Iterator[tuple[int, float]]:
        """(number, ratio) of the texts that the new text, whose signature is ``bits``, is like."""
        return self.confirmed(text, self.likely(np.array([len(text)]), bits[None], np.array([UNKNOWN]), among)[0])


def reaches(places: dict[str, int], size: int, other: str, least: int) -> bool:
    """Whether the longest common subsequence of a text of this size, given the bits where each character stands in it, and another text has so many characters.

    The unset bits of ``unmet`` below i count what the text's first i characters
    have in common with the other's so far.  The first ones of the other text can
    meet no later character than deletions allow, so most fail early.
    """
    deletions, insertions = size - least, len(other) - least
    unmet = (1 << size) - 1
    for begin in range(0, len(other), 16):
        for place in map(places.get, other[begin : begin + 16], repeat(0)):
            met = unmet & place
            unmet = (unmet + met) | (unmet - met)
        end = min(begin + 16, len(other))
        within = min(end + deletions, size)
        if end - within + (unmet & (1 << within) - 1).bit_count() > insertions:
            return False
    return True


def shaped(rows: DataFrame, key: str, text: str, date: str | None = None) -> DataFrame:
    """k, the text in lower case with single blanks (t) and its day, for the rows that have a text."""
    day = F.lit(UNKNOWN) if date is None else F.coalesce(F.datediff(strict_date(F.col(date)), F.lit("1970-01-01").cast("date")), F.lit(UNKNOWN))
    return rows.where(has_text(text)).select(F.col(key).cast("long").alias("k"), collapsed(F.col(text)).alias("t"), day.alias("day"))


def has_text(text: str) -> Column:
    return collapsed(F.coalesce(F.col(text), F.lit(""))) != ""


def slices(rows: DataFrame, first: int = SLICE_ROWS) -> list[tuple[int | None, int | None]]:
    """Bounds (above, up to) of k that part shaped rows, each part small enough for one task, the parts growing from ``first`` rows."""
    n, characters = rows.agg(F.count("*"), F.sum(F.length("t"))).first()
    most = max(1, min(SLICE_ROWS, n * SLICE_CHARACTERS // max(characters or 0, 1)))
    ends, size = [min(first, most)], min(first, most)
    while ends[-1] < n:
        size = min(2 * size, most)
        ends.append(ends[-1] + size)
    inner = [e / n for e in ends[:-1]]
    bounds = sorted(set(rows.agg(F.percentile_approx("k", inner, 100_000)).first()[0])) if inner else []
    return list(zip([None, *bounds], [*bounds, None]))


def between(rows: DataFrame, above: int | None, upto: int | None) -> DataFrame:
    rows = rows if above is None else rows.where(F.col("k") > above)
    return rows if upto is None else rows.where(F.col("k") <= upto)


def _signed(frame: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Texts, sizes, signatures and days."""
    texts = frame["t"].tolist()
    return texts, np.array([len(t) for t in texts], np.int64), np.ascontiguousarray(signatures(texts).T), frame["day"].to_numpy(np.int64)


class Known:
    """Shaped rows that all tasks hold: bounded, a slice at most."""

    def __init__(self, rows: DataFrame):
        held = rows.toArrow()
        self.shared = rows.sparkSession.sparkContext.broadcast([held[c].to_pylist() for c in ("k", "t", "day")])

    def without_copies(self, rows: DataFrame, threshold: float, days: int | None) -> DataFrame:
        """The shaped rows that are a copy of none of these."""
        shared = self.shared

        def kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            _, texts, dates = shared.value
            index = Likeness(texts, threshold, dates, days)
            for frame in frames:
                new, *signed = _signed(frame)
                yield frame[[next(index.confirmed(text, places), None) is None for text, places in zip(new, index.likely(*signed))]]

        return rows.mapInPandas(kept, SHAPE)

    def pairs(self, rows: DataFrame, threshold: float, earlier: bool) -> DataFrame:
        """(first, second, ratio) of these and like rows; with ``earlier`` only where first < second."""
        shared = self.shared

        def paired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, texts, _ = shared.value
            index, keys = Likeness(texts, threshold), np.array(keys, np.int64)
            for frame in frames:
                new, _, signed, _ = _signed(frame)
                found = [(int(keys[at]), k, ratio) for k, text, bits in zip(frame["k"].tolist(), new, signed) for at, ratio in index.like(text, bits, keys[index.order] < k if earlier else None)]
                yield pd.DataFrame(found, columns=["first", "second", "ratio"])

        return rows.mapInPandas(paired, "first long, second long, ratio double")


def first_copies(rows: DataFrame, threshold: float, days: int | None) -> DataFrame:
    """The shaped rows of one slice that a pass in ascending order keeps: each unless it is a copy of one already kept."""

    def kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (whole := list(frames)):
            return
        frame = pd.concat(whole).sort_values("k", kind="stable")
        index = Likeness(frame["t"].tolist(), threshold, frame["day"].tolist(), days)
        place = np.argsort(index.order)
        taken = np.zeros(len(frame), bool)
        texts, *signed = _signed(frame)
        for begin in range(0, len(texts), GROUP):
            some = slice(begin, begin + GROUP)
            among = taken.copy()
            among[place[some]] = True
            for at, text, places in zip(place[some], texts[some], index.likely(*(x[some] for x in signed), among)):
                taken[at] = next(index.confirmed(text, places[taken[places]]), None) is None
        yield frame[taken[place]]

    return rows.repartition(1).mapInPandas(kept, SHAPE)


def similar_pairs(rows: DataFrame, key: str, text: str, threshold: float, others: DataFrame | None = None) -> DataFrame:
    """(first, second, ratio) of all pairs whose texts reach the threshold.

    Without ``others`` a self-join with first < second; with it, ``second`` comes
    from there.  The ratio is taken as (second's text, first's text), so the later
    of two rows is the new one.
    """
    one = shaped(rows, key, text)
    two = shaped(others, key, text) if others is not None else one
    parts = [Known(between(one, *bounds)).pairs(two, threshold, others is None) for bounds in slices(one)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
