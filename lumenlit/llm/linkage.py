"""Matching two listings of works that share no key.

Both sides are brought to comparable attributes.  Candidate pairs come from
MinHash over the words of the titles, each word drawn with a weight that grows with
its rarity: a band is the least hash of a title's words together with a part of its
first word and its numbers (which a comparison never lets differ), and beside the
bands stand the title's rare words, each with the least of its common ones.  Titles
that may be cut ask by bands over their first words, without numbers: together with
the trial, registry number or venue, and by themselves where enough words are left.
Titles that say nothing ask by trial and venue, and DOIs are a key of their own.
A pair's features feed a logistic classifier that is trained on weak labels:
whether two present DOIs agree.  Its scores are calibrated on held-out pairs by
isotonic regression; the DOI's own evidence is added as log-odds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lumenlit.scratch import Scratch

# a band: which part of the first word it holds, and the numbers of its hash functions
BANDS = (("head", (1,)), ("head", (2,)), ("tail", (3,)))
RARE_BANDS = (4, 5)  # hash functions of the bands that hold a rare word
BEGINNINGS = (2, 3, 5, 7, 9)  # words after the first that a band over a title's beginning draws from
BESIDE_BANDS = (("head", (6,)), ("tail", (7,)))  # of beginnings, each with the trial, registry number or venue
ALONE_BANDS = (("head", (8, 9, 14)), ("tail", (10, 11, 15)))  # of beginnings of ALONE words and more, by themselves
ALONE = 3
FLATTEST = 1000  # words of fewer titles than one in FLATTEST all weigh the same, so that a misspelt word is no more likely to be drawn
RARE_SHARE, BUCKETS = 200, 1 << 16  # a word of more than one title in RARE_SHARE is not rare; words are counted by hash
UNSEEN = 1000  # titles without a given word that are assumed beside those seen, so that few titles make no word common
KEY_BITS = 48  # what a key takes in a shuffle; chance pairs stay rare far beyond 10**12 keys
ASKED_BITS = 1 << 22  # the filter of beginnings that are asked for, whatever the input; it only saves keys and loses none
LABELLED_PAIRS = 40_000  # bound of the labelled sample that the classifier is fitted on
MIN_CONFIDENCE = 0.5
DOI_SAME, DOI_OTHER = 4.5, -3.0  # log-odds of the DOI's evidence: one in a hundred DOIs belongs to another work, a few in a hundred are wrong

# Titles that name a kind of text and no work.
GENERIC_TITLES = {"original article", "erratum", "press release", "conference abstract", "label update", "abstract", "article", "correction", "corrigendum", "editorial", "letter", "untitled", "report", "news", "title", "full text", "supplement", "poster", "research article", "case report", "review", "guideline", "safety update", "update", "late breaking abstract"}


_LEAD = r"^[\s\p{Z}]*(?:(?:(?:re|fwd?|aw|oral|poster|late-breaking|abstract|paper)(?:\s+[a-z]*\d+)?\s*:|\[[^\]]*\])[\s\p{Z}]*)+"
_MARKS = r"(?:…|\.\.\.|\.\.\.\])[\s\p{Z}]*$"
_DOI_LEAD = re.compile(r"^(?:https?://)?(?:dx\.)?(?:doi\.org/)?(?:doi:?)?")
_DOI = re.compile(r"10\.\d{4,9}/\S+")
_TRIAL = re.compile(r"[a-z]{2,}\d+[a-z]?")
_TRIAL_WORDS = re.compile(r"^\s*the\s+|\s+(?:trial|study)\s*$")
_NOT_TRIAL = re.compile(r"[^a-z0-9]")
_SPELLING = re.compile(r"(?<=[a-z]{3})is(?=(?:e|ed|ation|ing)$)")
_PATIENTS = r"\bin (?:pa?\w{4,8} with )+"
# Connectives that stand for each other.
_SAME_WORDS = {"v": "versus", "vs": "versus", "plus": "and", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12"}


def _split(titles: pa.Array) -> pa.ListArray:
    return pc.split_pattern(titles, " ")


def tidy_titles(titles: pa.Array) -> pa.Array:
    """Lower case words; prefixes, connectives and spelling variants are made equal.  Null becomes empty."""
    t = pc.utf8_lower(pc.fill_null(titles, ""))
    for old, new in (("&amp;", "&"), ("&#38;", "&"), ("&", " and ")):
        t = pc.replace_substring(t, old, new)
    t = pc.utf8_trim(pc.replace_substring_regex(pc.replace_substring_regex(t, _LEAD, ""), r"[^\p{L}\p{N}]+", " "), " ")
    words = _split(t)
    t = pc.binary_join(pa.ListArray.from_arrays(words.offsets, _mapped(words.values, _plain_word)), " ")
    # "in patients with X" and "in X" are one; the word may be misspelt or repeated
    return pc.replace_substring_regex(t, _PATIENTS, "in ")


def tidy_title(title: str | None) -> str:
    return tidy_titles(pa.array([title], pa.string()))[0].as_py()


def _mapped(values: pa.Array, change: Callable[[str], str | int | None], kind: pa.DataType = pa.string()) -> pa.Array:
    """Every value of an array changed; each distinct one once."""
    coded = values.dictionary_encode()
    return pa.array([change(v) for v in coded.dictionary.to_pylist()], kind).take(coded.indices)


@lru_cache(maxsize=1 << 17)
def _plain_word(word: str) -> str:
    return _SAME_WORDS.get(word) or (_SPELLING.sub("iz", word) if "is" in word else word)


def tidy_doi(doi: str | None) -> str | None:
    if not doi:
        return None
    d = _DOI_LEAD.sub("", "".join(doi.lower().split()).replace("%2f", "/")).rstrip(".,;)")
    return d if _DOI.fullmatch(d) else None


def tidy_registry(number: str | None) -> str | None:
    digits = "".join(c for c in number.split("(")[0] if c.isdigit()) if number else ""
    return digits if len(digits) == 8 else None


def tidy_trial(name: str | None) -> str | None:
    """Letters and number of a trial's name, else null (placeholders have no number)."""
    t = _NOT_TRIAL.sub("", _TRIAL_WORDS.sub("", name.lower())) if name else ""
    return t if _TRIAL.fullmatch(t) else None


def tidy_venue(venue: str | None) -> str | None:
    """The initials of a venue, which its abbreviation and its long form share."""
    words = re.sub(r"[.,&]", " ", venue.lower()).split() if venue else []
    return words[0] if len(words) == 1 else "".join(w[0] for w in words) or None


def _mix(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.uint64)
    x = np.multiply(x ^ (x >> np.uint64(31)), np.uint64(0x9E3779B97F4A7C15))
    x = np.multiply(x ^ (x >> np.uint64(29)), np.uint64(0xBF58476D1CE4E5B9))
    return x ^ (x >> np.uint64(32))


def _hash(word: str) -> int:
    return xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=1 << 17)
def _known(word: str) -> tuple[int, int, int, bool]:
    """The hashes of a word, of its head and of its tail, and whether it is a number."""
    # of two long words that differ by a letter, the first seven letters are equal or the last ones
    return _hash(word), _hash("head " + word[:7]), _hash("tail " + word[-11:]), word[:1].isdigit()


def _signed(value: str | None) -> int | None:
    """A hash of a value, as a long; null for none."""
    return None if value is None else _hash(value) - (1 << 63)


_SIDE = "id long, title string, doi long, trial long, registry long, venue long, year int, marked boolean, generic boolean"


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid, title, doi, trial, registry, venue, year = (batch.column(i) for i in range(7))
        t = tidy_titles(title)
        few = pc.less(pc.count_substring(t, " "), 2)
        generic = pc.or_(pc.is_in(t, pa.array(sorted(GENERIC_TITLES))), few)
        marked = pc.and_(pc.fill_null(pc.match_substring_regex(title, _MARKS), False), pc.invert(generic))
        columns = [rid, t, *(_mapped(c, lambda v, tidy=tidy: _signed(tidy(v)), pa.int64()) for c, tidy in ((doi, tidy_doi), (trial, tidy_trial), (registry, tidy_registry), (venue, tidy_venue))), year, marked, generic]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _SIDE.split(", ")])


def comparable(rows: DataFrame, key: str, title: str, doi: str, trial: str, registry: str, venue: str, year: Column) -> DataFrame:
    """One side in comparable attributes, of which those only compared for equality are hashed; ``marked`` titles say themselves that they are cut."""
    given = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate((title, doi, trial, registry, venue))], year.cast("int").alias("year"))
    return given.mapInArrow(_prepared, _SIDE)


def _last_word() -> Column:
    word = F.substring_index("title", " ", -1)
    return F.when(word.rlike("^[0-9]"), F.lit("#")).otherwise(word)


def with_short(*sides: DataFrame) -> list[DataFrame]:
    """The sides with ``short``: the title may be cut, as it is marked so or ends in a word in which hardly any title ends.

    Words in which at least one title in RARE_SHARE ends are ends of whole
    titles (UNSEEN titles are assumed to end otherwise); there are fewer than
    RARE_SHARE of them.  All numbers are one word here.
    """
    ends = sides[0].where("not generic and not marked").select(_last_word().alias("word"))
    for side in sides[1:]:
        ends = ends.unionByName(side.where("not generic and not marked").select(_last_word().alias("word")))
    counts = ends.groupBy("word").count()
    whole = counts.crossJoin(F.broadcast(counts.agg(F.sum("count").alias("all")))).where(F.col("count") * RARE_SHARE >= F.col("all") + UNSEEN).select("word")
    words = ["#", *(r[0] for r in whole.collect())]  # a number ends a title: one cut inside could not be told from another work's
    return [side.withColumn("short", ~F.col("generic") & (F.col("marked") | ~_last_word().isin(words))) for side in sides]


def _bucket(word: str) -> int:
    return _known(word)[0] % BUCKETS


class Titles:
    """The words of a batch of titles as numbers; what depends on a word alone is worked out once per distinct word."""

    def __init__(self, titles: pa.Array, shares: np.ndarray | None = None):
        split = _split(titles)
        coded = split.values.dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.starts = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        self.sizes = np.diff(split.offsets.to_numpy())
        self.at = np.arange(len(self.codes)) - np.repeat(self.starts, self.sizes)  # place in the title
        of = np.array([_known(w) for w in self.words], np.uint64).reshape(-1, 4)
        self.hash, self.head, self.tail, self.number = of[:, 0], of[:, 1], of[:, 2], of[:, 3] > 0
        self.bucket = (self.hash % np.uint64(BUCKETS)).astype(np.int64)
        if shares is None:
            return
        self.share = shares[self.bucket]
        self.rare = self.share * RARE_SHARE <= 1
        self.rarity = -np.log(np.clip(self.share, 1 / FLATTEST, 0.95))
        self.first = self.codes[self.starts]

    def drawn(self, function: int, power: float) -> np.ndarray:
        """A hash of each distinct word: the least of several is one of them in proportion to rarity ** power."""
        u = (_mix(self.hash ^ np.uint64(0xA24BAED4963EE407 * function & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(float) / 2**53
        return -np.log(np.maximum(u, 1e-300)) / self.rarity**power

    def least(self, function: int, power: float, mask: np.ndarray) -> np.ndarray:
        """The weighted MinHash of each title over its words in the mask."""
        return np.minimum.reduceat(np.where(mask, self.drawn(function, power)[self.codes], np.inf), self.starts).view(np.uint64)

    def numbers(self) -> np.ndarray:
        """A hash of each title's numbers, in any order."""
        return np.add.reduceat(np.where(self.number[self.codes], _mix(self.hash[self.codes]), np.uint64(0)), self.starts)


def _combined(*parts: np.ndarray | int) -> np.ndarray:
    key = np.zeros(1, np.uint64)
    for part in parts:
        key = _mix((key ^ np.uint64(0x2545F4914F6CDD1D)) + np.asarray(part, np.uint64))
    return key >> np.uint64(64 - KEY_BITS)


def title_keys(titles: pa.Array, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the title and key: its bands, and its rare words each with the least of the common words; all with its numbers."""
    words = Titles(titles, shares)
    numbers, number, first = words.numbers(), words.number[words.codes], words.at == 0
    everything = np.arange(len(titles))
    index, keys = [], []
    for band, (part, functions) in enumerate(BANDS):
        drawn = [words.least(f, 0.5, ~first & ~number) for f in functions]
        index.append(everything)
        keys.append(_combined(1 + band, getattr(words, part)[words.first], *drawn, numbers))
    rare = ~first & ~number & words.rare[words.codes]
    at = np.flatnonzero(rare)
    owner = np.repeat(everything, words.sizes)[at]
    for f in RARE_BANDS:
        common = words.least(f, 1.0, ~first & ~number & ~rare)
        index.append(owner)
        keys.append(_combined(50 + f, words.hash[words.codes[at]], common[owner], numbers[owner]))
    return np.concatenate(index), np.concatenate(keys).view(np.int64)


def beginning_keys(titles: pa.Array, shares: np.ndarray, asks: bool, beside: list[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Index and key of bands over each title's first words, for titles that may be cut (``asks``) and those that they may be the beginning of.

    A cut title's last word may be broken and is left out; it asks by the widest
    beginning that it has whole: together with each attribute in ``beside`` (hashes,
    0 for none), and by itself where enough words are left to tell works apart.
    """
    words = Titles(titles, shares)
    left = words.sizes - 1 - asks
    index, keys = [], []

    def give(own: np.ndarray, *parts: np.ndarray | int) -> None:
        index.append(own)
        keys.append(_combined(*parts))

    # the words after the first as a grid, in which the least of a beginning is a running one
    place = np.minimum(words.starts[:, None] + np.arange(1, BEGINNINGS[-1] + 1), max(len(words.codes) - 1, 0))
    grid, head = words.codes[place], {"head": words.head, "tail": words.tail}
    rare = words.rare[grid]

    @lru_cache(maxsize=None)
    def least(function: int, common: bool = False) -> np.ndarray:
        values = words.drawn(function, 1.0)[grid]
        return np.minimum.accumulate(np.where(rare, np.inf, values) if common else values, axis=1).view(np.uint64)

    for i, width in enumerate((0, *BEGINNINGS)):
        usable = left >= width
        if asks and i < len(BEGINNINGS):
            usable &= left < BEGINNINGS[i]
        usable = np.flatnonzero(usable)
        drawn = lambda functions, own, common=False: [least(f, common)[own, width - 1] for f in functions] if width else []  # noqa: B023, E731
        for band, (part, functions) in enumerate(BESIDE_BANDS):
            for kind, attribute in enumerate(beside):
                own = usable[attribute[usable] != 0]
                give(own, 1000 * width + 10 * band + kind, head[part][words.first[own]], *drawn(functions, own), attribute[own])
        if width < ALONE:
            continue
        for band, (part, functions) in enumerate(ALONE_BANDS):
            give(usable, 1000 * width + 100 + band, head[part][words.first[usable]], *drawn(functions, usable))
        # a rare word with the least common ones, for a first word that is misspelt throughout
        own, at = np.nonzero(rare[usable, :width])
        own = usable[own]
        give(own, 1000 * width + 200, words.hash[grid[own, at]], *drawn((12, 13), own, True))
    return np.concatenate(index), np.concatenate(keys).view(np.int64)


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often words of each bucket occur; bucket -1 counts the titles."""
    n, titles = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        if not len(batch):
            continue
        words = Titles(batch.column(0))
        titles += len(batch)
        np.add.at(n, words.bucket, np.bincount(words.codes, minlength=len(words.words)))
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], titles))], names=["bucket", "n"])


def word_shares(*sides: DataFrame) -> np.ndarray:
    """How often a word of each bucket occurs, per title; at most BUCKETS rows reach the driver."""
    titles = sides[0].where("not generic").select("title")
    for side in sides[1:]:
        titles = titles.unionByName(side.where("not generic").select("title"))
    got = titles.mapInArrow(_counted_words, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    n = dict(zip(got["bucket"], got["n"]))
    shares = np.zeros(BUCKETS)
    for at, k in n.items():
        if at >= 0:
            shares[at] = k / (n[-1] + UNSEEN)
    return shares


def _hashed(values: pa.Array) -> np.ndarray:
    """Hashed values as unsigned numbers, 0 for none."""
    return values.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)


_KEYED = ("id", "title", "doi", "trial", "registry", "venue", "generic", "short")


def _alike(shares) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """id and key by which alike titles, cut or not, and equal DOIs meet."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dois = batch.column("id"), _hashed(batch.column("doi"))
            known = np.flatnonzero(dois)
            index, keys = [known], [_combined(7, dois[known]).view(np.int64)]
            told = np.flatnonzero(~batch.column("generic").to_numpy(zero_copy_only=False))
            if len(told):
                at, key = title_keys(batch.column("title").take(pa.array(told)), shares.value)
                index.append(told[at])
                keys.append(key)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(index))), pa.array(np.concatenate(keys))], names=["id", "key"])

    return give


def _reaching(shares, asks: bool, asked=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """id and key by which cut titles and titles that say nothing ask for works; of the offered ones only those that are asked for."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.unpackbits(np.frombuffer(asked.value, np.uint8), bitorder="little").view(bool) if asked is not None else None
        for batch in batches:
            generic = batch.column("generic").to_numpy(zero_copy_only=False)
            trial, registry, venue = (_hashed(batch.column(c)) for c in ("trial", "registry", "venue"))
            bare = np.flatnonzero((trial != 0) & (venue != 0) & (generic | (not asks)))
            index, keys = [bare], [_combined(8, trial[bare], venue[bare]).view(np.int64)]
            told = np.flatnonzero(~generic & (batch.column("short").to_numpy(zero_copy_only=False) | (not asks)))
            if len(told):
                at, key = beginning_keys(batch.column("title").take(pa.array(told)), shares.value, asks, [c[told] for c in (trial, registry, venue)])
                index.append(told[at])
                keys.append(key)
            index, keys = np.concatenate(index), np.concatenate(keys)
            if filled is not None:
                wanted = filled[keys & (ASKED_BITS - 1)]
                index, keys = index[wanted], keys[wanted]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(index)), pa.array(keys)], names=["id", "key"])

    return give


def _asked(keys: DataFrame) -> bytes:
    """The filter of asked keys, one bit for each class of hashes; at most ASKED_BITS / 64 rows reach the driver."""
    bit = F.col("key").bitwiseAND(F.lit(ASKED_BITS - 1))
    got = keys.select(F.shiftright(bit, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits")).toArrow()
    out = np.zeros(ASKED_BITS // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.tobytes()


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (left_id, right_id) that share a blocking key in either direction."""
    if "short" not in left.columns:
        left, right = with_short(left, right)
    context = left.sparkSession.sparkContext
    shares = context.broadcast(word_shares(left, right))
    keyed = lambda rows, give: rows.select(*_KEYED).mapInArrow(give, "id long, key long")

    def meet(one: DataFrame, other: DataFrame) -> DataFrame:
        return one.withColumnRenamed("id", "left_id").join(other.withColumnRenamed("id", "right_id"), "key").select("left_id", "right_id")

    def reaching(asking: DataFrame, offering: DataFrame) -> tuple[DataFrame, DataFrame]:
        asks = keyed(asking.where("short or generic"), _reaching(shares, True))
        return asks, keyed(offering, _reaching(shares, False, context.broadcast(_asked(asks))))

    asks, offers = reaching(left, right)
    asks_left, offers_left = reaching(right, left)
    pairs = meet(keyed(left, _alike(shares)).unionByName(asks), keyed(right, _alike(shares)).unionByName(offers)).unionByName(meet(offers_left, asks_left))
    # by left_id, as the attributes come next
    return pairs.repartition("left_id").distinct()


def _packed() -> dict[str, Column]:
    """A side's attributes as it travels: those only compared for equality as short hashes, 0 for none, in few columns."""
    short = lambda c: F.when(F.col(c).isNotNull(), F.hash(c)).otherwise(0)
    pair = lambda high, low: F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    flags = F.coalesce("year", F.lit(0)) * 4 + F.col("short").cast("int") * 2 + F.col("generic").cast("int")
    return {"title": F.col("title"), "doi": short("doi"), "near": pair(short("trial"), short("registry")), "far": pair(short("venue"), flags)}


def _opened(side: str) -> dict[str, Column]:
    """The attributes that ``_packed`` packed."""
    low = lambda c: F.shiftright(F.shiftleft(f"{side}_{c}", 32), 32).cast("int")
    high = lambda c: F.shiftright(f"{side}_{c}", 32).cast("int")
    given = {"doi": F.col(f"{side}_doi"), "trial": high("near"), "registry": low("near"), "venue": high("far"), "year": F.shiftright(low("far"), 2)}
    return {f"{side}_{k}": F.nullif(v, F.lit(0)) for k, v in given.items()} | {f"{side}_short": low("far").bitwiseAND(F.lit(2)) != 0, f"{side}_generic": low("far").bitwiseAND(F.lit(1)) != 0}


FEATURES = ("equal", "slips", "close", "begins", "generic", "differs", "unlike", "trial_same", "trial_other", "registry_same", "registry_other", "venue_same", "venue_other", "year_same", "year_near", "year_far", "alone")


def _slip(x: Column, y: Column) -> Column:
    """0 for equal words, 1 for a slip of the pen, 9 for different words; numbers never slip, and a word is no slip of one it ends or begins."""
    near = F.levenshtein(x, y)
    swapped = F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, ""))
    least, most = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    apart = (most - least >= 3) & (x.endswith(y) | y.endswith(x) | x.startswith(y) | y.startswith(x))
    return F.when(x == y, 0).when(x.rlike("[0-9]") | y.rlike("[0-9]"), 9).when((near <= 1) & (most > 1), 1).when((near == 2) & swapped, 1).when((least >= 6) & (near <= 3) & (near * 3 <= least) & ~apart, 1).otherwise(9)


def _apart(n: Column) -> Column:
    """1 if the first n words of the lists a and b are pairwise equal or slips, else 9; the first other pair decides."""
    return F.when(F.exists(F.sequence(F.lit(0), n - 1), lambda i: _slip(F.get(F.col("a"), i), F.get(F.col("b"), i)) > 1), 9).otherwise(1)


def compare(pairs: DataFrame) -> DataFrame:
    """The features, as bits of a mask, of pairs whose sides' attributes are prefixed l_ and r_."""
    a, b = F.split("l_title", " "), F.split("r_title", " ")
    rows = pairs.withColumns({"a": F.when(F.length("l_title") <= F.length("r_title"), a).otherwise(b), "b": F.when(F.length("l_title") <= F.length("r_title"), b).otherwise(a), "cut": F.when(F.length("l_title") <= F.length("r_title"), F.col("l_short")).otherwise(F.col("r_short"))})
    rows = rows.withColumn("n", F.size("a"))
    numbers = lambda c: F.filter(c, lambda w: w.rlike("^[0-9]"))
    words = F.when(F.col("l_title") == F.col("r_title"), F.lit(0)).when(F.size("b") == F.col("n"), _apart(F.col("n")))
    rows = rows.withColumn("most", F.coalesce(words, F.lit(9)))
    body = _apart(F.greatest(F.col("n") - 1, F.lit(1)))
    rows = rows.withColumn("begin", F.when(F.col("cut") & (F.size("b") >= F.col("n")) & (F.col("n") > 2) & (F.col("most") > 1), F.when(F.element_at("b", F.col("n")).startswith(F.element_at("a", F.col("n"))) | (_slip(F.element_at("a", F.col("n")), F.element_at("b", F.col("n"))) <= 1), body).otherwise(9)))
    most = F.col("most")
    # a few edits over the whole title, with equal numbers and connectives, none of which turns a word into one that it begins or ends
    links = lambda c: F.filter(c, lambda w: w.isin("with", "and", "versus"))
    turned = F.exists(F.array_except("a", "b"), lambda x: F.exists(F.array_except("b", "a"), lambda y: (F.abs(F.length(x) - F.length(y)) >= 3) & (x.endswith(y) | y.endswith(x))))
    close = (F.levenshtein("l_title", "r_title", 8) >= 0) & (numbers(F.col("a")) == numbers(F.col("b"))) & ((F.size(links(F.col("a"))) != F.size(links(F.col("b")))) | (links(F.col("a")) == links(F.col("b")))) & ~turned
    shared = F.size(F.array_intersect("a", "b"))
    generic = F.col("l_generic") | F.col("r_generic")
    kind = F.when(F.col("l_title") == F.col("r_title"), F.when(generic, "generic").otherwise("equal")).when(generic, "generic").when(most <= 1, "slips").when(F.coalesce("begin", F.lit(9)) <= 1, "begins").when(close, "close").when(shared * 2 < F.col("n"), "unlike").otherwise("differs")
    rows = rows.withColumn("kind", kind)
    both = lambda c: F.col(f"l_{c}").isNotNull() & F.col(f"r_{c}").isNotNull()
    out = {k: F.col("kind") == k for k in FEATURES[:7]}
    for c in ("trial", "registry", "venue"):
        out |= {f"{c}_same": both(c) & (F.col(f"l_{c}") == F.col(f"r_{c}")), f"{c}_other": both(c) & (F.col(f"l_{c}") != F.col(f"r_{c}"))}
    gap = F.abs(F.col("l_year") - F.col("r_year"))
    out |= {"year_same": gap == 0, "year_near": gap == 1, "year_far": gap > 1}
    out["alone"] = (F.col("kind").isin("begins", "generic")) & ~out["trial_same"] & ~out["registry_same"] & ~out["venue_same"]
    doi = F.when(both("doi"), F.when(F.col("l_doi") == F.col("r_doi"), 1).otherwise(-1)).otherwise(0)
    mask = F.lit(0)
    for i, name in enumerate(FEATURES):
        mask = mask + F.when(out[name], 1 << i).otherwise(0)
    vague = F.col("kind").isin("begins", "generic")
    return rows.select("left_id", "right_id", F.when(vague, F.hash("r_title")).alias("same_title"), doi.cast("int").alias("doi_agrees"), mask.cast("int").alias("mask"))


def _unpacked(masks: np.ndarray) -> np.ndarray:
    return ((np.asarray(masks, np.int64)[:, None] >> np.arange(len(FEATURES))) & 1).astype(float)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps; the first is the intercept."""
    x = np.column_stack([np.ones(len(x)), x]).astype(float)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def isotonic(score: np.ndarray, label: np.ndarray, least: int = 1) -> tuple[list[float], list[float]]:
    """Ascending score borders and the calibrated probability from each border on; pools below ``least`` pairs join the one below."""
    pools: list[list[float]] = []
    for at in np.unique(score):
        mine = label[score == at]
        pools.append([float(at), float(mine.sum()) + 0.0, float(len(mine))])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, k, n = pools.pop()
            pools[-1][1] += k
            pools[-1][2] += n
    for i in range(len(pools) - 1, 0, -1):
        if pools[i][2] < least:
            pools[i - 1][1:] = [pools[i - 1][1] + pools[i][1], pools[i - 1][2] + pools[i][2]]
            pools.pop(i)
    return [p[0] for p in pools], [(p[1] + 0.5) / (p[2] + 1.0) for p in pools]


def _held() -> Column:
    """The third of the pairs that the classifier is not fitted on."""
    return F.pmod(F.xxhash64("left_id", "right_id"), F.lit(3)) == 0


def calibration(matched: DataFrame) -> DataFrame:
    """tenth, pairs, stated, observed: the calibrated probability of held-out pairs before their DOIs are looked at, and how many of their DOIs agree.

    ``matched`` is the output of ``match_works``.  Pairs that a DOI alone may have
    brought together (titles that say nothing or are unlike) are left out, as in
    the fit; a share of DOIs is wrong, so agreement stays below certainty.
    """
    vague = sum(1 << FEATURES.index(k) for k in ("generic", "unlike"))
    held = matched.where((F.col("doi_agrees") != 0) & _held() & (F.col("mask").bitwiseAND(F.lit(vague)) == 0))
    tenths = held.groupBy(F.least(F.floor(F.col("level") * 10), F.lit(9)).cast("int").alias("tenth"))
    return tenths.agg(F.count("*").alias("pairs"), F.round(F.avg("level"), 4).alias("stated"), F.round(F.avg((F.col("doi_agrees") > 0).cast("int")), 4).alias("observed"))


def match_works(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id and confidence of every candidate pair, computed by the trained classifier.

    Sides are the outputs of ``comparable``.  Without labelled pairs of both
    classes (tiny or empty tables) fixed prior weights are used.
    """
    scratch = Scratch(left.sparkSession, "linkage")
    left, right = with_short(scratch.cut(left, "left"), scratch.cut(right, "right"))
    prefixed = lambda df, side: df.select(F.col("id").alias("left_id" if side == "l" else "right_id"), *[c.alias(f"{side}_{n}") for n, c in _packed().items()])
    pairs = candidates(left, right).join(prefixed(left, "l"), "left_id").join(prefixed(right, "r"), "right_id")
    compared = compare(pairs.withColumns(_opened("l") | _opened("r")))
    # ids are unique in sound tables; a repeated one must not repeat its pairs, which lie together already
    told = F.max((F.col("doi_agrees") + 1) * (1 << len(FEATURES)) + F.col("mask")).alias("told")
    once = compared.groupBy("left_id", "right_id").agg(F.max("same_title").alias("same_title"), told)
    featured = scratch.cut(once, "pairs").selectExpr("left_id", "right_id", "same_title", f"shiftright(told, {len(FEATURES)}) - 1 doi_agrees", f"told & {(1 << len(FEATURES)) - 1} mask")
    scratch.drop("left")
    scratch.drop("right")
    # a bounded sample: the labelled pairs with the least hash; those that only a DOI brought together are no evidence on titles
    labelled = featured.where("doi_agrees <> 0").withColumn("order", F.xxhash64("left_id", "right_id")).orderBy("order", "left_id", "right_id").limit(LABELLED_PAIRS)
    # equal masks are counted; there are at most 2 ** len(FEATURES) of them, and in practice some dozens
    table = labelled.withColumn("held", _held()).groupBy("doi_agrees", "held", "mask").count().toArrow().to_pydict()
    weights, borders, levels = _train(_unpacked(table["mask"]), np.array(table["doi_agrees"]) > 0, np.array(table["count"], int), np.array(table["held"], bool))
    masks = np.array(featured.select("mask").distinct().toArrow().column("mask").to_pylist(), int)
    at = np.searchsorted(borders, np.round(weights[0] + _unpacked(masks) @ weights[1:], 6), side="right") - 1
    confident = [(int(m), float(levels[max(a, 0)])) for m, a in zip(masks, at)]
    scored = featured.join(F.broadcast(left.sparkSession.createDataFrame(confident, "mask int, level double")), "mask")
    # several different works that a cut or empty title may mean share its chances
    vague = (F.col("mask").bitwiseAND(F.lit(sum(1 << FEATURES.index(k) for k in ("begins", "generic")))) != 0) & (F.col("doi_agrees") < 1)
    rivals = scored.where(vague).groupBy("left_id").agg(F.approx_count_distinct("same_title", 0.02).alias("rivals"))
    scored = scored.join(rivals, "left_id", "left")
    logit = F.log(F.col("level") / (1 - F.col("level"))) + F.when(F.col("doi_agrees") > 0, F.lit(DOI_SAME)).when(F.col("doi_agrees") < 0, F.lit(DOI_OTHER)).otherwise(F.lit(0.0)) - F.when(vague, F.log(F.greatest(F.coalesce("rivals", F.lit(1)), F.lit(1)).cast("double")) * 2).otherwise(F.lit(0.0))
    return scored.select("left_id", "right_id", "mask", "doi_agrees", "level", F.round(1 / (1 + F.exp(-logit)), 6).alias("confidence"))


_PRIOR = {"equal": 6.0, "slips": 5.0, "close": 3.0, "begins": 1.0, "generic": -1.0, "differs": -6.0, "unlike": -9.0, "trial_same": 1.0, "trial_other": -3.0, "registry_same": 1.0, "registry_other": -2.0, "venue_same": 1.5, "venue_other": -2.0, "year_same": 0.5, "year_near": 0.0, "year_far": -1.0, "alone": -2.0}


def _train(x: np.ndarray, y: np.ndarray, n: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, list[float], list[float]]:
    """Weights from counted rows of features, and the calibration of their scores on the held-out third."""
    prior = np.array([-1.0, *_PRIOR.values()])
    # what a shared DOI alone brought together (empty or unlike titles) would teach that such titles match
    use = x[:, FEATURES.index("generic")] + x[:, FEATURES.index("unlike")] == 0 if len(x) else np.zeros(0, bool)
    enough = lambda mask: mask.any() and 0 < n[mask & y].sum() < n[mask].sum()
    weights = fit_logistic(np.repeat(x[use & ~held], n[use & ~held], axis=0), np.repeat(y[use & ~held], n[use & ~held]).astype(float)) if enough(use & ~held) else prior
    weights[1 + FEATURES.index("generic")] = _PRIOR["generic"] - weights[0] - 1
    weights[1 + FEATURES.index("unlike")] = _PRIOR["unlike"] - weights[0] - 1
    score = np.round(weights[0] + x @ weights[1:], 6) if len(x) else np.zeros(0)
    if not enough(use & held):
        grid = np.arange(-12.0, 12.01, 0.5)
        return weights, list(grid), list(1 / (1 + np.exp(-grid)))
    borders, levels = isotonic(np.repeat(score[use & held], n[use & held]), np.repeat(y[use & held], n[use & held]).astype(float))
    return weights, borders, levels


def compared_works(evidence: DataFrame, catalog: DataFrame) -> DataFrame:
    """``match_works`` of the two tables."""
    year = F.expr("try_cast(regexp_extract(publication_date, '(19|20)[0-9][0-9]', 0) as int)")
    left = comparable(evidence, "evidence_id", "title", "doi", "trial_name", "nct_id", "journal", year)
    right = comparable(catalog, "catalog_id", "title", "doi", "trial_label", "nct_number", "venue", F.col("pub_year"))
    return match_works(left, right)


def works_of_evidence(evidence: DataFrame, catalog: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """evidence_id, catalog_id and confidence of the pairs that concern the same work.

    Null and placeholder attributes say nothing; repeated ids count once; a work
    listed twice is matched twice; empty tables give no rows.
    """
    matched = compared_works(evidence, catalog).where(F.col("confidence") >= least)
    return matched.select(F.col("left_id").alias("evidence_id"), F.col("right_id").alias("catalog_id"), "confidence")
