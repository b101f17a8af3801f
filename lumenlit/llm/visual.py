"""One stored form for text that looks the same.

Every letter that is drawn alike in several scripts belongs to a class of
twins.  A token's script is found by intersecting, over its letters, the scripts
that each letter can be spelled in: letters without a twin admit only their own
script, twins admit every script of their class.  One script left: the token
is spelled in it (this mends mixed-script tokens).  Several left (a whole-script
confusable such as a lone look-alike word): the text's prevailing script decides.
None left (a genuine mixture, as in names of genes): twins take their Latin
spelling.  All decisions depend on what is seen only, so texts that look the
same get the same form, and the form looks like the text.

Besides that: canonical composition; width, presentation and ligature forms by
compatibility mapping (raised and lowered figures stay); one blank, one
hyphen; invisible characters are removed.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlit.scratch import Scratch

# Letters drawn alike, as (Latin, Cyrillic, Greek); a dot where a script has none.
TWINS = (
    ("A", "А", "Α"), ("B", "В", "Β"), ("C", "С", "Ϲ"), ("E", "Е", "Ε"), ("H", "Н", "Η"), ("I", "І", "Ι"), ("J", "Ј", "Ϳ"), ("K", "К", "Κ"),
    ("M", "М", "Μ"), ("N", ".", "Ν"), ("O", "О", "Ο"), ("P", "Р", "Ρ"), ("S", "Ѕ", "."), ("T", "Т", "Τ"), ("X", "Х", "Χ"), ("Y", "У", "Υ"), ("Z", ".", "Ζ"),
    ("Q", "Ԛ", "."), ("W", "Ԝ", "."),
    ("a", "а", "."), ("c", "с", "ϲ"), ("d", "ԁ", "."), ("e", "е", "."), ("h", "һ", "."), ("i", "і", "."), ("j", "ј", "ϳ"), ("l", "ӏ", "."),
    ("o", "о", "ο"), ("p", "р", "."), ("q", "ԛ", "."), ("s", "ѕ", "."), ("v", "ѵ", "ν"), ("w", "ԝ", "."), ("x", "х", "."), ("y", "у", "."),
)
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
# Other characters drawn alike.
ALIKE = {"ʼ": "'", "‐": "-", "‑": "-", "﹣": "-", "－": "-", "⁃": "-", "ı": "ı", " ": "\n", " ": "\n", "\u0085": "\n"}
# Characters without a visible mark, besides the Unicode category of format controls.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
KEPT_FORMS = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>")

_PROTOTYPE = {other: latin for latin, *others in TWINS for other in others if other != "."}
_SPELLING = {script: {row[0]: row[i] for row in TWINS if row[i] != "."} for i, script in enumerate(SCRIPTS)}
_CLASSES = set(_SPELLING["LATIN"])
_TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
# Latin letters without and with accents, composed, and marks that have no other spelling: one possessive class, so a match is linear
_LATIN = re.compile(r"[\x20-\x7e\nÀ-ÖØ-öø-ÿ¡¢£¥§©«®°±²³¶·¹»¿×÷–—€]*+")


class _Seen(dict):
    """A translation table that works out each character once."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = self.look(c)
        return out

    @staticmethod
    def look(c: str) -> str:
        if c in ALIKE:
            return ALIKE[c]
        if c == "\n" or c in _PROTOTYPE:  # a twin keeps its script until its token is spelled
            return c
        kind = unicodedata.category(c)
        if kind == "Zs" or c in "\t\x0b\x0c":
            return " "
        if kind in ("Cf", "Cc") or ord(c) in INVISIBLE:
            return ""
        form = unicodedata.decomposition(c)
        if form.startswith("<") and not form.startswith(KEPT_FORMS):
            c = unicodedata.normalize("NFKC", c)
        return "".join(ALIKE.get(x, x) for x in c)


class _Prototypes(dict):
    def __missing__(self, code: int) -> str:
        self[code] = out = _PROTOTYPE.get(chr(code), chr(code))
        return out


_SEEN, _PROTOTYPES = _Seen(), _Prototypes()
_SCRIPT_OF: dict[str, str] = {}


def _script(c: str) -> str:
    if c not in _SCRIPT_OF:
        name = unicodedata.name(c, "?").split()[0]
        _SCRIPT_OF[c] = "MARK" if unicodedata.combining(c) else name
    return _SCRIPT_OF[c]


def resolved_scripts(token: str) -> set[str]:
    """The scripts that every letter of a token of prototypes can be spelled in; empty for a genuine mixture."""
    scripts: set[str] | None = None
    for c in set(token):
        if _script(c) == "MARK":
            continue
        own = {s for s in SCRIPTS if c in _SPELLING[s]} if c in _CLASSES else {_script(c)}
        scripts = own if scripts is None else scripts & own
    return scripts or set()


@lru_cache(maxsize=1 << 16)
def _resolved(token: str) -> tuple[str, ...]:
    return tuple(sorted(resolved_scripts(token)))


@lru_cache(maxsize=1 << 16)
def _spelled(token: str, prevailing: str) -> str:
    """A token of prototypes in the script that is consistent with it and, where several are, with the text."""
    found = _resolved(token)
    script = prevailing if prevailing in found else found[0] if len(found) == 1 else "LATIN"
    if script != prevailing and 2 * sum(c not in _CLASSES for c in token) <= len(token):
        script = "LATIN"  # a few foreign letters, as in PI3Kα, don't turn their neighbours into foreign ones
    table = _SPELLING.get(script, {}) if found else {}
    return "".join(table.get(c, c) for c in token)


@lru_cache(maxsize=1 << 16)
def _mixed(token: str) -> bool:
    """Whether a token mixes scripts as stored."""
    return len({_script(c) for c in token} & set(SCRIPTS)) > 1


def consistent_form(text: str | None) -> tuple[str | None, int]:
    """The consistent form of a text, and how many of its tokens mixed scripts as stored.

    Null stays null, an empty text stays empty; length is not limited, and the
    time is in proportion to it.  The form of a form is itself.
    """
    if text is None:
        return None, 0
    if _LATIN.fullmatch(text):
        # every letter is Latin: each token admits Latin, no token admits one other script alone,
        # so Latin prevails and spells every token as it stands; nothing else here has another form
        return text, 0
    seen = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text.replace("\r\n", "\n").replace("\r", "\n")).translate(_SEEN))
    flat = seen.translate(_PROTOTYPES)
    counts = Counter(_TOKEN.findall(flat))
    weight = dict.fromkeys(SCRIPTS, 0)
    for t, n in counts.items():
        found = _resolved(t)
        if len(found) == 1 and found[0] in weight:
            weight[found[0]] += len(t) * n
    prevailing = max(SCRIPTS, key=lambda s: (weight[s], s == "LATIN"))
    spelled = {t: made for t in counts if (made := _spelled(t, prevailing)) != t}
    mixed = 0 if seen.isascii() else sum(n for t, n in Counter(_TOKEN.findall(seen)).items() if not t.isascii() and _mixed(t))
    if spelled:
        flat = _TOKEN.sub(lambda m: spelled.get(m[0], m[0]), flat)
    return unicodedata.normalize("NFC", flat), mixed


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [consistent_form(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int32())], names=["doc_id", "text", "form", "mixed_tokens"])


def consistent_texts(documents: DataFrame) -> DataFrame:
    """doc_id, text, its consistent form and the number of tokens that mixed scripts; null texts give a null form."""
    return documents.select("doc_id", "text").mapInArrow(_forms, "doc_id long, text string, form string, mixed_tokens int")


def _members(documents: DataFrame) -> DataFrame:
    """doc_id, look (a digest of the form) and stored (a digest of the text) of every text, worked out once."""
    members = consistent_texts(documents.where("text is not null and doc_id is not null")).select("doc_id", F.md5("form").alias("look"), F.md5("text").alias("stored"))
    return Scratch(documents.sparkSession, "look-alikes").cut(members, "members")


def look_classes(documents: DataFrame) -> DataFrame:
    """look, stored and the number of documents of each stored form that shares its look with another; a class of any size is a few rows."""
    stored = _members(documents).distinct().groupBy("look", "stored").agg(F.count("*").alias("documents"))
    varied = stored.groupBy("look").agg(F.count("*").alias("forms")).where("forms > 1")
    return stored.join(varied, "look")


def look_alikes(documents: DataFrame) -> DataFrame:
    """doc_a < doc_b for each pair of documents that look the same but are stored differently.

    Null texts look like nothing, empty texts only like texts without a visible
    mark.  Repeats of a stored text are paired with every differing twin, never
    with each other; a repeated doc_id counts once per stored text.
    """
    members = _members(documents)
    varied = members.groupBy("look").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("look")
    members = members.join(varied, "look", "left_semi").distinct()
    classes = members.select("look", "stored").distinct()
    pairs = classes.withColumnRenamed("stored", "sa").join(classes.withColumnRenamed("stored", "sb"), "look").where("sa < sb")
    pairs = pairs.join(members.select("look", F.col("stored").alias("sa"), F.col("doc_id").alias("a")), ["look", "sa"])
    pairs = pairs.join(members.select("look", F.col("stored").alias("sb"), F.col("doc_id").alias("b")), ["look", "sb"])
    return pairs.where("a <> b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()
