"""Reading one written date or time: all readings that its characters allow.

A reading is a tuple ``(form, sort_second, moment)``.  ``form`` names the
layout, ``sort_second`` places the reading on a UTC time line, and ``moment`` is
``YYYY-MM-DDTHH:MM:SSZ`` where a time is given, else a date of the precision
that the value really has.  Values that name no possible date give no reading.
"""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

_EPOCH = datetime(1970, 1, 1)

# Month names of the languages the feeds are written in.
_MONTH_NAMES = (
    "jan january janvier januar enero",
    "feb february février fevrier februar febrero",
    "mar march mars märz maerz marzo",
    "apr april avril abril",
    "may mai mayo",
    "jun june juin juni junio",
    "jul july juillet juli julio",
    "aug august août aout agosto",
    "sep sept september septembre septiembre setiembre",
    "oct october octobre oktober octubre okt",
    "nov november novembre noviembre",
    "dec december décembre decembre dezember diciembre dez",
)
MONTHS = {name: n for n, names in enumerate(_MONTH_NAMES, 1) for name in names.split()}

# Offsets in minutes of the zone abbreviations (American CST, EST, PST; British BST).
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "HST": -600,
}

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,]\d+)?)?"
_AMPM = r"(?:\s*(?P<ap>[aApP])(?:\.\s?[mM]\.?|[mM](?![A-Za-z])))?"
_ZONE = r"(?:\s*(?P<off>[+-]\d{2}:?\d{2}|[+-]\d{2}(?!\d)|[zZ](?![A-Za-z]))?\s*(?:\[(?P<br>[A-Za-z_/+\-0-9]+)\]|\(?(?P<zone>[A-Za-z]+/[A-Za-z_]+(?:/[A-Za-z_]+)?|[A-Z]{2,5})\)?)?)"
_CLOCK = rf"(?:,?\s+|[Tt]|,\s*)(?:(?:at|um|à|a las)\s+)?{_TIME}(?:\s*Uhr)?{_AMPM}{_ZONE}"
_WORD = r"[^\W\d_]{3,10}"
_FORMS = [
    ("iso", re.compile(rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})(?:{_CLOCK})?")),
    ("iso_slash", re.compile(rf"(?P<y>\d{{4}})[/.](?P<m>\d{{1,2}})[/.](?P<d>\d{{1,2}})(?:{_CLOCK})?")),
    ("compact", re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:[Tt ](?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,]\d+)?(?P<off>[zZ]|[+-]\d{2}:?\d{2})?)?")),
    ("year_month", re.compile(r"(?P<y>\d{4})[-/](?P<m>\d{1,2})")),
    ("year", re.compile(r"(?P<y>\d{4})")),
    ("day_name", re.compile(rf"(?:{_WORD}\.?,?\s+)?(?P<d>\d{{1,2}})(?:\.|st|nd|rd|th|er)?\s+(?:de\s+)?(?P<mon>{_WORD})\.?,?\s+(?:del?\s+)?(?P<y>\d{{4}})(?:{_CLOCK})?")),
    ("name_day", re.compile(rf"(?:{_WORD}\.?,?\s+)?(?P<mon>{_WORD})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})(?:{_CLOCK})?")),
    ("year_name", re.compile(rf"(?P<y>\d{{4}})\s+(?P<mon>{_WORD})\.?(?:\s+(?P<d>\d{{1,2}}))?(?:\s*[-–/]\s*(?:\d{{4}}\s+)?(?:{_WORD}|\d{{1,2}})\.?(?:\s+\d{{1,2}})?)?")),
    ("name_year", re.compile(rf"(?P<mon>{_WORD})\.?(?:\s*[-–/]\s*{_WORD}\.?)?,?\s+(?:de\s+)?(?P<y>\d{{4}})")),
    ("cjk", re.compile(rf"(?P<y>\d{{4}})\s*年\s*(?P<m>\d{{1,2}})\s*月(?:\s*(?P<d>\d{{1,2}})\s*日)?(?:{_CLOCK})?")),
]
_NUMERIC = re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[/.-])(?P<b>\d{{1,2}})(?P=sep)(?P<c>\d{{4}}|\d{{2}})(?:{_CLOCK})?")
_EPOCH_NUMBER = re.compile(r"\d{9,10}|\d{12,13}")


@lru_cache(maxsize=512)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None


def _offset(g: dict, local: datetime, home: str) -> timedelta | None:
    """The offset from UTC of a local time; None where a zone is named that nobody knows."""
    off = g.get("off")
    if off:
        if off in "zZ":
            return timedelta(0)
        digits = off[1:].replace(":", "").ljust(4, "0")
        minutes = int(digits[:2]) * 60 + int(digits[2:])
        if minutes > 18 * 60 or int(digits[2:]) > 59:
            return None
        return timedelta(minutes=-minutes if off[0] == "-" else minutes)
    name = g.get("br") or g.get("zone")
    if name and name.upper() in ABBREVIATIONS:
        return timedelta(minutes=ABBREVIATIONS[name.upper()])
    zone = _zone(name or home)
    # fold=0: the first of two equal local times, and the offset before the change for a skipped one
    return zone.utcoffset(local) if zone else None


def _reading(form: str, g: dict, y: int, m: int, d: int | None, home: str) -> tuple[str, int, str] | None:
    if not 1 <= m <= 12 or not 1900 <= y <= 2100 or (d is not None and not 1 <= d <= monthrange(y, m)[1]):
        return None
    if g.get("h") is None or d is None:
        at = datetime(y, m, d or 1)
        return form, int((at - _EPOCH).total_seconds()), f"{y:04d}-{m:02d}-{d:02d}" if d else f"{y:04d}-{m:02d}"
    h, mi, s = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
    if g.get("ap"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if g["ap"] in "pP" else 0)
    if h > 23 or mi > 59 or s > 60:
        return None
    local = datetime(y, m, d, h, mi, min(s, 59))
    offset = _offset(g, local, home)
    if offset is None:
        return None
    at = local - offset
    return form, int((at - _EPOCH).total_seconds()), at.strftime("%Y-%m-%dT%H:%M:%SZ")


def readings(value: str | None, home_zone: str) -> list[tuple[str, int, str]]:
    """All valid readings of ``value``, in a fixed order; empty for null, blank, wordy or impossible values."""
    text = value.strip() if value else ""
    if not text or not any(c.isdigit() for c in text):
        return []
    if _EPOCH_NUMBER.fullmatch(text):
        second = int(text) if len(text) <= 10 else int(text) // 1000
        at = datetime.fromtimestamp(second, timezone.utc)
        return [("epoch", second, at.strftime("%Y-%m-%dT%H:%M:%SZ"))]
    if match := _NUMERIC.fullmatch(text):
        g = match.groupdict()
        a, b, c = int(g["a"]), int(g["b"]), int(g["c"])
        year = c if len(g["c"]) == 4 else 2000 + c if c < 70 else 1900 + c
        found = [_reading("day_month_year", g, year, b, a, home_zone), _reading("month_day_year", g, year, a, b, home_zone)]
        if len(g["c"]) == 2 and len(g["a"]) == 2:
            found.append(_reading("short_year_month_day", g, 2000 + a, b, c, home_zone))
        return [x for x in found if x]
    for form, pattern in _FORMS:
        if match := pattern.fullmatch(text):
            g = match.groupdict()
            month = MONTHS.get(g["mon"].lower()) if g.get("mon") else int(g["m"]) if g.get("m") else None
            if month is None:
                if form == "year" and 1900 <= int(g["y"]) <= 2100:
                    return [(form, int((datetime(int(g["y"]), 1, 1) - _EPOCH).total_seconds()), g["y"])]
                continue
            one = _reading(form, g, int(g["y"]), month, int(g["d"]) if g.get("d") else None, home_zone)
            return [one] if one else []
    return []
