"""Parsing of one spelling of a point in time into microseconds since 1970-01-01 UTC.

Defined results: a value that denotes no instant, or more than one, gives None. That holds for null, blank and
relative values, impossible dates, local times that occur twice or never, and local times without a zone.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1)

#: Month names by number, in English, German, French, Spanish and Russian (genitive and nominative).
MONTH_NAMES = {
    1: "january jan januar jänner janvier enero января январь",
    2: "february feb februar février fevrier febrero февраля февраль",
    3: "march mar märz maerz mars marzo марта март",
    4: "april apr avril abril апреля апрель",
    5: "may mai mayo мая май",
    6: "june jun juni juin junio июня июнь",
    7: "july jul juli juillet julio июля июль",
    8: "august aug août aout agosto августа август",
    9: "september sep sept septembre septiembre setiembre сентября сентябрь",
    10: "october oct oktober okt octobre octubre октября октябрь",
    11: "november nov novembre noviembre ноября ноябрь",
    12: "december dec dezember dez décembre decembre diciembre декабря декабрь",
}
MONTHS = {name: number for number, names in MONTH_NAMES.items() for name in names.split()}

#: Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "met": 60, "mest": 120,
    "eet": 120, "eest": 180, "msk": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "jst": 540, "kst": 540, "hkt": 480, "sgt": 480,
    "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780, "sast": 120,
    "brt": -180, "art": -180, "nst": -210, "ndt": -150, "ast": -240, "adt": -180,
}

_CLOCK = r"(?P<H>\d{1,2})[:hH](?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[ap])\.?\s?m\.?)?"
_ZONE = r"(?:\s*(?P<z>Z|[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,5}(?:[+-]\d{1,2}(?::?\d{2})?)?)(?![\w/]))?(?:\s*\(\w+\))?(?:\s*\[(?P<id>[A-Za-z_+\-/0-9]+)\])?"
_TAIL = rf"(?:[\sTt]+|\s*,\s*|\s+(?:at|um|à|a\s+las|в)\s+){_CLOCK}(?:\s*Uhr)?{_ZONE}"
_DAY = r"(?:[^\W\d_]{2,12}\.?,?\s+)?"
_SHAPES = tuple(
    re.compile(x + "$", re.IGNORECASE)
    for x in (
        rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})(?:{_TAIL})?",
        rf"(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)T(?P<H>\d\d)(?P<M>\d\d)(?:(?P<S>\d\d)(?:[.,](?P<f>\d+))?)?(?P<ap>)?{_ZONE}",
        rf"(?P<y>\d{{4}})/(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}})(?:{_TAIL})?",
        rf"(?P<a>\d{{1,2}})(?P<sep>[/.\-])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}})(?:{_TAIL})?",
        rf"{_DAY}(?P<d>\d{{1,2}})(?:\.|er|st|nd|rd|th)?[\s\-]+(?:de\s+|of\s+)?(?P<n>[^\W\d_]{{3,12}})\.?,?[\s\-]+(?:de\s+)?(?P<y>\d{{4}}|\d{{2}})(?:\s*г\.?)?(?:{_TAIL})?",
        rf"{_DAY}(?P<n>[^\W\d_]{{3,12}})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})(?:{_TAIL})?",
        rf"{_DAY}(?P<n>[^\W\d_]{{3,12}})\s+(?P<d>\d{{1,2}})\s+{_CLOCK}{_ZONE}\s+(?P<y>\d{{4}})",
    )
)


@lru_cache(maxsize=1024)
def _zone(name: str):
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001  unknown or malformed names
        return None


def _micros(moment: datetime) -> int:
    return (moment - EPOCH) // timedelta(microseconds=1)


def _local(moment: datetime, zone: str | None) -> int | None:
    """The instant of a local time, None when the zone is unknown or the time occurs twice or never."""
    info = _zone(zone) if zone else None
    if info is None:
        return None
    try:
        one, two = (moment.replace(tzinfo=info, fold=k).astimezone(timezone.utc) for k in (0, 1))
    except OverflowError:
        return None
    return _micros(one.replace(tzinfo=None)) if one == two else None


def _offset(text: str) -> int | None:
    """Minutes of an offset such as +0530, -05:00 or +02, or of an abbreviation."""
    low = text.lower()
    if low[0] not in "+-":
        cut = re.match(r"[a-z]+", low).group()
        base = ABBREVIATIONS.get(cut)
        if base is None or cut == low:
            return base
        return _offset(low[len(cut):]) if cut in ("utc", "gmt") else None
    digits = low[1:].replace(":", "")
    hours, minutes = (int(digits[:-2]), int(digits[-2:])) if len(digits) > 2 else (int(digits), 0)
    if hours > 14 or minutes > 59:
        return None
    return (hours * 60 + minutes) * (-1 if low[0] == "-" else 1)


def parse_instant(raw: str | None, zone: str | None, order: str | None) -> int | None:
    """Microseconds since 1970-01-01 UTC of ``raw``. ``zone`` is the IANA zone of values that state none, ``order``
    (DMY or MDY) the order of day and month in figures."""
    if raw is None:
        return None
    text = raw.strip().strip("​﻿").replace(" ", " ").replace(" ", " ")
    if text.isascii() and text.isdigit():
        stamp = int(text) * 1000 if len(text) == 13 else int(text) * 1_000_000
        return stamp if stamp < 253_402_300_800_000_000 else None
    for shape in _SHAPES:
        if found := shape.match(text):
            break
    else:
        return None
    part = found.groupdict()
    year = int(part["y"])
    if len(part["y"]) == 2:
        year += 2000
    if part.get("n"):
        month, day = MONTHS.get(part["n"].lower()), int(part["d"])
    elif part.get("a"):
        one, two = int(part["a"]), int(part["b"])
        if order not in ("DMY", "MDY"):
            if one != two:
                return None
            order = "DMY"
        day, month = (one, two) if order == "DMY" else (two, one)
    else:
        month, day = int(part["m"]), int(part["d"])
    if month is None:
        return None
    hour, minute, second = (int(part.get(k) or 0) for k in "HMS")
    if part.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if part["ap"].lower() == "p" else 0)
    try:
        moment = datetime(year, month, day, hour, minute, second, int((part.get("f") or "0")[:6].ljust(6, "0")))
    except ValueError:
        return None
    if part.get("z"):
        minutes = _offset(part["z"])
        return None if minutes is None else _micros(moment) - minutes * 60_000_000
    return _local(moment, part.get("id") or zone)
