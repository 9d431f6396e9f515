"""Parsing of one time reading in any notation to UTC milliseconds.

Runs once per distinct reading (see ``operators.instants``), so it may be exhaustive.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

EPOCH = datetime(1970, 1, 1)
MS = timedelta(milliseconds=1)

# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "NPT": 345, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "LHST": 630, "LHDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
MAX_OFFSET_MIN = 14 * 60
#: 100 ns ticks between 1601-01-01 and 1970-01-01.
FILETIME_UNIX = 116_444_736_000_000_000

_CLOCK = r"(?P<h>\d{1,2})[:.](?P<mi>\d{2})(?:[:.](?P<s>\d{2})(?:[.,](?P<f>\d+))?)?\s*(?P<ap>[AaPp][Mm]\b)?"
_ZONE = r"\s*(?P<zone>.*)"
_COUNT = re.compile(r"(?P<sign>-?)(?P<n>\d{9,19})(?:[.,](?P<frac>\d+))?")
_FORMS = [
    re.compile(r"(?P<y>\d{4})(?P<sep>[-:./])(?P<mo>\d{1,2})(?P=sep)(?P<d>\d{1,2})(?:[Tt]|[\s,_]+)" + _CLOCK + _ZONE, re.S),
    re.compile(r"(?P<y>\d{4})年\s*(?P<mo>\d{1,2})月\s*(?P<d>\d{1,2})日\s*(?P<zap>上午|下午)?\s*(?P<h>\d{1,2})[时時:点](?P<mi>\d{1,2})(?:[分:](?:(?P<s>\d{1,2})(?:[.,](?P<f>\d+))?秒?)?)?" + _ZONE, re.S),
    re.compile(r"(?P<mo>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4})[,\s]+" + _CLOCK + _ZONE, re.S),
    re.compile(r"(?P<d>\d{1,2})\.(?P<mo>\d{1,2})\.(?P<y>\d{4})[,\s]+" + _CLOCK + _ZONE, re.S),
    re.compile(r"(?:[A-Za-z]{3,9},?\s+)?(?P<d>\d{1,2})[\s-](?P<mon>[A-Za-z]{3})[a-z]*[\s-](?P<y>\d{4})[,\s]+" + _CLOCK + _ZONE, re.S),
    re.compile(r"(?:[A-Za-z]{3,9},?\s+)?(?P<mon>[A-Za-z]{3})[a-z]*\s+(?P<d>\d{1,2})(?:,\s*(?P<y>\d{4}))[,\s]+" + _CLOCK + _ZONE, re.S),
    re.compile(r"(?:[A-Za-z]{3}\s+)(?P<mon>[A-Za-z]{3})\s+(?P<d>\d{1,2})\s+(?P<h>\d{1,2}):(?P<mi>\d{2}):(?P<s>\d{2})\s+(?P<zone>[A-Z]*)\s*(?P<y>\d{4})", re.S),
]
_COMPACT = re.compile(r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})[Tt]?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d+))?\s*(?P<zone>(?:[Zz]|[-+]\d{2}:?\d{2})?)")
_FILE_NAME = re.compile(r".*\.[A-Za-z][A-Za-z0-9]{1,4}", re.S)
_IN_NAME = re.compile(
    r"(?<!\d)(?P<y>(?:19|20)\d{2})(?P<sep>[-._]?)(?P<mo>\d{2})(?P=sep)(?P<d>\d{2})"
    r"(?:[-._ T]|\s+at\s+)?(?P<h>\d{2})(?P<tsep>[-._:]?)(?P<mi>\d{2})(?:(?P=tsep)(?P<s>\d{2})(?:[._]?(?P<f>\d{3}))?)?(?P<zone>[Zz]?)(?!\d)"
)
_OFFSET = re.compile(r"(?:(?:UTC|GMT|UT)\s*)?(?P<sign>[-+])(?P<h>\d{1,2})(?::?(?P<m>\d{2}))?(?!\d)")
_NAMED = re.compile(r"\[?(?P<name>[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+)\]?")
_ABBR = re.compile(r"\(?(?P<a>[A-Za-z]{1,5})\)?(?![A-Za-z/])")


@lru_cache(maxsize=1)
def _zone_names() -> frozenset[str]:
    return frozenset(available_timezones())


@lru_cache(maxsize=1024)
def _zone(name: str | None) -> ZoneInfo | None:
    return ZoneInfo(name) if name and name in _zone_names() else None


def plain(text: str) -> str:
    """Width forms, minus signs and odd blanks in one form."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("−", "-").replace("‐", "-").replace("‑", "-")
    return text.strip().strip("\x00").strip()


@lru_cache(maxsize=65536)
def offset_minutes(text: str | None) -> int | None:
    """A separate offset field: minutes, or hours and minutes with a colon or four digits after a sign."""
    if text is None:
        return None
    s = re.sub(r"^(?:UTC|GMT)\s*(?=[-+])", "", plain(text), flags=re.I)
    if s.upper() in ("Z", "UTC", "GMT"):
        return 0
    if m := re.fullmatch(r"([-+]?)(\d{1,2}):(\d{2})", s) or re.fullmatch(r"([-+])(\d{2})(\d{2})", s):
        if int(m[3]) > 59:
            return None
        minutes = int(m[2]) * 60 + int(m[3])
    elif m := re.fullmatch(r"([-+]?)(\d{1,3})", s):
        minutes = int(m[2])
    else:
        return None
    return (-minutes if m[1] == "-" else minutes) if minutes <= MAX_OFFSET_MIN else None


def _zone_of(rest: str | None):
    """What a trailing zone text says: minutes, a zone, or None if it says nothing."""
    rest = (rest or "").strip()
    if not rest:
        return None
    if m := _OFFSET.match(rest):
        minutes = int(m["h"]) * 60 + int(m["m"] or 0)
        if minutes <= MAX_OFFSET_MIN and int(m["m"] or 0) < 60:
            return -minutes if m["sign"] == "-" else minutes
    if (m := _NAMED.match(rest)) and (z := _zone(m["name"])):
        return z
    if (m := _ABBR.match(rest)) and m["a"].upper() in ABBREVIATIONS:
        return ABBREVIATIONS[m["a"].upper()]
    return None


def _count(m: re.Match) -> int:
    """Milliseconds of a count since an epoch; its magnitude tells the unit."""
    n, digits = int(m["n"]), (m["frac"] or "")
    if n < 10**11:
        ms = n * 1000 + int((digits + "000")[:3])
    elif n < 10**14:
        ms = n
    elif n < 10**17:
        ms = n // 1000
    elif n < 10**18:
        ms = (n - FILETIME_UNIX) // 10_000
    else:
        ms = n // 1_000_000
    return -ms if m["sign"] else ms


def _local(g: dict) -> datetime | None:
    month = g["mo"] if g.get("mo") else MONTHS.get((g.get("mon") or "").lower())
    hour, half = int(g["h"]), (g.get("ap") or g.get("zap") or "").lower()
    if half in ("am", "pm"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (half == "pm")
    elif half == "下午":
        hour = hour + 12 if hour < 12 else hour
    elif half == "上午":
        hour = 0 if hour == 12 else hour
    try:
        return datetime(int(g["y"]), int(month or 0), int(g["d"]), hour, int(g["mi"]), int(g.get("s") or 0), int(((g.get("f") or "") + "000")[:3]) * 1000)
    except ValueError:
        return None


def parse_instant(text: str | None, offset: str | None = None, tz_name: str | None = None) -> int | None:
    """UTC milliseconds of a reading, or None if it is unusable.

    A count since an epoch is absolute. Otherwise a zone in the text holds, else the readable
    separate offset, else ``tz_name``. A local time that occurs twice is the earlier instant; one
    that is skipped is read with the offset valid before the change (``fold=0`` does both).
    """
    if text is None:
        return None
    s = plain(text)
    if not s:
        return None
    if m := _COMPACT.fullmatch(s):
        if local := _local(m.groupdict()):
            return _resolve(local, m["zone"], offset, tz_name)
    if m := _COUNT.fullmatch(s):
        return _count(m)
    for form in _FORMS:
        if (m := form.fullmatch(s)) and not _FILE_NAME.fullmatch(m["zone"] or ""):
            local = _local(m.groupdict())
            return None if local is None else _resolve(local, m["zone"], offset, tz_name)
    if _FILE_NAME.fullmatch(s):
        for m in _IN_NAME.finditer(s):
            if local := _local(m.groupdict()):
                return _resolve(local, m["zone"], offset, tz_name)
    return None


def _resolve(local: datetime, zone: str | None, offset: str | None, tz_name: str | None) -> int | None:
    at = _zone_of(zone)
    if at is None:
        at = offset_minutes(offset)
    if at is None:
        at = _zone(tz_name)
    if at is None:
        return None
    try:
        shift = timedelta(minutes=at) if isinstance(at, int) else local.replace(tzinfo=at).utcoffset()
        return (local - shift - EPOCH) // MS
    except OverflowError:
        return None
