"""Scalar functions: dates from texts and file names, hashes, labels, colours, match scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The offset basis and prime of 64-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
COLORS = ["red", "yellow", "green", "cyan", "blue", "purple"]
MEBIBYTE = 1 << 20


def fnv1a(data: bytes) -> int:
    h = FNV_BASIS
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


@F.pandas_udf(T.StringType())
def fnv1a_hex(s: pd.Series) -> pd.Series:
    """64-bit FNV-1a of the UTF-8 text, as 16 hex digits; all texts of a batch a byte at a time."""
    known = s.notna().to_numpy()
    raw = [x.encode("utf-8", "surrogatepass") for x in s[known]]
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    data, starts = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64), np.concatenate([[0], np.cumsum(lengths)])[:-1]
    h, left = np.full(len(raw), FNV_BASIS, dtype=np.uint64), np.argsort(-lengths, kind="stable")
    for i in range(int(lengths.max(initial=0))):
        left = left[: np.searchsorted(-lengths[left], -i, side="left")]
        h[left] = (h[left] ^ data[starts[left] + i]) * np.uint64(FNV_PRIME)
    out = np.full(len(s), None, dtype=object)
    out[known] = [f"{x:016x}" for x in h.tolist()]
    return pd.Series(out)


def sampled_sha256(content: Column, piece: int = MEBIBYTE) -> Column:
    """SHA-256 of a binary: of all of it up to three pieces, else of its size (8 bytes, little endian), head, middle and tail."""
    n = F.length(content)
    size = F.unhex(F.regexp_replace(F.lpad(F.hex(n), 16, "0"), "(..)(..)(..)(..)(..)(..)(..)(..)", "$8$7$6$5$4$3$2$1"))
    part = lambda start: F.substring(content, start + 1, piece)
    return F.when(n <= 3 * piece, F.sha2(content, 256)).otherwise(F.sha2(F.concat(size, part(F.lit(0)), part(F.floor((n - piece) / 2).cast("int")), part(n - piece)), 256))


def exif_datetime(s: Column) -> Column:
    """``YYYY:MM:DD HH:MM:SS`` as milliseconds of that local time; zero dates, other forms and dates that don't exist are null."""
    t = F.try_to_timestamp(F.regexp_extract(s, r"^\s*(\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2})", 1), F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.unix_millis(t)


def name_datetime(name: Column) -> Column:
    """Milliseconds of the first date in a file name (compact or separated, with a time or at midnight) that exists."""
    found = F.regexp_extract_all(name, F.lit(r"(?<!\d)((?:19|20)\d{2}[-_.]?\d{2}[-_.]?\d{2}(?:[-_ T]?\d{2}[-_.]?\d{2}[-_.]?\d{2})?)(?!\d)"), 1)
    digits = F.transform(found, lambda x: F.rpad(F.regexp_replace(x, r"\D", ""), 14, "0"))
    times = F.transform(digits, lambda x: F.unix_millis(F.try_to_timestamp(x, F.lit("yyyyMMddHHmmss"))))
    return F.get(F.filter(times, lambda t: t.isNotNull()), F.lit(0))


def resolve_taken_at(exif: Column, name: Column, created: Column, modified: Column) -> Column:
    """The first known of the capture times, with its source."""
    one = lambda t, s: F.when(t.isNotNull(), F.struct(t.alias("taken_at"), F.lit(s).alias("taken_at_source")))
    return F.coalesce(one(exif, "exif"), one(name, "filename"), one(created, "file_created"), one(modified, "file_mtime"))


def label_out(c: Column) -> Column:
    return F.when(F.lower(c).isin(COLORS), F.initcap(c))


def label_in(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).isin(COLORS), F.lower(F.trim(c)))


def chroma(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Luma in 0..1 and the two chroma axes in -0.5..0.5 of encoded red, green and blue."""
    clamp = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    y = r * 0.2126 + g * 0.7152 + b * 0.0722
    return clamp(y, 0.0, 1.0), clamp((b - y) / 1.8556, -0.5, 0.5), clamp((r - y) / 1.5748, -0.5, 0.5)


#: Digits of ids that sort as numbers do.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def sortable_id(millis: Column, *seed: Column) -> Column:
    """16 characters that sort by time: nine digits of base 62 for hundredths of milliseconds, seven of a hash of the seed."""
    digit = lambda n, i: F.substring(F.lit(BASE62), F.pmod(F.floor(n / F.lit(62**i).cast("decimal(20,0)")), F.lit(62).cast("decimal(20,0)")).cast("int") + 1, F.lit(1))
    ticks = F.greatest(F.lit(0), millis).cast("decimal(20,0)") * 100
    noise = F.pmod(F.xxhash64(*seed), F.lit(62**7)).cast("decimal(20,0)")
    return F.concat(*[digit(ticks, i) for i in range(8, -1, -1)], *[digit(noise, i) for i in range(6, -1, -1)])


def band_weight(distance: Column, inner: float, outer: float) -> Column:
    """1 up to ``inner``, 0 from ``outer`` on, smooth in between."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (distance - inner) / (outer - inner)))
    return F.lit(1.0) - t * t * (3 - 2 * t)


def subsequence_score(text: Column, typed: Column) -> Column:
    """How well the characters of ``typed`` occur in order in ``text``, both in lower case: -1 if they don't, 0 for nothing typed.

    A character counts 10, 5 more for each in a row with it, 8 more at the start of a word; the place of the first is taken off, at most 20.
    """
    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("streak"), F.lit(0).alias("matched"), F.lit(-1).alias("first"))

    def step(s: Column, i: Column) -> Column:
        hit = (s["matched"] < F.length(typed)) & (F.substring(text, i, F.lit(1)) == F.substring(typed, s["matched"] + 1, F.lit(1)))
        word = (i == 1) | F.substring(text, i - 1, F.lit(1)).rlike(r"[\s·/\\|,.\-_:]")
        streak = F.when(hit, s["streak"] + 1).when(s["matched"] < F.length(typed), F.lit(0)).otherwise(s["streak"])
        return F.struct(
            F.when(hit, s["score"] + 10 + 5 * (s["streak"] + 1) + F.when(word, 8).otherwise(0)).otherwise(s["score"]).alias("score"), streak.alias("streak"),
            F.when(hit, s["matched"] + 1).otherwise(s["matched"]).alias("matched"), F.when(hit & (s["first"] < 0), i - 1).otherwise(s["first"]).alias("first"),
        )

    def end(s: Column) -> Column:
        return F.when(s["matched"] < F.length(typed), -1).otherwise(s["score"] - F.least(s["first"], F.lit(20)))

    scored = F.aggregate(F.sequence(F.lit(1), F.length(text)), start, step, end)
    return F.when(F.length(typed) == 0, 0).when(F.length(text) < F.length(typed), -1).otherwise(scored)


def match_score(typed: str, title: Column, ident: Column | None = None, group: Column | None = None, keywords: list[Column] = ()) -> Column:
    """How well an entry fits what was typed; null if not at all, 0 if nothing was typed.

    1000 for an equal title; 800 less what a title is longer (at most 100) if it starts so; else the best subsequence score of title, id and
    keywords (both times 0.7) and group (times 0.5). A text typed with spaces is tried without them too.
    """
    raw = typed.strip().lower()
    if not raw:
        return F.lit(0.0)
    needles = [raw, "".join(raw.split())] if " " in raw else [raw]
    t = F.lower(title)
    weighted = [(ident, 0.7), (group, 0.5), *[(k, 0.7) for k in keywords]]

    def one(n: str) -> Column:
        score = lambda c, w: F.when(c.isNull(), -1.0).otherwise(F.when(subsequence_score(F.lower(c), F.lit(n)) < 0, -1.0).otherwise(subsequence_score(F.lower(c), F.lit(n)) * w))
        best = F.greatest(score(title, 1.0), *[score(c, w) for c, w in weighted if c is not None], F.lit(-1.0))
        return F.when(t == n, 1000.0).when(t.startswith(n), 800.0 - F.least(F.length(t) - len(n), F.lit(100))).otherwise(best)

    best = F.greatest(*[one(n) for n in needles], F.lit(-1.0))
    return F.when(best >= 0, best)


def recent_boost(ident: Column, recent: list) -> Column:
    """20 for the entry used last, 3 less for each before it, never below 0."""
    place = F.array_position(F.array(*map(F.lit, recent)), ident) if recent else F.lit(0)
    return F.when(place > 0, F.greatest(F.lit(0), F.lit(20) - 3 * (place - 1))).otherwise(0)


def clean_name(c: Column, most: int = 64) -> Column:
    """A tag's name without blanks at the ends; null for an empty one and one of more than ``most`` characters."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when((F.length(t) >= 1) & (F.length(t) <= most), t)


def utc_format(millis: Column, form: str) -> Column:
    """Milliseconds as UTC text whatever the session's zone: ``compact`` (20260915-143002Z), ``human`` (2026-09-15 14:30:02 UTC) or ``iso`` (2026-09-15T14:30:02Z)."""
    seconds = F.floor(millis / F.lit(1000))
    day = F.date_from_unix_date(F.floor(seconds / F.lit(86400)).cast("int")).cast("string")
    of_day = F.pmod(seconds, F.lit(86400))
    clock = [F.floor(of_day / F.lit(3600)), F.pmod(F.floor(of_day / F.lit(60)), F.lit(60)), F.pmod(of_day, F.lit(60))]
    if form == "compact":
        return F.concat(F.replace(day, F.lit("-"), F.lit("")), F.format_string("-%02d%02d%02dZ", *clock))
    return F.concat(day, F.format_string({"human": " %02d:%02d:%02d UTC", "iso": "T%02d:%02d:%02dZ"}[form], *clock))


def marking_problem(rating: Column, color: Column, like: Column, lock: Column) -> Column:
    """The first marking that isn't allowed, or null: ratings 0 to 5, six colours, like or dislike, locks 0 to 2; nulls are allowed but for the rating and the lock."""
    return (
        F.when(rating.isNull() | ~rating.between(0, 5), "rating")
        .when(color.isNotNull() & ~color.isin(COLORS), "color")
        .when(like.isNotNull() & ~like.isin("like", "dislike"), "like")
        .when(lock.isNull() | ~lock.between(0, 2), "lock")
    )


def is_under(path: Column, directory: str, subdirectories: bool) -> Column:
    """Whether a path lies in a directory, directly or at any depth; '' is the root."""
    base = directory.strip("/") + "/" if directory.strip("/") else ""
    below = path.startswith(base)
    return below if subdirectories else below & ~F.contains(F.substring(path, len(base) + 1, 1 << 30), F.lit("/"))
