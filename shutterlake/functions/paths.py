"""Paths and names as Spark columns (JVM side; only canonical Unicode composition needs ``functions.text``)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of photographs and sidecars, and names that are never photographs.
RAW_EXTENSIONS = "ari cr3 cr2 crw erf raf 3fr kdc dcs dcr iiq mos mef mrw nef nrw orf rw2 pef srw arw srf sr2 dng".split()
BITMAP_EXTENSIONS = "jpg jpeg png webp tif tiff heif heic avif".split()
SIDECAR_EXTENSIONS = "xmp aae thm lrv dop pp3".split()
SYSTEM_FILES = ["thumbs.db", "desktop.ini", ".ds_store", ".localized", "ehthumbs.db", "icon\r"]
SYSTEM_DIRS = ["$recycle.bin", "recycler", "system volume information", "$windows.~ws", "$windows.~bt", ".trash", ".trashes", ".spotlight-v100", ".fseventsd", ".documentrevisions-v100"]
CATALOG_FILE = "catalog.db"


def normalise_path(p: Column) -> Column:
    """``/`` as separator, repeated ones collapsed; a UNC prefix and a drive root stay."""
    slashed = F.regexp_replace(p, r"\\", "/")
    unc = slashed.startswith("//")
    flat = F.regexp_replace(slashed, "/+", "/")
    trimmed = F.when((F.length(flat) > 1) & ~flat.rlike("^[A-Za-z]:/$"), F.regexp_replace(flat, "/$", "")).otherwise(flat)
    return F.when(unc, F.concat(F.lit("/"), trimmed)).otherwise(trimmed)


def file_name(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def parent(p: Column) -> Column:
    """Everything before the last ``/``; '' for a bare name."""
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.when(p.isNotNull(), ""))


def extension(p: Column) -> Column:
    """Lower case, without the dot; '' for none, for leading-dot names and for a trailing dot."""
    return F.lower(F.regexp_extract(file_name(p), r"^.+\.([^.]+)$", 1))


def stem(p: Column) -> Column:
    return F.regexp_replace(file_name(p), r"^(.+)\.[^.]*$", "$1")


def strip_raw_dir(d: Column) -> Column:
    """A directory without a last segment ``_RAW`` (any case)."""
    return F.regexp_replace(d, r"(?i)(^|/)_raw$", "")


def pair_key(p: Column) -> Column:
    """What a raw file and its bitmap have in common: directory and stem, in lower case."""
    return F.lower(F.concat_ws("/", strip_raw_dir(parent(p)), stem(p)))


def kind(ext: Column) -> Column:
    e = F.lower(ext)
    return F.when(e.isin(RAW_EXTENSIONS), "raw").when(e.isin(BITMAP_EXTENSIONS), "bitmap").when(e.isin(SIDECAR_EXTENSIONS), "sidecar").otherwise("other")


def junk_kind(p: Column) -> Column:
    """Why a name is never a photograph: ``stream`` (of another file), ``system``, ``temporary`` or ``catalog``; null for others."""
    n = F.lower(F.regexp_extract(p, r"[^/\\]*$", 0))
    return (
        F.when(F.contains(n, F.lit(":")), "stream")
        .when(n.isin(SYSTEM_FILES + SYSTEM_DIRS) | n.startswith("._"), "system")
        .when(n.startswith("~$") | n.endswith(".tmp") | n.startswith(".goutputstream-"), "temporary")
        .when((n == CATALOG_FILE) | n.startswith(CATALOG_FILE + "-"), "catalog")
    )


def is_junk(p: Column) -> Column:
    return junk_kind(p).isNotNull()


def natural_key(s: Column) -> Column:
    """A sort key that orders digit runs by value, letters without case, then the raw text.

    Each run of digits is written without leading zeros behind its length, so any length compares right.
    """
    runs = F.regexp_extract_all(F.lower(s), F.lit(r"(\d+|\D+)"), 1)
    coded = F.transform(
        runs,
        lambda r: F.when(r.rlike(r"^\d"), F.format_string("0%05d%s", F.length(F.regexp_replace(r, "^0+(?=.)", "")), F.regexp_replace(r, "^0+(?=.)", ""))).otherwise(F.concat(F.lit("1"), r)),
    )
    return F.concat(F.array_join(coded, "\x01"), F.lit("\x00"), s)


#: The variables of a path template, longest first, and the prefix of a sequence number.
TEMPLATE_VARS, SEQUENCE = ["FILENAME", "CMONTH", "CYEAR", "CWEEK", "BRAND", "MODEL", "CDAY"], "SEQ"


def parse_template(template: str) -> list[tuple[str, str | int]]:
    """A template's parts: ("text", literal), ("var", name) or ("seq", digits). A variable is ``:NAME``, a sequence number ``:SEQ`` and as many zeros as digits."""
    parts: list[tuple[str, str | int]] = []
    for m in re.finditer(rf":(?:({'|'.join(TEMPLATE_VARS)})|{SEQUENCE}(0+))|(:|[^:]+)", template):
        if m[1]:
            parts.append(("var", m[1]))
        elif m[2]:
            parts.append(("seq", len(m[2])))
        else:
            if m[3] == ":":
                raise ValueError(f"unknown variable at {template[m.start() :]!r}")
            parts.append(("text", m[3]))
    return parts


def render(template: str, *, when: Column, name: Column, brand: Column, model: Column, seq: Column) -> Column:
    """A template filled in: missing dates are zeros, missing brands and models ``Unknown``; a number longer than its digits widens."""
    date = lambda f, none: F.coalesce(F.date_format(when, f), F.lit(none))
    word = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("Unknown"))
    values = {
        "CYEAR": date("yyyy", "0000"), "CMONTH": date("MM", "00"), "CDAY": date("dd", "00"), "CWEEK": F.when(when.isNull(), "00").otherwise(F.format_string("%02d", F.weekofyear(when))),
        "FILENAME": F.coalesce(name, F.lit("")), "BRAND": word(brand), "MODEL": word(model),
    }
    one = {"text": F.lit, "var": values.get, "seq": lambda width: F.format_string(f"%0{width}d", seq)}
    return F.concat(*[one[kind](value) for kind, value in parse_template(template)], F.lit(""))


def path_problem(p: Column, longest: int = 255) -> Column:
    """Why a relative output path is not acceptable, or null."""
    segments = F.split(p, "/")
    return (
        F.when(p.isNull() | (F.trim(p) == ""), "empty")
        .when(p.rlike(r'[<>:"|?*\\\x00-\x1f]'), "illegal character")
        .when(F.exists(segments, lambda s: s == ""), "empty segment")
        .when(F.exists(segments, lambda s: s.isin(".", "..")), "relative segment")
        .when(F.exists(segments, lambda s: F.length(s) > longest), "long segment")
        .when(F.exists(segments, lambda s: s.rlike(r"[. ]$")), "segment ends in dot or blank")
    )
