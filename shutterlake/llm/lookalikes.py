"""Problem 7: text that looks the same in one form.

A transducer reads a text once, grapheme cluster by grapheme cluster, takes the longest entry of a
compiled mapping at each place and writes what the entry says. The mapping is built from the Unicode
data of ``unicodedata`` (widths, ligatures, radicals, spaces, invisible characters, letter case) and
from the lists of look-alikes below, and is checked for conflicts before use.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.session import cut

# Characters that can't be told apart by eye from the first of their line, by script.
LOOKALIKES = {
    "a": "Аа Α ɑ", "b": "В Β", "c": "Сс Ϲϲ ⅽ", "d": "ԁ", "e": "Ее Ε", "f": "Ϝ", "g": "ɡ", "h": "Н Η һ", "i": "Іі Ι", "j": "Јј ϳ",
    "k": "К Κ К", "l": "ⅼ", "m": "М Μ", "n": "Ν", "o": "Оо Οο Օօ", "p": "Рр Ρρ", "q": "ԛ", "s": "Ѕѕ Տ", "t": "Т Τ", "u": "Սս",
    "v": "Ѵѵ", "w": "Ԝԝ", "x": "Хх Χ", "y": "Уу Υ Ү", "z": "Ζ",
    "-": "‐ ‑ ﹣ −", "・": "･", "ー": "一", "カ": "力", "ロ": "口", "ニ": "二", "エ": "工", "ト": "卜", "タ": "夕", "ハ": "八", "ヘ": "へ",
    "’": "ʼ", ";": ";", "/": "⁄ ∕", ":": "∶",
}
# The same for the capitals of three more scripts, as pairs of a basic letter and its double.
CHEROKEE = "AᎪ CᏟ DᎠ EᎬ GᏀ HᎻ JᎫ KᏦ LᏞ MᎷ PᏢ RᎡ SᏚ TᎢ VᏙ WᎳ ZᏃ"
COPTIC = "BⲂ CⲤ HⲎ IⲒ KⲔ MⲘ NⲚ OⲞ PⲢ TⲦ XⲬ"
LISU = "AꓮBꓐ CꓚDꓓ EꓰFꓝ GꓖHꓧ IꓲJꓙ KꓗLꓡ MꓟNꓠ OꓳPꓑ RꓣSꓢ TꓔUꓴ VꓦWꓪ XꓫYꓬ ZꓜAꓮ"
# Candidates that are refused, because with letter case aside they would join two basic characters or are told apart.
DISPUTED = {"v": "ν", "l": "Ӏ", "i": "Ӏ"}
#: Decomposition tags that change only width, line breaking or the look of a whole font.
TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<small>")
#: Blocks whose compatibility decompositions look like what they decompose to: ligatures, radicals, Roman numerals.
SAME_BLOCKS = ((0xFB00, 0xFB06), (0x2E80, 0x2FD5), (0x2160, 0x217F), (0x2000, 0x200A))
#: Seen by nobody, though their category is not Cf.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
BLANKS = {0x2800, 0x3164, 0xFFA0}


@lru_cache(maxsize=1)
def repertoire() -> str:
    """Characters that may have a mapping: all but the ideographs and empty planes beyond the first two."""
    return "".join(map(chr, (*range(0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0))))


class Conflict(ValueError):
    """A mapping that would make two basic Latin letters or digits look the same."""


def _lower(c: str) -> str:
    low = c.lower()
    return "σ" if low == "ς" else low if len(low) == 1 else c


def _classes(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Representatives of the classes that ``pairs`` and letter case join; raises ``Conflict``."""
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while (p := parent.get(c, c)) != c:
            c = p
        return c

    def join(a: str, b: str) -> None:
        a, b = root(a), root(b)
        basic = [x for x in (a, b) if x.isascii() and x.isalnum()]
        if a != b and len(basic) == 2:
            raise Conflict(f"{a!r} and {b!r} would look the same")
        if a != b:
            keep = basic[0] if basic else a
            parent[a], parent[b] = keep, keep

    for a, b in pairs:
        join(_lower(a), _lower(b))
    return {c: root(c) for c in parent}


def _decomposed(c: str) -> str | None:
    d = unicodedata.decomposition(c)
    if not d:
        return None
    tag, _, rest = d.rpartition("> ")
    if tag and f"{tag}>" not in TAGS and not any(lo <= ord(c) <= hi for lo, hi in SAME_BLOCKS):
        return None
    if not tag and len(rest.split()) > 1:
        return None  # accents stay on their letter
    return "".join(chr(int(x, 16)) for x in rest.split())


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Single characters and what they become; characters it lacks stay (in lower case)."""
    pairs = [(first, c) for first, others in LOOKALIKES.items() for c in others.replace(" ", "")]
    for script in (CHEROKEE, COPTIC, LISU):
        flat = script.replace(" ", "")
        pairs += list(zip(flat[::2].lower(), flat[1::2]))
    looks = _classes(pairs)
    table: dict[str, str] = {}
    for c in repertoire():
        o = ord(c)
        kind = unicodedata.category(c)
        if kind in ("Cs", "Co", "Cn") and o not in INVISIBLE:
            continue
        if o in BLANKS or kind in ("Zs", "Zl", "Zp") or c in "\t\n\x0b\x0c\r\x85":
            table[c] = " "
        elif kind in ("Cf", "Cc") or o in INVISIBLE:
            table[c] = ""
        elif (d := _decomposed(c)) is not None:
            table[c] = d
    for _ in range(4):  # decompositions of decompositions
        table = {c: "".join(table.get(x, x) for x in d) for c, d in table.items()}

    def last(c: str) -> str:
        low = _lower(c)
        return looks.get(low, low)

    table = {c: "".join(last(x) for x in d) for c, d in table.items()}
    table |= {c: last(c) for c in (*looks, *(x.upper() for x in looks), "ς") if len(c) == 1 and c not in table}
    for c in map(chr, range(0x21, 0x7F)):
        if table.get(c, c.lower()) != c.lower():
            raise Conflict(f"{c!r} would become {table[c]!r}")
    return table


def _composed(text: str) -> str:
    """The form of a short sequence: marks apart, each character mapped, composed again."""
    table = mapping()
    return unicodedata.normalize("NFC", "".join(table.get(c, c.lower()) for c in unicodedata.normalize("NFD", text)))


@lru_cache(maxsize=1)
def transducer() -> tuple[dict[str, str], int]:
    """Sequences of up to three characters and what they become, and the longest sequence.

    Beside the single characters it has every base and its marks that compose, with each base and mark in all
    their variants: a half-width letter with a half-width voicing mark, a look-alike with an accent.
    """
    table = mapping()
    variants: dict[str, list[str]] = {}
    for c in {*table, *(c for c in repertoire() if c != c.lower())}:
        if len(form := table.get(c, c.lower())) == 1:
            variants.setdefault(form, []).append(c)
    entries = dict(table)
    for c in repertoire():
        apart = unicodedata.normalize("NFD", c)
        if apart == c or 0xAC00 <= ord(c) <= 0xD7A3:
            continue
        entries[c] = _composed(c)
        if 2 <= len(apart) <= 3:
            kinds = [{x, *variants.get(table.get(x, x.lower()), ())} for x in apart]
            for seq in map("".join, product(*kinds)):
                entries[seq] = entries[c]
    return entries, max(map(len, entries))


_CLUSTER = regex.compile(r"\X")


@lru_cache(maxsize=1 << 16)
def _cluster(g: str) -> str:
    """What a grapheme cluster becomes: at each place the longest entry holds."""
    entries, longest = transducer()
    out, i = [], 0
    while i < len(g):
        for n in range(min(longest, len(g) - i), 0, -1):
            if (to := entries.get(g[i : i + n])) is not None:
                break
        else:
            n, to = 1, g[i].lower()
        out.append(to)
        i += n
    return "".join(out)


@lru_cache(maxsize=1)
def _ascii() -> dict[int, str | None]:
    return {o: mapping().get(chr(o), chr(o).lower()) for o in range(128)}


def canonical(text: str | None) -> str | None:
    """The one form of ``text``; texts that look the same have the same form. Null stays null."""
    if text is None:
        return None
    if text.isascii():
        return text.translate(_ascii()).strip(" ")
    return unicodedata.normalize("NFC", "".join(map(_cluster, _CLUSTER.findall(text)))).strip(" ")


def _canonical_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    transducer()
    for s in batches:
        yield s.map(canonical, na_action="ignore")


def canonical_text(text: Column | str) -> Column:
    """``canonical`` on a column, in Arrow batches."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _canonical_batches(batches)

    return run(text)


def canonical_names(tags: DataFrame, *, name: str = "name", folded: str = "name_folded") -> DataFrame:
    """``tags`` with ``folded`` set anew to the canonical form of ``name`` and ``folded_changed``.

    Null names give null; empty names and names without a visible character give ''. An existing
    ``folded`` is replaced, ``folded_changed`` says whether it was stale or null (null-safe).
    """
    old = F.col(folded) if folded in tags.columns else F.lit(None).cast("string")
    return tags.withColumn("__c", canonical_text(name)).withColumn("folded_changed", ~old.eqNullSafe(F.col("__c"))).withColumn(folded, F.col("__c")).drop("__c")


def _forms(tags: DataFrame, key: str, name: str) -> DataFrame:
    """(id, form), distinct, of tags whose form others have too."""
    t = tags.where(F.col(name).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), canonical_text(name).alias("form"))
    t = cut(t, "forms").distinct()
    shared = t.groupBy("form").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_tags")).where("n_tags > 1")
    return t.join(shared, "form")


def lookalike_pairs(tags: DataFrame, *, key: str, name: str) -> DataFrame:
    """(tag_a, tag_b) with tag_a < tag_b of all tags whose canonical names are equal.

    The result lists pairs, so it grows with the square of a group of equal names; the work before
    does not. Null names pair with nothing; repeated keys count once per name; equal names pair too.
    """
    t = _forms(tags, key, name).select("id", "form")
    a, b = t.withColumnRenamed("id", "tag_a"), t.withColumnRenamed("id", "tag_b")
    return a.join(b, "form").where("tag_a < tag_b").select("tag_a", "tag_b").distinct()


def lookalike_classes(tags: DataFrame, *, key: str, name: str) -> DataFrame:
    """(class_id, tag_id, n_tags): each tag whose canonical name others have, with the least tag of that name and their number.

    The linear form of ``lookalike_pairs``: two tags are a pair if and only if they have a class in common.
    """
    return _forms(tags, key, name).select("class_id", F.col("id").alias("tag_id"), "n_tags")
