"""The faceted query algebra over a photo catalogue: scope, filter, sort, visibility, paging, facets, suggestions.

A ``Query`` is declarative; ``Catalog`` compiles it to DataFrame expressions, so filters reach the scan and a
count never touches the files. Visibility and scope always hold; the filter's conditions are joined with
``match`` (``any`` or ``all``); values within one condition are alternatives.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.paths import file_name, parent, strip_raw_dir

NONE = "none"
SUGGESTIONS, MAX_PAGE = 20, 5000


@dataclass(frozen=True)
class Filter:
    """Conditions; None leaves one out. ``NONE`` within a set means null.

    A range is two conditions, so with ``match="any"`` either end may hold: kept as the algebra defines it.
    """

    match: str = "any"
    min_rating: int | None = None
    colors: list[str] | None = None
    likes: list[str] | None = None
    locks: list[int] | None = None
    cameras: list[str] | None = None
    lenses: list[str] | None = None
    taken: tuple[int | None, int | None] | None = None
    iso: tuple[int | None, int | None] | None = None
    focal: tuple[float | None, float | None] | None = None
    flag_in: DataFrame | None = None
    flag_not_in: DataFrame | None = None
    tag_keys: list[str] | None = None
    text: str | None = None


@dataclass(frozen=True)
class Scope:
    """All of the repository, a subtree, one directory (its ``_RAW`` included), a list of ids, or a tag."""

    kind: str = "all"
    path: str = ""
    ids: DataFrame | list[int] | None = None
    tag: str | None = None


@dataclass(frozen=True)
class Query:
    scope: Scope = field(default_factory=Scope)
    filter: Filter = field(default_factory=Filter)
    sort: str = "taken_at"
    descending: bool | None = None
    visibility: str = "live"


# Columns of each sort key, and the keys that ascend by default.
SORTS = {"taken_at": "taken_at", "file_name": "file_name", "rating": "rating", "camera": "camera", "imported_at": "imported_at", "file_size": "size_bytes"}
ASCENDING, FILE_SORTS = {"file_name", "camera"}, {"file_name", "file_size"}
FACETS = ["rating", "color_label", "like_state", "lock_level"]


def camera_key() -> Column:
    """``make|model``; null if both are missing."""
    return F.nullif(F.concat(F.coalesce("camera_make", F.lit("")), F.lit("|"), F.coalesce("camera_model", F.lit(""))), F.lit("|"))


def in_set(c: Column, values: list) -> Column:
    """``c`` is one of ``values``, where ``NONE`` stands for null; never null itself."""
    known = [v for v in values if v != NONE]
    hit = F.coalesce(c.isin(known), F.lit(False)) if known else F.lit(False)
    return hit | c.isNull() if NONE in values else hit


def within(c: Column, span: tuple) -> list[Column]:
    lo, hi = span
    return [F.coalesce(x, F.lit(False)) for x in ([c >= lo] if lo is not None else []) + ([c <= hi] if hi is not None else [])]


def normal_prefix(p: str) -> str:
    return "/".join(s for s in p.replace("\\", "/").split("/") if s).lower()


class Catalog:
    """``assets`` (one row a photo), ``files`` (one to several a photo), optional ``tags`` (asset_id, tag_key)."""

    def __init__(self, assets: DataFrame, files: DataFrame, tags: DataFrame | None = None):
        self.assets, self.files, self.tags = assets, files, tags

    # ----- compiling

    def _conditions(self, f: Filter) -> list[Column]:
        c: list[Column] = []
        if f.min_rating is not None:
            c.append(F.col("rating") >= f.min_rating)
        for column, values in ((F.col("color_label"), f.colors), (F.col("like_state"), f.likes), (camera_key(), f.cameras), (F.col("lens"), f.lenses)):
            if values is not None:
                c.append(in_set(column, values))
        if f.locks is not None:
            c.append(F.col("lock_level").isin(f.locks) if f.locks else F.lit(False))
        for column, span in (("taken_at", f.taken), ("iso", f.iso), ("focal_mm", f.focal)):
            if span is not None:
                c.extend(within(F.col(column), span))
        if f.flag_in is not None:
            c.append(F.coalesce(F.col("__flag_in"), F.lit(False)))
        if f.flag_not_in is not None:
            c.append(F.col("__flag_not_in").isNull())
        if f.tag_keys is not None:
            c.append(F.coalesce(F.col("__tagged"), F.lit(False)))
        if f.text and f.text.strip():
            c.append(F.coalesce(F.col("__text"), F.lit(False)))
        return c

    def _marked(self, df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
        """A semi-join as a flag, so that it can stand in a disjunction."""
        ids = ids.select(F.col(ids.columns[0]).alias("__id")).where("__id is not null").distinct().withColumn(name, F.lit(True))
        return df.join(ids, F.col("id") == F.col("__id"), "left").drop("__id")

    def _text_ids(self, text: str) -> tuple[Column, DataFrame]:
        """From three characters on a substring of file name, camera, lens or description; below, of the file name."""
        t = text.strip().lower()
        by_name = self.files.where(F.lower(file_name(F.col("rel_path"))).contains(t)).select("asset_id")
        own = [F.coalesce(F.lower(c).contains(t), F.lit(False)) for c in (F.concat_ws(" ", "camera_make", "camera_model"), F.col("lens"), F.col("description"))]
        return (reduce(lambda a, b: a | b, own) if len(t) >= 3 else F.lit(False)), by_name

    def _in_scope(self, df: DataFrame, s: Scope) -> DataFrame:
        if s.kind == "all" or (s.kind in ("subtree",) and not normal_prefix(s.path)):
            return df
        semi = lambda ids: df.join(ids.select(F.col(ids.columns[0]).alias("__id")), F.col("id") == F.col("__id"), "left_semi")
        if s.kind == "subtree":
            p = normal_prefix(s.path)
            return semi(self.files.where((F.col("rel_path_folded") == p) | F.col("rel_path_folded").startswith(p + "/")).select("asset_id"))
        if s.kind == "directory":
            return semi(self.files.where(strip_raw_dir(parent(F.col("rel_path_folded"))) == normal_prefix(s.path)).select("asset_id"))
        if s.kind == "ids":
            if isinstance(s.ids, DataFrame):
                return semi(s.ids)
            return df.where(F.col("id").isin(s.ids) if s.ids else F.lit(False))
        if s.kind == "tag":
            return semi(self.tags.where(F.col("tag_key") == s.tag).select("asset_id"))
        raise ValueError(f"unknown scope {s.kind!r}")

    def select(self, q: Query) -> DataFrame:
        """The matching assets, unordered, with their columns only."""
        df = self.assets.where(F.col("deleted_at").isNull() if q.visibility == "live" else F.col("deleted_at").isNotNull())
        df, f = self._in_scope(df, q.scope), q.filter
        if f.flag_in is not None:
            df = self._marked(df, f.flag_in, "__flag_in")
        if f.flag_not_in is not None:
            df = self._marked(df, f.flag_not_in, "__flag_not_in")
        if f.tag_keys is not None:
            df = self._marked(df, self.tags.where(F.col("tag_key").isin(f.tag_keys) if f.tag_keys else F.lit(False)).select("asset_id"), "__tagged")
        if f.text and f.text.strip():
            own, by_name = self._text_ids(f.text)
            df = self._marked(df, by_name, "__named").withColumn("__text", own | F.coalesce(F.col("__named"), F.lit(False)))
        if conditions := self._conditions(f):
            df = df.where(reduce((lambda a, b: a & b) if f.match == "all" else (lambda a, b: a | b), conditions))
        return df.select(self.assets.columns)

    # ----- reading

    def count(self, q: Query) -> DataFrame:
        return self.select(q).agg(F.count(F.lit(1)).alias("n_assets"))

    def display_files(self, files: DataFrame | None = None) -> DataFrame:
        """One file a photo: the bitmap before the raw before the sidecar, the lowest id on a tie; and whether it has a raw."""
        picked = F.min_by(F.struct(F.col("id").alias("file_id"), "rel_path", "size_bytes", "missing_since", "file_created_ms", "mtime_ms"), F.struct("role", "id"))
        return (self.files if files is None else files).groupBy("asset_id").agg(picked.alias("f"), F.max(F.col("role") == "raw").alias("has_raw"), F.count(F.lit(1)).alias("n_files")).select("asset_id", "f.*", "has_raw", "n_files")

    def rows(self, q: Query) -> DataFrame:
        """The wide projection: assets with their display file."""
        return self._wide(self.select(q), self.display_files())

    def _wide(self, a: DataFrame, shown: DataFrame) -> DataFrame:
        return a.join(shown, F.col("id") == F.col("asset_id"), "left").select(
            *[F.col(c) for c in a.columns],
            camera_key().alias("camera"),
            F.coalesce("rel_path", F.lit("")).alias("rel_path"),
            F.coalesce(file_name(F.col("rel_path")), F.lit("")).alias("file_name"),
            F.coalesce("file_created_ms", "mtime_ms").alias("file_time_ms"),
            "size_bytes", "missing_since",
            F.coalesce("has_raw", F.lit(False)).alias("has_raw"),
            F.least(F.coalesce("n_files", F.lit(0)), F.lit(100)).alias("n_files"),
        )

    def order(self, q: Query) -> list[Column]:
        """The sort key, then the id in the same direction. Cameras that are missing come last both ways; other nulls are least."""
        down = q.descending if q.descending is not None else q.sort not in ASCENDING
        key = F.col(SORTS[q.sort])
        if q.sort == "camera":
            first = key.desc_nulls_last() if down else key.asc_nulls_last()
        else:
            first = key.desc_nulls_last() if down else key.asc_nulls_first()
        return [first, F.col("id").desc() if down else F.col("id").asc()]

    def page(self, q: Query, offset: int, limit: int) -> DataFrame:
        """One page of at most ``MAX_PAGE`` rows. Where the sort key is the asset's own, the page is cut first and only its files are read together."""
        limit = max(0, min(limit, MAX_PAGE))
        if q.sort in FILE_SORTS:
            return self.rows(q).orderBy(*self.order(q)).offset(offset).limit(limit)
        few = self.select(q).withColumn("camera", camera_key()).orderBy(*self.order(q)).offset(offset).limit(limit).drop("camera")
        files = self.files.join(F.broadcast(few.select(F.col("id").alias("__id"))), F.col("asset_id") == F.col("__id"), "left_semi")
        return self._wide(few, self.display_files(files)).orderBy(*self.order(q))

    def keyset_page(self, q: Query, after: int, upper: int, limit: int) -> DataFrame:
        """The next ``limit`` ids after ``after``, not beyond the frozen ``upper``."""
        return self.select(q).where((F.col("id") > after) & (F.col("id") <= upper)).select("id", "organization_uid").orderBy("id").limit(min(limit, 500))

    def timeline(self, q: Query, limit: int = 0) -> DataFrame:
        """(id, taken_at, rel_path) of all matches; ``limit`` 0 is unlimited and unordered."""
        t = self.rows(replace(q, sort="taken_at")).select("id", "taken_at", "rel_path")
        return t.orderBy(*self.order(replace(q, sort="taken_at"))).limit(limit) if limit else t

    def facets(self, q: Query) -> DataFrame:
        """(facet, value, n): one pass to the combinations, then their marginals; a null value is a row of its own."""
        combos = self.select(q).groupBy(*FACETS).agg(F.count(F.lit(1)).alias("n"))
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in FACETS]))
        return combos.select(pairs.alias("p"), "n").groupBy("p.facet", "p.value").agg(F.sum("n").alias("n"))

    def text_values(self, column: str, parents: dict[str, str] | None = None, limit: int = SUGGESTIONS) -> DataFrame:
        """The most frequent values of a text column below chosen parent values (country, province, city); blanks are none."""
        df = self.assets.where(F.col("deleted_at").isNull())
        for c, v in (parents or {}).items():
            if c != column:
                df = df.where(F.col(c) == v)
        v = F.trim(F.col(column))
        return df.where(v != "").groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(limit)


def recycle_summary(assets: DataFrame, files: DataFrame) -> DataFrame:
    gone = assets.where("deleted_at is not null").select(F.col("id").alias("asset_id"))
    sizes = files.join(gone, "asset_id", "left_semi").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"))
    n = gone.agg(F.count(F.lit(1)).alias("n_assets"))
    return n.withColumn("k", F.lit(0)).join(sizes.withColumn("k", F.lit(0)), "k").drop("k")


def repository_totals(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Per library: photos, recycled photos, files and bytes. Files are summed per photo before they meet their library."""
    per_asset = files.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("b"))
    return (
        assets.join(per_asset, F.col("id") == F.col("asset_id"), "left")
        .groupBy("repository_id")
        .agg(F.count_if(F.col("deleted_at").isNull()).alias("n_live"), F.count_if(F.col("deleted_at").isNotNull()).alias("n_recycled"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_bytes"))
    )


def directory_counts(files: DataFrame) -> DataFrame:
    """Per directory: bitmaps directly in it, and images with those of its ``_RAW`` directory."""
    d = files.select(parent(F.col("rel_path")).alias("dir"), "role").where("role <> 'sidecar'")
    return d.groupBy(strip_raw_dir(F.col("dir")).alias("dir_path")).agg(F.count_if(strip_raw_dir(F.col("dir")) == F.col("dir")).alias("photos"), F.count(F.lit(1)).alias("images"))


def first_by(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of each key's first row by ``order``: a correlated ``ORDER BY .. LIMIT 1`` as one aggregation."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def keep_recent(df: DataFrame, key: str, order: str, tie: str, n: int) -> DataFrame:
    """The ``n`` latest rows of each key. Spark prunes to n per task before the shuffle (window group limit)."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.col(tie).desc()))
    return df.withColumn("rn", rn).where(F.col("rn") <= n)
