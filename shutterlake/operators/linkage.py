"""Record linkage: reconciling a listing with a catalogue, inheriting times, duplicates by content and source."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.paths import file_name, pair_key, parent, stem

SLACK_MS = 2000


def _one_edit_apart(x: DataFrame, y: DataFrame, on: list[str], a: str, b: str, least_chars: int = 4) -> DataFrame:
    """The pairs of rows of ``x`` and ``y`` equal in ``on`` whose names (``a_name``, ``b_name``) are at most one edit apart and have ``least_chars`` characters.

    Two names are that near if and only if they are equal, agree once the same place is left out of both, or one is the other
    without a place. So joins on names with a place left out list no pair that is not a result, however many rows are equal in ``on``.
    """
    x, y = (d.where(F.length(f"{n}_name") >= least_chars) for d, n in ((x, a), (y, b)))
    short = lambda d, n: d.withColumn("pos", F.explode(F.sequence(F.lit(1), F.length(f"{n}_name")))).withColumn("rest", F.expr(f"concat(left({n}_name, pos - 1), substring({n}_name, pos + 1))"))
    xs, ys = short(x, a), short(y, b)
    columns = [*on, a, f"{a}_name", f"{a}_mtime", b, f"{b}_name", f"{b}_mtime"]
    pairs = [
        x.join(y.withColumn("rest", F.col(f"{b}_name")), on).where(F.col(f"{a}_name") == F.col("rest")),
        xs.join(ys, [*on, "pos", "rest"]),
        xs.join(y.withColumn("rest", F.col(f"{b}_name")), [*on, "rest"]),
        ys.join(x.withColumn("rest", F.col(f"{a}_name")), [*on, "rest"]),
    ]
    out = pairs[0].select(columns)
    for p in pairs[1:]:
        out = out.unionByName(p.select(columns))
    return out.distinct()


def reconcile(disk: DataFrame, db: DataFrame) -> DataFrame:
    """(scope, disk_id, db_id, evidence, state) of a disk listing against catalogue rows, one to one.

    Both have (scope, id, key, size, mtime, ident); ``db`` also ``missing``. Pass 1 joins identities that are unique
    on both sides, pass 2 the first row of each path, pass 3 compares what is left in one directory with equal size:
    times at most 2 s apart and names at most one edit apart, first come first served in id order. ``state``: renamed,
    modified, returned, unchanged, or one-sided new, missing, still_missing. Null identities link nothing, rows with
    null paths only by identity. Within pass 3 a bucket is one directory and size, so it holds no unbounded group.
    """
    one = lambda df: df.where("ident is not null").groupBy("scope", "ident").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    p1 = one(disk).withColumnRenamed("id", "disk_id").join(one(db).withColumnRenamed("id", "db_id"), ["scope", "ident"]).select("scope", "disk_id", "db_id", F.lit("identity").alias("evidence"))

    def rest(df: DataFrame, used: list[DataFrame], name: str) -> DataFrame:
        for u in used:
            df = df.join(u.select("scope", F.col(name).alias("id")), ["scope", "id"], "left_anti")
        return df

    first = lambda df: df.where("key is not null").groupBy("scope", "key").agg(F.min("id").alias("id"))
    d2, c2 = rest(disk, [p1], "disk_id"), rest(db, [p1], "db_id")
    p2 = first(d2).withColumnRenamed("id", "disk_id").join(first(c2).withColumnRenamed("id", "db_id"), ["scope", "key"]).select("scope", "disk_id", "db_id", F.lit("path").alias("evidence"))
    side = lambda df, n: rest(df, [p2], n).where("size is not null and mtime is not null and key is not null").select(
        "scope", parent(F.col("key")).alias("dir"), "size", F.col("id").alias(n), file_name(F.col("key")).alias(f"{n}_name"), F.col("mtime").alias(f"{n}_mtime")
    )
    near = _one_edit_apart(side(d2, "disk_id"), side(c2, "db_id"), ["scope", "dir", "size"], "disk_id", "db_id")
    near = near.where(F.abs(F.col("disk_id_mtime") - F.col("db_id_mtime")) <= SLACK_MS).select("scope", "dir", "size", "disk_id", "db_id")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for d, g in pdf.sort_values(["disk_id", "db_id"]).groupby("disk_id", sort=True):
            free = [x for x in g.db_id if x not in taken]
            if free:
                taken.add(free[0])
                out.append((d, free[0]))
        return pd.DataFrame(out, columns=["disk_id", "db_id"]).assign(scope=pdf.scope.iloc[0])[["scope", "disk_id", "db_id"]]

    p3 = near.groupBy("scope", "dir", "size").applyInPandas(greedy, "scope string, disk_id long, db_id long").withColumn("evidence", F.lit("heuristic"))
    links = p1.unionByName(p2).unionByName(p3)
    d = disk.select("scope", F.col("id").alias("disk_id"), F.col("key").alias("dk"), F.col("size").alias("ds"), F.col("mtime").alias("dm"))
    c = db.select(F.col("scope").alias("cscope"), F.col("id").alias("db_id"), F.col("key").alias("ck"), F.col("size").alias("cs"), F.col("mtime").alias("cm"), "missing")
    joined = d.join(links, ["scope", "disk_id"], "left").join(c, (F.col("scope") == F.col("cscope")) & (links["db_id"] == c["db_id"]), "full_outer")
    changed = ~F.col("ds").eqNullSafe(F.col("cs")) | F.coalesce(F.abs(F.col("dm") - F.col("cm")) > SLACK_MS, F.lit(False))
    state = (
        F.when(c["db_id"].isNull(), "new")
        .when(F.col("disk_id").isNull(), F.when(F.col("missing"), "still_missing").otherwise("missing"))
        .when(F.col("missing"), "returned")
        .when(F.col("dk") != F.col("ck"), "renamed")
        .when(changed, "modified")
        .otherwise("unchanged")
    )
    return joined.select(F.coalesce("scope", "cscope").alias("scope"), "disk_id", c["db_id"].alias("db_id"), "evidence", state.alias("state"))


def inherit_times(files: DataFrame, *, key: str, path: str, is_raw: str, time: str) -> DataFrame:
    """``files`` with ``inherited_at``: a raw file without a time takes the earliest time of the bitmaps it is paired with."""
    p = files.withColumn("__pair", pair_key(F.col(path)))
    least = p.where(~F.col(is_raw)).groupBy("__pair").agg(F.min(time).alias("__least"))
    return p.join(least, "__pair", "left").withColumn("inherited_at", F.when(F.col(is_raw) & F.col(time).isNull(), F.col("__least"))).drop("__pair", "__least")


def sidecar_audit(photos: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(path, asset_id, verdict): the sidecars photos should have against those on disk, by folded path.

    ``photos`` are (asset_id, path, wanted, content): the path of the photo's file, whether it has anything a sidecar could say, and
    a digest of that (null: not compared). ``sidecars`` are (path, ours, content). ``absent``: wanted, not there. ``outdated``: there with
    other content. ``present``. ``stale``: not wanted, one of ours is there. ``foreign``: not wanted, someone else's. ``orphan``: at a path no
    photo owns. Photos without a path own none; a photo neither wanted nor there gives no row. Of photos with one path the first owns it.
    """
    own = photos.where("path is not null").withColumn("want", F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(".xmp"))).groupBy("want")
    own = own.agg(F.min(F.struct("asset_id", "wanted", F.col("content").alias("due"))).alias("o")).select("want", "o.*")
    there = sidecars.where("path is not null").groupBy("path").agg(F.min(F.struct("ours", "content")).alias("s")).select("path", "s.*")
    j = own.join(there, F.col("want") == F.col("path"), "full_outer")
    verdict = (
        F.when(F.col("want").isNull(), "orphan")
        .when(F.col("wanted") & F.col("path").isNull(), "absent")
        .when(F.col("wanted") & (F.col("due") != F.col("content")), "outdated")
        .when(F.col("wanted"), "present")
        .when(F.col("path").isNull(), None)
        .when(F.col("ours"), "stale")
        .otherwise("foreign")
    )
    return j.select(F.coalesce("want", "path").alias("path"), "asset_id", verdict.alias("verdict")).where("verdict is not null")


def content_duplicates(files: DataFrame) -> DataFrame:
    """(id, class_id, n_copies) of files whose content hash of one kind others have too; the class is its least id."""
    h = files.where("content_hash is not null and content_hash_kind is not null")
    c = h.groupBy("content_hash_kind", "content_hash").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return h.join(c, ["content_hash_kind", "content_hash"]).select("id", "class_id", "n_copies")


def size_duplicates(files: DataFrame) -> DataFrame:
    """(size_bytes, n_files, n_paths) of sizes several files share: where a fingerprint is worth reading."""
    return files.where("size_bytes is not null").groupBy("size_bytes").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("rel_path_folded").alias("n_paths")).where("n_files > 1")


def fill_blanks(rows: DataFrame, donors: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with null or blank text columns taken from the donor of their key; other values stay."""
    d = donors.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    j = rows.join(d, F.col(key) == F.col("__k"), "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return j.withColumns({c: F.when(blank(c), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).select(rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str], counters: list[str] = ()) -> DataFrame:
    """Latest row of each key of both, by ``order`` and then by the other columns, so ties are settled; counters keep their maximum."""
    both = old.unionByName(new)
    rest = [c for c in old.columns if c not in key and c not in counters]
    row = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__r")
    return both.groupBy(*key).agg(row, *[F.max(c).alias(c) for c in counters]).select(*[c if c in key or c in counters else F.col(f"__r.{c}") for c in old.columns])


def near_names(rows: DataFrame, *, key: str, name: str, least_chars: int = 4) -> DataFrame:
    """(a_id, b_id), a_id < b_id, of all rows whose names are at most one edit apart, by bytes; names below ``least_chars`` characters have none.

    Two names are one substitution apart if and only if they differ and agree once the same place is left out of both,
    one insertion apart if and only if one is the other without a place. So joins on variants without one byte list
    no pair that is not a result. Rows of equal names are reduced to one before the variants are made. All joins are
    merges of shuffles: size estimates count a name's variants as one row, so Spark would broadcast them through the driver.
    """
    r = rows.where(F.length(name) >= least_chars).select(F.col(key).alias("id"), F.col(name).alias("name"))
    # One character a byte.
    raw = r.select("name").distinct().withColumn("raw", F.decode(F.encode("name", "UTF-8"), "ISO-8859-1"))
    at = raw.select("name", "raw", F.explode(F.sequence(F.lit(1), F.length("raw"))).alias("pos"))
    rest = "concat(left(raw, pos - 1), substring(raw, pos + 1))"
    cut = at.select("name", "pos", F.expr(rest).alias("rest"))
    x, y = cut.withColumnRenamed("name", "n1"), cut.withColumnRenamed("name", "n2")
    swapped = x.join(y.hint("merge"), ["rest", "pos"]).where("n1 < n2").select("n1", "n2")
    # A name without any of equal neighbours is the same name, so each run of them is shortened once, at its end.
    z = at.where("substring(raw, pos, 1) <> substring(raw, pos + 1, 1)").select(F.col("name").alias("n2"), F.expr(rest).alias("rest"))
    whole = raw.select(F.col("name").alias("n1"), F.col("raw").alias("rest"))
    shorter = whole.join(z.hint("merge"), "rest").where(F.abs(F.length("n1") - F.length("n2")) <= 1).select("n1", "n2")
    a, b = r.toDF("i", "n1"), r.toDF("j", "n2")
    near = swapped.unionByName(shorter).join(a.hint("merge"), "n1").join(b.hint("merge"), "n2").select("i", "j")
    equal = a.join(b.hint("merge"), F.col("n1") == F.col("n2")).where("i < j").select("i", "j")
    return near.unionByName(equal).select(F.least("i", "j").alias("a_id"), F.greatest("i", "j").alias("b_id"))


def toggle(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids in exactly one of two sets."""
    x, y = a.select(key).distinct().withColumn("__a", F.lit(1)), b.select(key).distinct().withColumn("__b", F.lit(1))
    return x.join(y, key, "full_outer").where("__a is null or __b is null").select(key)


def by_position(ids: list[int], rows: DataFrame, key: str) -> DataFrame:
    """Rows of the given ids with their place in the list; ids without a row drop out."""
    lst = rows.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], f"{key} long, pos int")
    return lst.join(rows, key)


def known_sources(incoming: DataFrame, registered: DataFrame) -> DataFrame:
    """(id, known_by) of incoming files that were registered before: by ``identity``, else by ``path`` (folded path, size and time).

    Both have (ident, path, size, mtime), ``incoming`` also id. A null identity or path finds nothing; null sizes and times equal null ones.
    Registered files are reduced to distinct keys first, so a hot one is one row.
    """
    idents = registered.where("ident is not null").select(F.col("ident").alias("r_ident")).distinct().withColumn("by_ident", F.lit(True))
    paths = registered.where("path is not null").select(*[F.col(c).alias(f"r_{c}") for c in ("path", "size", "mtime")]).distinct().withColumn("by_path", F.lit(True))
    same = (F.col("path") == F.col("r_path")) & F.col("size").eqNullSafe(F.col("r_size")) & F.col("mtime").eqNullSafe(F.col("r_mtime"))
    j = incoming.join(idents, F.col("ident") == F.col("r_ident"), "left").join(paths, same, "left")
    return j.select("id", F.when(F.col("by_ident"), "identity").when(F.col("by_path"), "path").alias("known_by")).where("known_by is not null")


def import_plan(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, leader, verdict, group_conflict) of planned files (id, dir, stem, bitmap, key, size, hash) against existing ones (key, size, hash).

    Files of one source directory and folded stem are a group; its leader is its first bitmap, else its first file. ``verdict`` on the
    file's own target path ``key``: ``free``; ``conflict`` if an earlier planned file has it, or an existing one that isn't known to be equal;
    ``skip`` if size and content hash are known and equal - hashes are looked at only where path and size are. ``group_conflict``: some
    file of the group is in conflict, so the whole group needs another name. Null paths conflict with nothing.
    """
    e = existing.where("key is not null").groupBy("key").agg(F.min(F.struct("size", "hash")).alias("e"))
    first = planned.where("key is not null").groupBy("key").agg(F.min("id").alias("first"))
    lead = planned.groupBy("dir", "stem").agg(F.min(F.struct(~F.col("bitmap"), "id")).alias("l")).select(F.col("dir").alias("g_dir"), F.col("stem").alias("g_stem"), F.col("l.id").alias("leader"))
    same = (F.col("size") == F.col("e.size")) & (F.col("hash") == F.col("e.hash"))
    verdict = F.when(F.col("id") != F.col("first"), "conflict").when(F.col("e").isNull(), "free").when(F.coalesce(same, F.lit(False)), "skip").otherwise("conflict")
    j = planned.join(e, "key", "left").join(first, "key", "left").select("id", "dir", "stem", verdict.alias("verdict"))
    bad = j.groupBy("dir", "stem").agg(F.max(F.col("verdict") == "conflict").alias("group_conflict")).toDF("c_dir", "c_stem", "group_conflict")
    of = lambda d, s: F.col("dir").eqNullSafe(F.col(d)) & F.col("stem").eqNullSafe(F.col(s))
    return j.join(lead, of("g_dir", "g_stem")).join(bad, of("c_dir", "c_stem")).select("id", "leader", "verdict", "group_conflict")


def admit(held: DataFrame, offered: DataFrame, digest: str, order: str) -> DataFrame:
    """Of the offers whose digest is not held the first by ``order`` of each digest; a null digest is never admitted."""
    rest = [c for c in offered.columns if c not in (digest, order)]
    first = offered.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(F.struct(order, *rest)).alias("__o"))
    return first.join(held.select(digest).distinct(), digest, "left_anti").select(digest, "__o.*")


def pending(asked: DataFrame, done: DataFrame) -> DataFrame:
    """(scope) of what was asked for and not done since; both are (scope, at). Repeating either changes nothing."""
    a, d = asked.groupBy("scope").agg(F.max("at").alias("asked")), done.groupBy("scope").agg(F.max("at").alias("done"))
    return a.join(d, "scope", "left").where("done is null or done < asked").select("scope")
