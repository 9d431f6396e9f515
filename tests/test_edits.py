import pytest
from pyspark.sql import functions as F

from shutterlake.functions import kernels as k
from shutterlake.functions import paths as p
from shutterlake.functions import scalars as s
from shutterlake.operators import edits as e
from shutterlake.operators import linkage as l
from shutterlake.operators import ranking as r
from shutterlake.operators import tagging as t
from shutterlake.operators.lenses import match_lenses

ASSETS = "id long, lock_level int, rating int, color string, deleted_at long, __e string, asset_id long"


def found(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def test_edits_respect_locks_and_report(rows):
    a = rows([(1, 0, 3, "red", None, "c", 9), (2, 2, 3, None, None, "c", 9), (3, None, 1, "red", None, "c", 9), (4, 1, 5, None, None, "c", 9)], ASSETS).drop("__e", "asset_id")
    x = rows([(1, 5, None), (1, 4, "blue"), (2, 5, "red"), (3, 1, "red"), (7, 1, "red"), (None, 1, "red")], "asset_id long, rating int, color string")
    after, report = e.apply_edits(a, x, ["rating", "color"])
    assert found(after.select("id", "rating", "color")) == [(1, 5, None), (2, 3, None), (3, 1, "red"), (4, 5, None)]
    assert found(report) == [(1, "applied"), (2, "locked"), (3, "unchanged"), (7, "unknown")]
    assert found(e.locked_for_move(a, rows([(1,), (2,), (4,), (4,), (9,)], "asset_id long"))) == [(2,), (4,)]
    gone = e.recycle(a, rows([(1,), (2,), (3,)], "asset_id long"), 50)
    assert found(gone.select("id", "deleted_at")) == [(1, 50), (2, None), (3, 50), (4, None)]
    files = rows([(10, 1, "recycle/a", "photos/a"), (11, 2, "photos/b", None)], "id long, asset_id long, rel_path string, recycled_from string")
    back, home = e.restore(gone, files, rows([(1,)], "asset_id long"))
    assert found(back.select("id", "deleted_at")) == [(1, None), (2, None), (3, 50), (4, None)] and found(home) == [(10, 1, "photos/a", None), (11, 2, "photos/b", None)]
    assert found(e.apply_edits(a.limit(0), x.limit(0), ["rating"])[1]) == []


def test_snapshot_becomes_a_version(rows):
    old = rows([("a", "A", 1, 1, None), ("b", "b", 2, 2, None), ("c", "c", 3, 3, 7)], "key string, rel_path string, size_bytes long, mtime_ms long, missing_since long")
    new = rows([("a", "a", 1, 5), ("a", "b", 1, 5), ("c", "c", 3, 3), ("d", "d", 4, 4), (None, "x", 1, 1)], "key string, rel_path string, size_bytes long, mtime_ms long")
    assert found(e.apply_snapshot(old, new, 99)) == [("a", "a", 1, 5, None), ("b", "b", 2, 2, 99), ("c", "c", 3, 3, None), ("d", "d", 4, 4, None)]
    assert found(e.apply_snapshot(e.apply_snapshot(old, new, 99), new, 100)) == found(e.apply_snapshot(old, new, 99))


def test_import_plan_groups_leaders_and_verdicts(rows):
    planned = rows(
        [(1, "d", "a", False, "p/a.raw", 5, "h5"), (2, "d", "a", True, "p/a.jpg", 3, "h3"), (3, "d", "b", True, "p/b.jpg", 4, None), (4, "e", "b", True, "p/b.jpg", 4, None), (5, "d", "c", False, "p/c.raw", 8, "x"), (6, None, None, True, None, 1, None)],
        "id long, dir string, stem string, bitmap boolean, key string, size long, hash string",
    )
    there = rows([("p/a.jpg", 3, "h3"), ("p/c.raw", 9, "x"), (None, 1, None)], "key string, size long, hash string")
    assert found(l.import_plan(planned, there)) == [(1, 2, "free", False), (2, 2, "skip", False), (3, 3, "free", False), (4, 4, "conflict", True), (5, 5, "conflict", True), (6, 6, "free", False)]


def test_sources_known_by_identity_else_path(rows):
    cols = "ident string, path string, size long, mtime long"
    old = rows([("i1", "a", 1, 1), ("i1", "a", 1, 1), (None, "b", None, 2), ("i3", None, 3, 3)], cols)
    new = rows([(1, "i1", "z", 9, 9), (2, None, "b", None, 2), (3, None, "b", 1, 2), (4, "i3", None, 1, 1), (5, None, None, 3, 3)], "id long, " + cols)
    assert found(l.known_sources(new, old)) == [(1, "identity"), (2, "path"), (4, "identity")]


def test_sidecars_at_the_wrong_name_and_with_other_content(rows):
    photos = rows([(1, "p/a.jpg", True, "x"), (2, "p/b.jpg", True, "x"), (3, "p/c.raw", False, None), (4, "p/d.raw", False, None), (5, "p/e.jpg", True, None), (6, None, True, "x"), (7, "p/f.jpg", False, None)], "asset_id long, path string, wanted boolean, content string")
    there = rows([("p/a.xmp", True, "x"), ("p/b.xmp", True, "y"), ("p/c.xmp", True, None), ("p/d.xmp", False, None), ("p/zz.xmp", True, "x"), (None, True, None)], "path string, ours boolean, content string")
    want = [("p/a.xmp", 1, "present"), ("p/b.xmp", 2, "outdated"), ("p/c.xmp", 3, "stale"), ("p/d.xmp", 4, "foreign"), ("p/e.xmp", 5, "absent"), ("p/zz.xmp", None, "orphan")]
    assert found(l.sidecar_audit(photos, there)) == want


def test_lenses(rows):
    profiles = rows(
        [("Canon", "EF 50mm f/1.8 II", ["EF"]), ("Canon", "EF 50mm f/1.8", ["EF"]), ("Canon", "EF 24-70mm f/2.8", ["EF"]), ("Panasonic", "Leica DG Summilux 25mm F1.4", ["MFT"]), ("Panasonic", "Lumix G 25mm F1.7", ["MFT"]),
         ("Sigma", "30mm F1.4 Contemporary", ["E"]), ("Sigma", "30mm F1.4 Art", ["EF"]), ("Nikon", "Plain", []), ("Olympus", "12-45mm F4-5.6", ["MFT"])],
        "maker string, model string, mounts array<string>",
    )
    asked = [("Canon", "EF", "EF50mm f/1.8 II"), ("Canon", "EF", "EF50mm f/1.8"), ("Canon", "EF", "24 - 70 mm F2.8"), ("Canon", "EF", "24-70mm F4"), ("Panasonic", "MFT", "LEICA DG 25mm"), ("Panasonic", "MFT", "25mm"), ("X", "EF", "Sigma 30mm F1.4"),
             ("Nikon", "F", "plain"), ("Nikon", "F", "unknown"), ("Olympus", "MFT", "12-45mm 1:4-5.6"), ("Canon", "EF", " "), (None, "EF", "50mm")]
    got = {(a, c): d for a, _, c, d in found(match_lenses(rows(asked, "camera_make string, camera_model string, lens string"), profiles))}
    assert got == {
        ("Canon", "EF50mm f/1.8 II"): "EF 50mm f/1.8 II", ("Canon", "EF50mm f/1.8"): "EF 50mm f/1.8", ("Canon", "24 - 70 mm F2.8"): "EF 24-70mm f/2.8", ("Panasonic", "LEICA DG 25mm"): "Leica DG Summilux 25mm F1.4",
        ("X", "Sigma 30mm F1.4"): "30mm F1.4 Art", ("Nikon", "plain"): "Plain", ("Olympus", "12-45mm 1:4-5.6"): "12-45mm F4-5.6",
    }


def test_kinds_and_junk(rows):
    names = {"a.SR2": "raw", "a.dcs": "raw", "a.bay": "other", "a.fff": "other", "a.AAE": "sidecar", "a.pp3": "sidecar", "a.heif": "bitmap", ".jpg": "other", "x.": "other"}
    got = rows([(n,) for n in names], "n string").select("n", p.kind(p.extension(F.col("n")))).collect()
    assert {a: b for a, b in got} == names
    junk = {"d/photo.jpg:Zone.Identifier": "stream", "ehthumbs.db": "system", "d/.localized": "system", "$RECYCLE.BIN": "system", "._x.jpg": "system", ".goutputstream-1": "temporary", "~$a.doc": "temporary", "catalog.db-wal": "catalog", "ok.jpg": None, "x\\Thumbs.db": "system"}
    assert {a: b for a, b in rows([(n,) for n in junk], "n string").select("n", p.junk_kind(F.col("n"))).collect()} == junk


def test_templates(rows):
    d = rows([(0, "n", None, " ", 12345), (None, None, "B", "M", 7)], "t long, name string, brand string, model string, seq long")
    c = p.render("x:CYEAR:CMONTH/:CDAY_:CWEEK/:BRAND:MODEL-:FILENAME:SEQ000", when=F.timestamp_millis("t"), name=F.col("name"), brand=F.col("brand"), model=F.col("model"), seq=F.col("seq"))
    assert found(d.select(c)) == [("x000000/00_00/BM-007",), ("x197001/01_01/UnknownUnknown-n12345",)]
    with pytest.raises(ValueError):
        p.parse_template("a/:NOPE")
    assert p.parse_template("") == []


def test_order_statistics_over_ranged_partitions(spark):
    d = spark.range(20_001).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))).alias("k"), ((F.col("id") * 7919) % 1013).cast("double").alias("v"))
    data = {}
    for x in d.collect():
        data.setdefault(x.k, []).append(x.v)
    got = {x.k: x for x in r.nearest_rank(d, ["k"], "v", [0.5, 0.95, 0.0]).collect()}
    mid = {x.k: x.median for x in r.upper_median(d, ["k"], "v").collect()}
    for key, vs in data.items():
        vs.sort()
        n = len(vs)
        assert (got[key].p50, got[key].p95, got[key].p0, mid[key]) == (vs[-(-n // 2) - 1], vs[-(-95 * n // 100) - 1], vs[0], vs[n // 2])
    assert r.upper_median(d.limit(0), ["k"], "v").count() == 0
    for bad in (dict(precision=0.0), dict(precision=1.1), dict(precision=0.5, min_tp=0), dict(precision=0.5, beta=0.0)):
        with pytest.raises(ValueError):
            r.choose_threshold(d, "k", "v", "v", **bad)


def test_subsequence_scores(rows):
    def plain(q, x):
        score = streak = m = 0
        first = -1
        for i, ch in enumerate(x):
            if m < len(q) and ch == q[m]:
                first = i if first < 0 else first
                streak, m = streak + 1, m + 1
                score += 10 + 5 * streak + (8 if i == 0 or x[i - 1] in " \t·/\\|,.-_:" else 0)
            elif m < len(q):
                streak = 0
        return -1 if m < len(q) else score - min(first, 20)

    texts = ["zoom in", "view/zoom_in", "a" * 30 + "zi", "", "z", "zzii", "in-zoom", "日z本i"]
    got = rows([(x,) for x in texts], "x string").select("x", s.subsequence_score(F.col("x"), F.lit("zi"))).collect()
    assert {a: b for a, b in got} == {x: plain("zi", x) for x in texts}
    m = {a: b for a, b in rows([("Full screen",), ("fullscreen",), ("Full",), ("screens, full",)], "x string").select("x", s.match_score("Full  Screen", F.col("x"))).collect()}
    assert m["fullscreen"] == 1000 and m["Full screen"] > 0 and m["Full"] is None and m["screens, full"] is None


def test_tag_relations(rows):
    d = rows([("photos/a", "x"), ("photos/a", "x"), ("photos//b", "x"), ("photos/../c", "x"), ("other/a", "x"), ("photos/a\\b", "x"), ("photos/b", None), (None, "x")], "directory_key string, tag_key string")
    assert found(t.directory_tag_counts(d)) == [("x", 1)]
    log = rows([(i,) for i in range(1, 11)], "event_id long")
    assert t.prune_log(log, 0).count() == 10 and found(t.prune_log(log, 8, 3)) == [(i,) for i in (10, 4, 5, 6, 7, 8, 9)]
    res = rows([(1, "s", "p", True), (2, "s", "p", True), (3, "s", "p", False)], "asset_id long, source_key string, payload string, valid boolean")
    assert found(t.invalidate_results(res, rows([(1, "s"), (2, "z"), (3, "s")], "asset_id long, current_source string")).select("asset_id", "valid")) == [(1, True), (2, False), (3, False)]
    offers = rows([(1, 5, "s", "new"), (2, 6, "s", "late"), (9, 7, "s", "first")], "asset_id long, token long, source_key string, payload string")
    open_ = rows([(1, 5, "s"), (2, 8, "s"), (9, 7, "s")], "asset_id long, token long, source_key string")
    assert found(t.commit_results(res, offers, open_)) == [(1, "s", "new", True), (2, "s", "p", True), (3, "s", "p", False), (9, "s", "first", True)]


def test_box_blur_by_running_sums(rows):
    a = [float(x) for x in (3, 1, 4, 1, 5, 9, 2, 6)]
    for radius in (0, 1, 3, 20):
        got = rows([(a,), ([],)], "a array<double>").select(k.box_blur(F.col("a"), radius)).collect()
        assert got[0][0] == pytest.approx([sum(a[max(0, i - radius) : i + radius + 1]) / len(a[max(0, i - radius) : i + radius + 1]) for i in range(len(a))]) and got[1][0] == []
    with pytest.raises(ValueError):
        k.inverse_3x3([[1, 2, 3], [2, 4, 6], [0, 0, 1]])
