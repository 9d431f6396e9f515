from pyspark.sql import functions as F

from shutterlake.operators import linkage, ranking, tagging, timeline
from shutterlake.operators.catalog import Catalog, Filter, Query, Scope, in_set

ASSETS = "id long, deleted_at long, rating int, color_label string, like_state string, lens string, lock_level int, camera_make string, camera_model string, taken_at long, description string, imported_at long, organization_uid string"
FILES = "id long, asset_id long, role string, rel_path string, rel_path_folded string, size_bytes long, missing_since long, file_created_ms long, mtime_ms long"


def catalog(rows):
    a = [(1, None, 5, "red", None, "L", 0, "A", "M", 10, "dawn", 1, "u"), (2, None, 0, None, "like", None, 2, None, None, None, None, 2, "v"), (3, 9, 3, None, None, None, 0, "A", None, 10, None, 3, "w"), (4, None, 3, "blue", None, "L", 0, "A", "M", 10, None, 4, "x")]
    f = [(1, 1, "raw", "p/d/_RAW/a.RW2", "p/d/_raw/a.rw2", 9, None, None, 5), (2, 1, "bitmap", "p/d/A.jpg", "p/d/a.jpg", 3, None, 4, 5), (3, 2, "raw", "p/dx/_RAW/B.DNG", "p/dx/_raw/b.dng", 4, None, None, 6), (4, 4, "bitmap", "q/C.jpg", "q/c.jpg", 4, None, None, 6), (5, 4, "bitmap", "q/D.jpg", "q/d.jpg", 5, None, None, 7)]
    return Catalog(rows(a, ASSETS), rows(f, FILES), rows([(1, "pick"), (4, "x")], "asset_id long, tag_key string"))


def ids(c, **q):
    return sorted(r.id for r in c.select(Query(**q)).collect())


def test_null_sets_stay_inside_visibility_and_scope(rows):
    c = catalog(rows)
    assert ids(c, filter=Filter(colors=["none"])) == [2]  # 3 is recycled
    assert ids(c, filter=Filter(colors=["none"]), visibility="recycled") == [3]
    assert ids(c, filter=Filter(colors=["none", "red"], min_rating=3)) == [1, 2, 4]
    assert ids(c, filter=Filter("all", colors=["none", "red"], min_rating=3)) == [1]


def test_scopes(rows):
    c = catalog(rows)
    assert ids(c, scope=Scope("subtree", "P/D")) == [1]
    assert ids(c, scope=Scope("directory", "p/dx")) == [2]
    assert ids(c, scope=Scope("subtree", "")) == [1, 2, 4]
    assert ids(c, scope=Scope("ids", ids=[])) == []
    assert ids(c, scope=Scope("tag", tag="pick")) == [1]


def test_ranges_never_match_null_and_flags_handle_null(rows):
    c = catalog(rows)
    assert ids(c, filter=Filter(taken=(0, 20))) == [1, 4]
    none = rows([(None,)], "asset_id long")
    assert ids(c, filter=Filter("all", flag_in=none)) == []
    assert ids(c, filter=Filter("all", flag_not_in=none)) == [1, 2, 4]
    assert ids(c, filter=Filter(text="  ")) == [1, 2, 4]
    assert ids(c, filter=Filter(text="AWN")) == [1]


def test_page_picks_one_file_and_orders(rows):
    c = catalog(rows)
    page = c.page(Query(sort="taken_at"), 0, 10).collect()
    assert [(r.id, r.rel_path, r.has_raw) for r in page] == [(4, "q/C.jpg", False), (1, "p/d/A.jpg", True), (2, "p/dx/_RAW/B.DNG", True)]
    assert [r.id for r in c.page(Query(sort="camera", descending=True), 0, 10).collect()] == [4, 1, 2]
    assert [r.id for r in c.page(Query(sort="taken_at", descending=False), 1, 1).collect()] == [1]


def test_in_set_is_never_null(rows):
    got = [r[0] for r in rows([("a",), (None,), ("b",)], "c string").select(in_set(F.col("c"), ["a"])).collect()]
    assert got == [True, False, False]


def test_masked_and_invalid_tags(rows):
    s = rows([(1, "t", "manual"), (1, "t", "ai"), (2, "t", "ai"), (3, "t", "ai"), (3, "u", "manual")], "asset_id long, tag_key string, source string")
    got = tagging.effective_tags(s, rows([(3, "u")], "asset_id long, tag_key string"), rows([(3,)], "asset_id long"))
    assert sorted(map(tuple, got.collect())) == [(1, "t"), (3, "t")]


def test_rules_from_filters_and_edits(rows):
    import pytest

    g = tagging.rule_from_filter(Filter("all", min_rating=2, colors=["red", "red", "none"], tag_keys=[" Sea "]), ["b", "a", " "])
    assert g == [tagging.Group(("a", "b"), 2, ("none", "red"), tag_keys=("sea",))]
    some = tagging.rule_from_filter(Filter(min_rating=1, likes=["like"]), ["a"])
    assert set(some) == {tagging.Group(("a",), 1), tagging.Group(("a",), likes=("like",))} and tagging.rule_from_filter(Filter(), ["a"]) == [tagging.Group(("a",))]
    for bad in (Filter("all", text="x"), Filter(iso=(1, 2)), Filter(cameras=["c"])):
        with pytest.raises(ValueError):
            tagging.rule_from_filter(bad, ["a"])
    wrong = [tagging.Group(()), tagging.Group((" ",)), tagging.Group(("a",), 6), tagging.Group(("a",), colors=("pink",)), tagging.Group(("a",), likes=("love",)), tagging.Group(("a",), locks=(3,)),
             tagging.Group(tuple(map(str, range(65)))), tagging.Group(("a",), tag_keys=tuple(map(str, range(65)))), tagging.Group(("a",), tag_keys=("",)), tagging.Group(("a",), tag_keys=("x" * 65,))]
    for w in wrong:
        with pytest.raises(ValueError):
            tagging.canonical_rule([w])
    with pytest.raises(ValueError):
        tagging.canonical_rule([tagging.Group((str(i),)) for i in range(17)])
    assert tagging.canonical_rule([]) == [] and len(tagging.canonical_rule([tagging.Group(("a", "b")), tagging.Group(("b", "a", "a"))])) == 1
    ids = lambda *x: rows([(i,) for i in x], "id long")
    now, out = tagging.edit_members(ids(1, 2), ids(3, 4), ids(3, 5, 6), ids(2, 6), ["id"])
    assert sorted(r.id for r in now.collect()) == [1, 3, 5] and sorted(r.id for r in out.collect()) == [2, 4, 6]


def test_import_verdicts(rows):
    s = "id long, key string, size long, hash string"
    plan = rows([(1, "a", 5, "h"), (2, "b", 5, "h"), (3, "b", 5, "h"), (4, "c", None, None), (5, None, 1, "h"), (6, "d", 9, "h")], s)
    have = rows([(9, "a", 5, "h"), (9, "c", None, None), (9, "d", 5, "h")], s)
    plan = plan.selectExpr("*", "'d' AS dir", "cast(id AS string) AS stem", "true AS bitmap")
    assert {r.id: r.verdict for r in linkage.import_plan(plan, have).collect()} == {1: "skip", 2: "free", 3: "conflict", 4: "conflict", 5: "free", 6: "conflict"}


def test_slices(rows):
    h = 3_600_000
    p = rows([("a", "r", 0, None), ("b", "r", h, None), ("c", "r", 2 * h + 1, 0), ("d", "r", 23 * h, 60), ("e", "r", None, None)], "id string, repo string, ms long, off int")
    got = {r.id: (r.day_key, r.slice_no) for r in timeline.time_slices(p, key="id", scope="repo", millis="ms", offset="off").collect()}
    assert got == {"a": ("1970-01-01", 1), "b": ("1970-01-01", 1), "c": ("1970-01-01", 2), "d": ("1970-01-02", 1), "e": ("unknown", 0)}
    one = timeline.time_slices(p, key="id", scope="repo", millis="ms", offset="off", gap_min=float("nan"))
    assert {r.slice_no for r in one.collect()} == {0, 1}


def test_reconcile(rows):
    disk = [("s", 1, "d/a.jpg", 5, 0, "i1"), ("s", 2, "d/b.jpg", 6, 0, None), ("s", 3, "d/imgX1.jpg", 7, 100, None), ("s", 4, "d/new.jpg", 8, 0, None)]
    db = [("s", 11, "d/old.jpg", 5, 0, "i1", False), ("s", 12, "d/b.jpg", 9, 0, None, True), ("s", 13, "d/imgX2.jpg", 7, 90, None, False), ("s", 14, "d/far.jpg", 1, 0, None, True), ("s", 15, "d/lost.jpg", 2, 0, None, False)]
    out = linkage.reconcile(rows(disk, "scope string, id long, key string, size long, mtime long, ident string"), rows(db, "scope string, id long, key string, size long, mtime long, ident string, missing boolean"))
    assert {(r.disk_id, r.db_id, r.evidence, r.state) for r in out.collect()} == {
        (1, 11, "identity", "renamed"), (2, 12, "path", "returned"), (3, 13, "heuristic", "renamed"), (4, None, None, "new"), (None, 14, None, "still_missing"), (None, 15, None, "missing"),
    }


def test_collisions_and_eviction(rows):
    items = rows([("d", 1, "A"), ("d", 2, "a"), ("d", 3, "A"), ("e", 4, "A")], "dir string, id long, stem string")
    got = ranking.collision_suffixes(items, rows([("d", "a_01")], "dir string, stem string"))
    assert sorted((r.id, r.final_stem) for r in got.collect()) == [(1, "A"), (2, "a_02"), (3, "A_03"), (4, "A")]
    cache = rows([(1, 10, 0, 1, False), (2, 10, 0, 0, True), (3, 10, 0, 2, False), (4, 10, 5, 0, False)], "id long, b long, h long, u long, p boolean")
    kw = dict(key="id", size="b", hits="h", last_used="u", pinned="p")
    assert sorted(r.id for r in ranking.evict(cache, 25, **kw).collect()) == [1, 3]
    assert ranking.evict(cache, 40, **kw).count() == 0


def test_running_sum_over_hot_and_null_keys(rows):
    import random

    rnd = random.Random(3)
    data = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), i, rnd.randrange(5)) for i in range(500)]
    rnd.shuffle(data)
    got = ranking.running_sum(rows(data, "k string, i long, v long"), ["k"], ["i"], F.col("v"), "s").collect()
    want, sums = {}, {}
    for k, i, v in sorted(data, key=lambda d: d[1]):
        sums[k] = sums.get(k, 0) + v
        want[i] = (k, sums[k])
    assert {r.i: (r.k, r.s) for r in got} == want
