import numpy as np
from pyspark.sql import functions as F

from shutterlake.functions import kernels as k
from shutterlake.functions import paths as p
from shutterlake.functions.vectors import contrastive, cosine
from shutterlake.operators import geo


def test_natural_order(spark, rows):
    names = ["img10.jpg", "IMG2.jpg", "img002.jpg", "a", "img1.jpg", "", "img99999999999999999999.jpg"]
    got = [r.n for r in rows([(n,) for n in names], "n string").orderBy(p.natural_key(F.col("n"))).collect()]
    assert got == ["", "a", "img1.jpg", "IMG2.jpg", "img002.jpg", "img10.jpg", "img99999999999999999999.jpg"]


def test_paths(rows):
    df = rows([("C:\\a\\\\b\\",), ("\\\\srv\\x",), (".hidden",), ("a/b.tar.gz",), ("x.",), (None,)], "s string")
    n = [r[0] for r in df.select(p.normalise_path(F.col("s"))).collect()]
    assert n == ["C:/a/b", "//srv/x", ".hidden", "a/b.tar.gz", "x.", None]
    assert [r[0] for r in df.select(p.extension(F.col("s"))).collect()] == ["", "", "", "gz", "", None]
    assert [r[0] for r in rows([("p/_RAW/A.rw2",), ("p/a.jpg",)], "s string").select(p.pair_key(F.col("s"))).collect()] == ["p/a", "p/a"]


def test_vectors(rows):
    df = rows([([1.0, 0.0], [1.0, 0.0], None), ([1.0, 0.0], [-1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0], None), ([1.0], [1.0, 0.0], None), ([float("nan"), 0.0], [1.0, 0.0], None)], "a array<double>, b array<double>, n array<double>")
    got = [tuple(r) for r in df.select(cosine(F.col("a"), F.col("b")), contrastive(F.col("a"), F.col("b"), F.col("n"))).collect()]
    assert got == [(1.0, 1.0), (-1.0, -1.0), (None, None), (None, None), (None, None)]


def test_nearest_place_is_exact(rows):
    rnd = np.random.default_rng(2)
    pts = [(i, float(rnd.uniform(-90, 90)), float(rnd.uniform(-180, 180))) for i in range(60)] + [(99, None, 1.0)]
    places = [(i, float(rnd.uniform(-90, 90)), float(rnd.uniform(-180, 180))) for i in range(900)]
    places += [(900 + i, *places[i][1:]) for i in range(5)]
    got = {r.id: (r.place_id, r.km) for r in geo.nearest_place(rows(pts, "id long, la double, lo double"), rows(places, "place_id long, lat double, lon double"), key="id", lat="la", lon="lo").collect()}
    la, lo = np.array([q[1] for q in places]), np.array([q[2] for q in places])
    for i, x, y in pts[:-1]:
        km = geo._km(x, y, la, lo)
        assert got[i] == (int(km.argmin()), float(km.min()))
    assert 99 not in got
    assert geo.nearest_place(rows(pts, "id long, la double, lo double"), rows([], "place_id long, lat double, lon double"), key="id", lat="la", lon="lo").count() == 0


def test_curve_is_monotone_and_meets_its_points():
    pts = [(0.0, 0.0), (0.2, 0.1), (0.25, 0.8), (1.0, 0.9)]
    c = k.monotone_curve(pts)
    v = c(np.linspace(-0.5, 1.5, 500))
    assert (np.diff(v) >= -1e-12).all() and np.allclose(c(np.array([x for x, _ in pts])), [y for _, y in pts])


def test_cube_identity_and_strength():
    g = np.linspace(0, 1, 5)
    cube = np.stack(np.meshgrid(g, g, g, indexing="ij"), axis=-1)
    x = np.random.default_rng(1).uniform(0, 1, (50, 3))
    assert np.allclose(k.trilinear(cube, x), x) and np.allclose(k.trilinear(1 - cube, x, 0.5), 0.5)


def test_blur_of_edges(rows):
    got = rows([([1.0, 2.0, 6.0],), ([],)], "a array<double>").select(k.box_blur(F.col("a"), 1), k.box_down(F.col("a"), 2)).collect()
    assert [tuple(r) for r in got] == [([1.5, 3.0, 4.0], [1.5, 6.0]), ([], [])]


def test_scalars(rows):
    import hashlib

    from shutterlake.functions import scalars as s

    assert s.fnv1a(b"") == 0xCBF29CE484222325 and s.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    blob = bytes(range(256)) * 5
    df = rows([(bytearray(blob),), (bytearray(b"short"),)], "b binary")
    want = hashlib.sha256(len(blob).to_bytes(8, "little") + blob[:100] + blob[590:690] + blob[-100:]).hexdigest()
    assert [r[0] for r in df.select(s.sampled_sha256(F.col("b"), 100)).collect()] == [want, hashlib.sha256(b"short").hexdigest()]
    names = rows([("IMG_20200230_101010 2020-02-28.jpg",), ("VID-20200502_073256.mov",), ("x",), (None,), ("120200502.jpg",)], "n string")
    assert [r[0] for r in names.select(s.name_datetime(F.col("n"))).collect()] == [1582848000000, 1588404776000, None, None, None]
    assert rows([("2021:02:30 10:00:00",), ("2021:02:03 10:00:00",), ("0000:00:00 00:00:00",)], "t string").select(s.exif_datetime(F.col("t")).alias("m")).toPandas().m.dropna().tolist() == [1612346400000]
    under = rows([("a/b.jpg",), ("a/c/d.jpg",), ("ab/e.jpg",)], "p string").select(s.is_under(F.col("p"), "a", False), s.is_under(F.col("p"), "a/", True), s.is_under(F.col("p"), "", True)).collect()
    assert [tuple(r) for r in under] == [(True, True, True), (False, True, True), (False, False, True)]


def test_concepts_against_single_similarities_and_in_blocks(rows, monkeypatch):
    import random

    from shutterlake.operators import vectors

    rnd = random.Random(4)
    vec = lambda n=5: [rnd.gauss(0, 1) for _ in range(n)]
    v = [(i, vec()) for i in range(20)] + [(30, None), (31, []), (32, vec(4)), (33, [0.0] * 5), (34, [float("nan")] * 5), (35, [float("inf")] + [1.0] * 4)]
    c = [(f"c{i}", vec(), vec() if i % 2 else None) for i in range(9)] + [("zero", [0.0] * 5, None), ("other", vec(3), None), ("c1b", None, None)]
    df, cs = rows(v, "id long, v array<double>"), rows(c, "concept string, positive array<double>, negative array<double>")
    single = df.crossJoin(cs).select("id", "concept", contrastive(F.col("v"), F.col("positive"), F.col("negative")).alias("s")).collect()
    want = {(r.id, r.concept): r.s for r in single}
    got = {(r.id, r.concept): r.score for r in vectors.concept_scores(df, cs, key="id", vector="v").collect()}
    wrong = {k: (got.get(k), want[k]) for k in want if (got.get(k) is None) != (want[k] is None) or (want[k] is not None and abs(got[k] - want[k]) > 1e-9)}
    assert set(got) == set(want) and not wrong, list(wrong.items())[:5]
    for most in (4096, 4):
        monkeypatch.setattr(vectors, "MAX_CONCEPTS", most)
        top = {}
        for r in vectors.top_concepts(df, cs, 3, key="id", vector="v").collect():
            top.setdefault(r.id, {})[r["rank"]] = r.concept
        for i, _ in v:
            best = sorted((-s, c) for (j, c), s in want.items() if j == i and s is not None)[:3]
            assert top.get(i, {}) == {k + 1: c for k, (_, c) in enumerate(best)}
    assert vectors.top_concepts(df, cs.limit(0), 3, key="id", vector="v").count() == 0 and vectors.concept_scores(df, cs.limit(0), key="id", vector="v").count() == 0
