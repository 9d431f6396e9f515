from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shutterlake.sources import files as fs
from shutterlake.streaming import changes as s


def test_listing_and_skips(spark, tmp_path):
    for name, data in (("a/x.jpg", b"1"), ("a/.hid/y.jpg", b"1"), ("Thumbs.db", b"1"), ("e.png", b""), ("n.txt", b"1"), ("b/z.RW2", b"22")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = fs.list_files(spark, str(tmp_path))
    assert {(r.rel_path, r.size_bytes) for r in got.collect() if not r.rel_path.startswith("a/.")} >= {("a/x.jpg", 1), ("b/z.RW2", 2)}
    assert {r.rel_path for r in fs.classify(got).where("skip is null").collect()} == {"a/x.jpg", "b/z.RW2"}


def test_gazetteer(spark, tmp_path):
    line = lambda i, name, lat, lon, pop: "\t".join([str(i), name, "", "", lat, lon, "", "", "DE", "", "", "", "", "", pop])
    (tmp_path / "c.txt").write_text("\n".join(["# note", line(1, "Köln", "50.9", "6.9", "100"), line(2, "Bad", "x", "1", "5"), line(3, "Nopop", "1", "2", "?"), "short\trow", ""]))
    assert {(r.name, r.population) for r in fs.read_gazetteer(spark, str(tmp_path / "c.txt")).collect()} == {("Köln", 100), ("Nopop", 0)}


def test_sidecar_round_trip(spark, rows):
    a = rows([(1, 4, "red", 'A "b" & <c>', "X", ["k & l", "m"]), (2, None, None, None, None, [])], "id long, rating int, color_label string, city string, country string, words array<string>")
    xml = a.select("id", fs.compose_sidecar(F.col("rating"), F.col("color_label"), F.col("city"), F.col("country"), F.col("words")).alias("xml"))
    got = {r.id: (r.rating, r.color_label, r.city, r.country, r.keywords) for r in fs.parse_sidecars(xml).collect()}
    assert got == {1: (4, "red", 'A "b" & <c>', "X", ["k & l", "m"]), 2: (None, None, None, None, [])}
    bad = fs.parse_sidecars(rows([("not xml",), (None,), ("",)], "xml string")).collect()
    assert all(r.rating is None and r.city is None for r in bad)


def test_adopt_only_untouched(rows):
    a = rows([(1, 0, None), (2, 3, None), (3, 0, "")], "id long, rating int, city string")
    got = fs.adopt_sidecars(a, rows([(1, 5, "X"), (2, 5, "X")], "asset_id long, rating int, city string"), ["rating", "city"])
    assert sorted(map(tuple, got.collect())) == [(1, 5, "X"), (2, 3, None), (3, 0, "")]


def test_bursts():
    closed, held = s.bursts([0, 100, 250, 500, 600, 700, 800, 900, 1000, 1100, 1200, 1300, 1400, 1499, 1500], None, 200, 1000)
    assert closed == [(0, 250, 3), (500, 1499, 11)] and held == (1500, 1500, 1)
    assert s.bursts([], (1, 2, 2), 200, 1000) == ([], (1, 2, 2))


def test_debounce_stream(spark, rows, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = [0, 0.1, 0.15, 5, 100]
    rows([("a", t0 + timedelta(seconds=x)) for x in at], "scope string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    log = s.read_log(spark, f"{tmp_path}/in", "scope string, at timestamp")
    got = s.drain(s.debounce(log, scope="scope", at="at"), f"{tmp_path}/out", f"{tmp_path}/ck").collect()
    base = int((t0 - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert {(r.first_ms - base, r.last_ms - base, r.n) for r in got} >= {(0, 150, 3), (5000, 5000, 1)}
