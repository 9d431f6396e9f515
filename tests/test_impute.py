import random

import pytest
from pyspark.sql import functions as F

from shutterlake.operators.impute import fill_missing
from shutterlake.operators.ranges import range_extremes

SCHEMA = "id long, repository_id string, camera_model string, taken_at long, width long, height long, taken_at_source string, field string, v string, donor string"
KW = dict(key="id", group="repository_id", model="camera_model", time="taken_at")
MIN = 60_000


def fills(rows, data, level="window"):
    out = fill_missing(rows([(*d, "a", "b", "c") for d in data], SCHEMA), **KW).collect()
    return {(r.id, r.field_name, r.fill_text) for r in out if r.level == level}, out


def brute(data):
    kinds = {"exif", "sibling", "filename", "file_created", "file_mtime"}
    val = {"width": lambda d: str(d[4]) if d[4] and d[4] > 0 else None, "height": lambda d: str(d[5]) if d[5] and d[5] > 0 else None, "taken_at_source": lambda d: d[6] if d[6] in kinds else None}
    out = set()
    for d in data:
        if None in (d[1], d[2], d[3]):
            continue
        near = [e for e in data if e[1] == d[1] and e[2] == d[2] and e[3] is not None and abs(e[3] - d[3]) <= 30 * MIN]
        for f, get in val.items():
            seen = {get(e) for e in near} - {None}
            if get(d) is None and len(seen) == 1:
                out.add((d[0], f, seen.pop()))
    return out


def test_against_brute_force(rows):
    rnd = random.Random(3)
    data = [
        (i, rnd.choice(["a", "b", None]), rnd.choice(["m", "m", None]), rnd.choice([None, rnd.randrange(0, 300) * MIN]), rnd.choice([None, -1, 0, 600, 600, 600]), rnd.choice([None, 400, 400, 300]), rnd.choice([None, "", "exif", "exif", "sibling", "?"]))
        for i in range(250)
    ]
    got, out = fills(rows, data + data[:40])
    assert got == brute(data)
    values = {d[0]: d for d in data}
    for r in out:  # every fill is a donor's own value, never a prediction
        i = {"width": 4, "height": 5, "taken_at_source": 6}[r.field_name]
        assert str(values[r.donor_id][i]) == r.fill_text and values[r.donor_id][2] == values[r.id][2]
    assert len({(r.id, r.field_name) for r in out}) == len(out)


def test_exactly_half_an_hour_counts(rows):
    data = [(1, "a", "m", 0, None, 1, "exif"), (2, "a", "m", 30 * MIN, 9, 1, "exif"), (3, "a", "n", 0, None, 1, "exif"), (4, "a", "n", 30 * MIN + 1, 9, 1, "exif")]
    assert fills(rows, data)[0] == {(1, "width", "9")}
    assert fills(rows, data, "group")[0] == {(3, "width", "9")}


def test_nothing_to_go_by(rows):
    assert fills(rows, [])[1] == []
    assert fills(rows, [(1, "a", "m", 0, None, None, None)])[1] == []


def test_range_extremes_against_brute_force(spark, rows):
    rnd = random.Random(9)
    pts = {(g, x): rnd.randrange(1000) for g in "ab" for x in rnd.sample(range(3000), 200)}
    p = rows([(g, x, v) for (g, x), v in pts.items()], "g string, x long, v long")
    near = range_extremes(p, p.select("g", "x"), group=["g"], at="x", lo=F.col("x") - 100, hi=F.col("x") + 100, block=lambda c: F.floor(c / F.lit(100)), least=["v"], most=["v"])
    for r in near.collect():
        seen = [v for (g, x), v in pts.items() if g == r.g and abs(x - r.x) <= 100]
        assert (r.least_v, r.most_v) == (min(seen), max(seen))


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_range_extremes_of_inputs_that_are_partitioned_alike(spark, rows, broadcast):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        rnd = random.Random(4)
        p = rows([(g, x, rnd.randrange(1000)) for g in range(300) for x in rnd.sample(range(1000), 3)], "g int, x long, v long")
        p = p.join(p.groupBy("g").count().where("count > 1"), "g", "left_semi")
        near = range_extremes(p, p.select("g", "x"), group=["g"], at="x", lo=F.col("x") - 50, hi=F.col("x") + 50, block=lambda c: F.floor(c / F.lit(50)), least=["v"], most=["v"])
        data = [tuple(r) for r in p.collect()]
        got = {(r.g, r.x): (r.least_v, r.most_v) for r in near.collect()}
        for g, x, _ in data:
            seen = [v for h, y, v in data if h == g and abs(x - y) <= 50]
            assert got[g, x] == (min(seen), max(seen))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
