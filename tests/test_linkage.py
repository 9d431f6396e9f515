"""Linkage queries over their whole input, by brute force."""

import random

from compare import DATA, connect

from shutterlake.operators.linkage import near_names
from shutterlake.plans import registry


def near(a: str, b: str) -> bool:
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    x, y = sorted((a.encode(), b.encode()), key=len)
    if len(x) == len(y):
        return sum(p != q for p, q in zip(x, y)) <= 1
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute(names):
    return sorted((i, j) for i, a in names for j, b in names if i < j and a is not None and b is not None and near(a, b))


def test_near_names_against_brute_force(rows):
    rnd = random.Random(5)
    data = [(i, "".join(rnd.choice("aabé") for _ in range(rnd.randrange(2, 8)))) for i in range(250)] + [(900, None), (901, ""), (902, "cafés"), (903, "cafes")]
    got = [tuple(r) for r in near_names(rows(data, "id long, name string"), key="id", name="name").collect()]
    assert got and sorted(got) == brute(data)


def test_fuzzy_names_are_all_pairs(spark):
    want = brute(connect().execute("SELECT id, name FROM tags").fetchall())
    assert want and sorted(tuple(r) for r in registry.queries()["fuzzy_names"](spark, DATA).collect()) == want


def test_near_names_send_no_variants_through_the_driver(spark, rows, tmp_path):
    path = str(tmp_path / "names")
    rows([(i, f"name {i:04d}") for i in range(2000)] + [(5000, "name 0000 "), (5001, "name 0001")], "id long, name string").write.parquet(path)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "64k")
    try:
        got = {tuple(r) for r in near_names(spark.read.parquet(path), key="id", name="name").collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    digits = [(i, j) for i in range(2000) for j in range(i + 1, 2000) if sum(a != b for a, b in zip(f"{i:04d}", f"{j:04d}")) == 1]
    assert got == {*digits, *((i, 5001) for i in range(2000) if (i, 1) in digits or (1, i) in digits or i == 1), (0, 5000)}


def test_reconcile_names_one_edit_apart_in_one_hot_directory(rows):
    import random

    from shutterlake.operators.linkage import reconcile

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        return min(len(a), len(b)) >= 4 and (a == b or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) or (len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))))

    rnd = random.Random(2)
    name = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randrange(2, 7)))
    disk = [("s", i, f"d/{n}", 5, rnd.choice([0, 1000, 9000]), None) for i, n in enumerate(sorted({name() for _ in range(60)}))]
    db = [("s", 1000 + i, f"d/{n}", 5, rnd.choice([0, 1000, 9000]), None, False) for i, n in enumerate(sorted({name() for _ in range(60)}))]
    paths = {d[2] for d in disk} & {d[2] for d in db}
    left, right = [d for d in disk if d[2] not in paths], [d for d in db if d[2] not in paths]
    taken, want = set(), set()
    for d in sorted(left, key=lambda d: d[1]):
        free = [c[1] for c in sorted(right, key=lambda c: c[1]) if c[1] not in taken and abs(c[4] - d[4]) <= 2000 and near(d[2][2:], c[2][2:])]
        if free:
            taken.add(free[0])
            want.add((d[1], free[0]))
    cols = "scope string, id long, key string, size long, mtime long, ident string"
    out = reconcile(rows(disk, cols), rows(db, cols + ", missing boolean")).where("evidence = 'heuristic'").collect()
    assert {(r.disk_id, r.db_id) for r in out} == want and want
