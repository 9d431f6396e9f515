from shutterlake.operators.snapshots import snapshot_changes

SCHEMA = "snapshot_no int, repository_id string, rel_path string, size_bytes long, mtime_ms long, volume_serial long, file_id binary, snap string, key string"
ID = lambda n: bytes([n] * 16)


def changes(rows, data):
    out = [tuple(r) for r in snapshot_changes(rows([(*d, "clash", "clash") for d in data], SCHEMA)).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_kinds(rows):
    data = [
        (1, "a", "p/keep.jpg", 10, 0, 1, ID(1)), (3, "a", "P\\KEEP.JPG", 10, 2000, 1, ID(1)),  # respelled and within the slack
        (1, "a", "p/old.jpg", 11, 0, 1, ID(2)), (3, "a", "p/new.jpg", 11, 0, 1, ID(2)),  # renamed
        (1, "a", "p/both.jpg", 12, 0, 1, ID(3)), (3, "a", "p/both2.jpg", 13, 0, 1, ID(3)),  # renamed and modified
        (1, "a", "p/time.jpg", 14, 0, None, None), (3, "a", "p/time.jpg", 14, 2001, None, None),  # modified, by path
        (1, "a", "p/zero.jpg", 15, 0, 1, bytes(16)), (3, "a", "p/zero.jpg", 15, 0, 1, bytes(16)),  # zero identity, by path
        (1, "a", "p/gone.jpg", 16, 0, 1, ID(4)), (3, "a", "p/come.jpg", 16, 0, 1, ID(5)),
        (1, "a", "p/e\u0301.jpg", 17, 0, None, None), (3, "a", "p/\u00e9.jpg", 17, 0, None, None),
        (2, "b", "only.jpg", 1, 0, None, None),
    ]
    want = {
        ("a", 3, "renamed", "p/new.jpg"), ("a", 3, "renamed", "p/both2.jpg"), ("a", 3, "modified", "p/both2.jpg"),
        ("a", 3, "modified", "p/time.jpg"), ("a", 3, "missing", "p/gone.jpg"), ("a", 3, "registered", "p/come.jpg"),
    }
    assert changes(rows, data + data[:5]) == want


def test_path_goes_to_no_file_that_identity_took(rows):
    # x moves to y's path by identity; y's old row is missing, the file now at x's path is new.
    data = [(1, "a", "x", 1, 0, 1, ID(1)), (1, "a", "y", 2, 0, 1, ID(2)), (2, "a", "y", 1, 0, 1, ID(1)), (2, "a", "x", 3, 0, 1, ID(3))]
    assert changes(rows, data) == {("a", 2, "renamed", "y"), ("a", 2, "registered", "x"), ("a", 2, "missing", "y")}


def test_nulls_and_shared_identities(rows):
    data = [(1, "a", None, 1, 0, 1, ID(1)), (1, None, "x", 1, 0, 1, ID(1)), (1, "a", "p", None, None, 7, ID(9)), (1, "a", "q", 5, 5, 7, ID(9)), (2, "a", "p", None, None, 7, ID(9)), (2, "a", "q", 5, None, 7, ID(9))]
    assert changes(rows, data) == {("a", 2, "modified", "q")}
    assert changes(rows, []) == set()


def test_hard_links_stay_and_moves_of_one_are_seen(rows):
    # Two paths of one file; one of them is renamed, a third is added.
    data = [(1, "a", "p", 1, 0, 1, ID(1)), (1, "a", "q", 1, 0, 1, ID(1)), (2, "a", "p", 1, 0, 1, ID(1)), (2, "a", "r", 1, 0, 1, ID(1)), (2, "a", "s", 2, 0, 1, ID(1))]
    assert changes(rows, data) == {("a", 2, "renamed", "r"), ("a", 2, "renamed", "s"), ("a", 2, "modified", "s")}


def brute(data):
    """Plain loops over each delivery and the one before, for identities that no two paths of a delivery share."""
    import unicodedata

    usable = lambda d: d[5] is not None and d[6] is not None and any(d[6])
    key = lambda p: unicodedata.normalize("NFC", p.replace("\\", "/").lower())
    by = {}
    for d in data:
        by.setdefault(d[1], {}).setdefault(d[0], {})[key(d[2])] = d
    out = set()
    for lib, snaps in by.items():
        for a, b in zip(sorted(snaps), sorted(snaps)[1:]):
            old, new = snaps[a], snaps[b]
            ids = {d[5:7]: k for k, d in old.items() if usable(d)}
            link = {k: ids[d[5:7]] for k, d in new.items() if usable(d) and d[5:7] in ids}
            taken = set(link.values())
            for k in new:
                if k not in link and k in old and k not in taken:
                    link[k] = k
            for k, d in new.items():
                if k not in link:
                    out.add((lib, b, "registered", d[2]))
                    continue
                o = old[link[k]]
                if link[k] != k:
                    out.add((lib, b, "renamed", d[2]))
                if o[3] != d[3] or abs(o[4] - d[4]) > 2000:
                    out.add((lib, b, "modified", d[2]))
            out |= {(lib, b, "missing", o[2]) for k, o in old.items() if k not in link.values()}
    return out


def test_against_brute_force(rows):
    import random

    rnd = random.Random(5)
    data = []
    for lib in "abc":
        files = {f"d/F{i}.jpg": (rnd.randrange(100), 0, 1, rnd.choice([ID(i + 1), ID(i + 1), None, bytes(16)])) for i in range(40)}
        for snap in (1, 2, 4, 7):
            data += [(snap, lib, p, *f) for p, f in files.items()]
            items = list(files.items())
            rnd.shuffle(items)
            names = [p for p, _ in items]
            moved = names[:6] + [f"d/N{snap}_{k}.jpg" for k in range(4)]
            rnd.shuffle(moved)
            files = {p: (f[0] + (rnd.random() < 0.1), f[1] + rnd.choice([0, 0, 1999, 2500]), *f[2:]) for p, (_, f) in zip(moved[:8] + names[10:], items[2:])}
    assert changes(rows, data + data[:20]) == brute(data)


def test_a_library_without_identities_is_spread_over_all_tasks(spark, rows):
    from pyspark.sql import functions as F

    n = 20_000
    files = spark.range(2 * n).select(
        (F.col("id") % 2 + 1).cast("int").alias("snapshot_no"), F.lit("a").alias("repository_id"), F.format_string("p/%d.jpg", F.floor(F.col("id") / 2)).alias("rel_path"),
        F.lit(1).cast("long").alias("size_bytes"), F.lit(0).cast("long").alias("mtime_ms"), F.lit(None).cast("long").alias("volume_serial"), F.lit(None).cast("binary").alias("file_id"),
    )
    plan = snapshot_changes(files)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join FullOuter" in x]
    assert joins and not any("ident" in x for x in joins) and not any("ident" in x for x in plan.splitlines() if "Window " in x)
    assert snapshot_changes(files).count() == 0
