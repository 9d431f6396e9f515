import pytest
from compare import DATA, connect, same

from shutterlake.plans import registry

SQL = registry.oracle_sql()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(spark, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_gives_the_same_rows_again(spark, name):
    one, two = (sorted(map(repr, registry.queries()[name](spark, DATA).collect())) for _ in range(2))
    assert one and one == two


def test_resolved_times_of_every_file(spark):
    import datetime
    import re

    found = re.compile(r"(?<!\d)((?:19|20)\d{2})[-_.]?(\d{2})[-_.]?(\d{2})(?:[-_ T]?(\d{2})[-_.]?(\d{2})[-_.]?(\d{2}))?(?!\d)")

    def named(path):
        for m in found.finditer(path.rsplit("/", 1)[-1]):
            try:
                return int(datetime.datetime(*[int(x or 0) for x in m.groups()], tzinfo=datetime.UTC).timestamp() * 1000)
            except ValueError:
                continue

    want = {}
    for i, path, created, modified in connect().execute("SELECT id, rel_path, file_created_ms, mtime_ms FROM asset_files").fetchall():
        steps = [(named(path), "filename"), (created, "file_created"), (modified, "file_mtime")]
        want[i] = next(((t, s) for t, s in steps if t is not None), (None, None))
    got = {r.id: (r.taken_at, r.taken_at_source) for r in registry.queries()["resolved_times"](spark, DATA).collect()}
    assert got == want and len({s for _, s in want.values()}) > 1


def test_collision_suffixes_of_every_import(spark):
    con, taken = connect(), {}
    for (path,) in con.execute("SELECT rel_path FROM asset_files").fetchall():
        d, _, n = path.rpartition("/")
        taken.setdefault(d, set()).add((n.rpartition(".")[0] or n).lower())
    want = set()
    for i, path in con.execute("SELECT row_no, target_rel FROM new_assets ORDER BY row_no").fetchall():
        d, _, n = path.rpartition("/")
        stem, used, k = n.rpartition(".")[0] or n, taken.setdefault(d, set()), 0
        name = stem
        while name.lower() in used:
            k += 1
            name = f"{stem}_{k:02d}"
        used.add(name.lower())
        want.add((d, i, name))
    assert {tuple(r) for r in registry.queries()["collision_suffixes"](spark, DATA).collect()} == want


def test_instants_of_every_reading(spark):
    from shutterlake.functions.instants import parse_instant

    rows = connect().execute("SELECT DISTINCT t.read_id, t.millis, t.offset_min, r.tz_name FROM taken_reads t LEFT JOIN repositories r USING (repository_id) WHERE millis IS NOT NULL").fetchall()
    want = {(i, at) for i, *x in rows if (at := parse_instant(*x)) is not None}
    for name in ("p1_found", "p1_kept"):
        assert {tuple(r) for r in registry.queries()[name](spark, DATA).collect()} == want


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
