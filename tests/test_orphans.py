import random
from datetime import datetime, timedelta

import pytest

from shutterlake.operators.orphans import BUCKET_BITS, key_runs, orphan_references

T0 = datetime(2020, 1, 1)
REFS = "mark_id long, repo string, asset_id long, at timestamp, id string"
PARENTS = "id long, repo string, born timestamp, gone timestamp, at string"
KW = dict(ref_id="mark_id", ref_key="asset_id", ref_time="at", parent_key="id", born="born", gone="gone", scope="repo")


def brute(refs, parents):
    out = set()
    for m, repo, key, at, _ in refs:
        if key is None:
            continue
        ps = [p for p in parents if p[0] == key and p[1] == repo and repo is not None]
        if not ps:
            out.add((m, "missing"))
        elif at is None:
            continue
        elif (b := min((p[2] for p in ps if p[2]), default=None)) and b > at:
            out.add((m, "later"))
        elif all(p[3] for p in ps) and max(p[3] for p in ps) <= at:
            out.add((m, "deleted"))
    return out


def test_against_brute_force(rows):
    rnd = random.Random(5)
    day = lambda n: T0 + timedelta(days=n)
    edge = 1 << BUCKET_BITS
    keys = [*range(10, 60), *range(edge - 5, edge + 5), 3 * edge, -4, -3]
    parents = [(k, rnd.choice("ab"), day(rnd.randrange(50)), day(rnd.randrange(50, 100)) if rnd.random() < 0.4 else None, "clash") for k in keys if rnd.random() < 0.7]
    refs = [(i, rnd.choice(["a", "b", None]), rnd.choice([*keys, None, 7, 10**12]), rnd.choice([day(rnd.randrange(100)), None]), "x") for i in range(400)]
    refs += refs[:50] + [(1000 + i, "a", 12, day(i % 99), "hot") for i in range(300)]
    got = {(r.ref_id, r.orphan_kind) for r in orphan_references(rows(refs, REFS), rows(parents, PARENTS), **KW).collect()}
    assert got == brute(refs, parents)


def test_a_run_ends_where_a_key_is_lacking(rows):
    runs = key_runs(rows([(1, "a"), (2, "a"), (2, "a"), (4, "a"), (3, "b"), (None, "a"), (5, None)], "id long, s string"), "s", "id")
    assert sorted((r.s, r.run_start, r.run_end) for r in runs.collect()) == [("a", 1, 2), ("a", 4, 4), ("b", 3, 3)]


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(rows, n):
    refs = [(1, "a", 5, T0, "x")][:n]
    assert orphan_references(rows(refs, REFS), rows([], PARENTS), **KW).count() == n
    assert orphan_references(rows([], REFS), rows([(5, "a", T0, None, "x")], PARENTS), **KW).count() == 0


def test_exact_borders(rows):
    parents = [(1, "a", T0, T0 + timedelta(seconds=10), "")]
    refs = [(1, "a", 1, T0 - timedelta(microseconds=1), ""), (2, "a", 1, T0, ""), (3, "a", 1, T0 + timedelta(seconds=10), "")]
    got = {(r.ref_id, r.orphan_kind) for r in orphan_references(rows(refs, REFS), rows(parents, PARENTS), **KW).collect()}
    assert got == {(1, "later"), (3, "deleted")}
