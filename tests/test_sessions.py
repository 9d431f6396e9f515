import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shutterlake.operators.sessions import sessionise

SCHEMA = "mark_id long, user string, ms long, start_ms string"


def brute(data, gap):
    out, users = set(), {d[1] for d in data}
    for u in users:
        times = sorted({(d[2], d[0]) for d in data if d[1] == u and d[2] is not None}, key=lambda x: x[0])
        run = []
        for t, _ in times:
            if run and t - run[-1] > gap:
                out.add((u, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        if run:
            out.add((u, run[0], run[-1], len(run)))
    return out


def run(rows, data, gap, block):
    got = sessionise(rows(data, SCHEMA), user="user", millis="ms", event="mark_id", gap_ms=gap, block_ms=block).collect()
    assert all(r.duration_ms == r.end_ms - r.start_ms for r in got)
    out = [(r.user, r.start_ms, r.end_ms, r.n_events) for r in got]
    assert len(out) == len(set(out))
    return set(out)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 20), st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-500, 500))), max_size=60), st.sampled_from([5, 30]), st.sampled_from([40, 1000]))
def test_against_brute_force(rows, data, gap, block):
    data = [(*d, "x") for d in data]
    assert run(rows, data, gap, block) == brute(data, gap)


def test_hot_user_repeats_and_exact_gap(rows):
    rnd = random.Random(1)
    data = [(i, "hot", t, "x") for i, t in enumerate(rnd.sample(range(100_000), 800))]
    data += data[:100] + [(5000, "b", 0, ""), (5001, "b", 30, ""), (5002, "b", 61, ""), (5003, "c", None, "")]
    got = run(rows, data, 30, 300)
    assert got == brute(data, 30)
    assert {g for g in got if g[0] == "b"} == {("b", 0, 30, 2), ("b", 61, 61, 1)}


def test_session_longer_than_many_blocks(rows):
    data = [(i, "a", i * 20, "") for i in range(200)]
    assert run(rows, data, 30, 50) == {("a", 0, 3980, 200)}


def test_empty(rows):
    assert run(rows, [], 30, 100) == set()
