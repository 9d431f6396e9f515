"""Donors of problem 3 where the window disagrees or has none: the value nearest each cell's own prediction."""

import random

from test_impute import KW, MIN, SCHEMA

from shutterlake.operators.impute import fill_missing


def fills(rows, data):
    out = fill_missing(rows([(*d, "exif", "a", "b", "c") for d in data], SCHEMA), **KW).where("field_name = 'width'").collect()
    return {r.id: (r.level, int(r.fill_text), r.donor_id, r.prediction) for r in out}


def test_group_and_window_donors_against_brute_force(rows):
    rnd = random.Random(11)
    data = [(i, rnd.choice("ab"), rnd.choice("mn"), rnd.randrange(0, 2000) * MIN, rnd.choice([None, rnd.randrange(100, 3000, 37)]), 1) for i in range(220)]
    got, seen = fills(rows, data), set()
    for i, g, m, t, w, _ in data:
        if w is not None:
            assert i not in got
            continue
        level, v, donor, p = got[i]
        group = [d for d in data if d[1:3] == (g, m) and d[4] is not None]
        near = [d for d in group if abs(d[3] - t) <= 30 * MIN]
        if len({d[4] for d in near}) != 1:
            best = min((abs(d[4] - p), d[4], d[0]) for d in near or group)
            assert (level, v, donor) == ("window_mixed" if near else "group", *best[1:])
        seen.add(level)
    assert seen == {"window", "window_mixed", "group"}


def test_cells_of_a_group_follow_its_line(rows):
    data = [(k, "a", "m", k * 1000 * MIN, 100 * k, 1) for k in range(1, 10)] + [(20, "a", "m", 1400 * MIN, None, 1), (21, "a", "m", 8600 * MIN, None, 1)]
    got = fills(rows, data)
    assert (got[20][:3], got[21][:3]) == (("group", 100, 1), ("group", 900, 9))


def test_middle_value_of_a_window(rows):
    data = [(1, "a", "m", 0, 100, 1), (2, "a", "m", 10 * MIN, 200, 1), (3, "a", "m", 20 * MIN, 300, 1), (4, "a", "m", 10 * MIN, None, 1)]
    assert fills(rows, data)[4][:3] == ("window_mixed", 200, 2)
