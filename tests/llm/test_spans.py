import itertools
import random

import numpy as np

from shutterlake.llm import spans
from shutterlake.llm.spans import COVER, PERIOD, code_points, cover_positions, shared_share, span_groups, span_pairs, window_hashes

DOCS = "doc_id long, text string, id long, span string"


def test_cover_brings_any_two_positions_onto_it():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    for i, j in itertools.product(range(PERIOD), repeat=2):
        assert any((i + k) % PERIOD in COVER and (j + k) % PERIOD in COVER for k in range(PERIOD))


def test_hash_depends_on_the_window_only():
    c = code_points("abcabcabc" * 50 + "\U0001f600x")
    h = window_hashes(c, 6, np.arange(len(c) - 5))
    by = {}
    for i, x in enumerate(h):
        by.setdefault(x, set()).add(c[i : i + 6].tobytes())
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({c[i : i + 6].tobytes() for i in range(len(c) - 5)})
    assert list(cover_positions(78, 78)) == [0] and len(cover_positions(77, 78)) == 0


def corpus(seed, n=60, length=150):
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice("abcdefgh éß日\U0001f600") for _ in range(k))
    shared = [word(rnd.choice([length - 1, length, length + 1, length + 200])) for _ in range(12)]
    docs = []
    for i in range(n):
        text = word(rnd.randrange(0, 300))
        for s in rnd.sample(shared, rnd.randrange(0, 3)):
            text += s + word(rnd.randrange(1, 90))
        docs.append((i, text, 7, "clash"))
    return docs + [(900, None, 7, ""), (901, "", 7, ""), (902, shared[0], 7, ""), docs[0], (903, docs[1][1], 7, ""), (904, "z" * 400, 7, ""), (905, "zy" * 200, 7, "")]


def brute(docs, length=150):
    where = {}
    for i, t, *_ in docs:
        for k in range(len(t or "") - length + 1):
            where.setdefault(t[k : k + length], set()).add(i)
    return {p for s in where.values() for p in itertools.combinations(sorted(s), 2)}, where


def test_pairs_against_brute_force(rows):
    for seed in (1, 2):
        docs = corpus(seed)
        got = [tuple(r) for r in span_pairs(rows(docs, DOCS), key="doc_id", text="text", length=150).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs)[0] and got


def test_groups_hold_the_same_pairs(rows):
    docs = corpus(6)
    groups, text = {}, {}
    for i, t, *_ in docs:
        text.setdefault(i, t or "")
    for r in span_groups(rows(docs, DOCS), key="doc_id", text="text", length=150).collect():
        groups.setdefault((r.group_id, r.passage), []).append(r)
        assert r.passage in text[r.doc_id] and len(r.passage) == 150
    pairs = {p for g in groups.values() for p in itertools.combinations(sorted(r.doc_id for r in g), 2)}
    assert pairs == brute(docs)[0] and all(r.n_docs == len(g) and r.group_id == min(x.doc_id for x in g) for g in groups.values() for r in g)


def test_equal_hashes_of_other_passages_are_no_span(rows, monkeypatch):
    real = spans.window_hashes
    monkeypatch.setattr(spans, "window_hashes", lambda chars, width, at: real(chars, width, at) % np.uint64(1009))
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdef") for _ in range(n))
    anchor, passage = word(149), word(150)
    docs = [(i, word(3) + anchor + word(9), 1, "") for i in range(6)] + [(10, passage, 1, ""), (11, passage, 1, "")]
    assert {tuple(r) for r in span_pairs(rows(docs, DOCS), key="doc_id", text="text", length=150).collect()} == brute(docs)[0]


def test_long_texts_in_segments(rows, monkeypatch):
    monkeypatch.setattr(spans, "SEGMENT", 1024)
    rnd = random.Random(3)
    passage = "".join(rnd.choice("abcdef") for _ in range(150))
    long = [("".join(rnd.choice("abcdef") for _ in range(20_000))) for _ in range(3)]
    for at, width in ((5000, 78), (1020, 78)):
        t = long[0][:at] + passage + long[0][at:]
        pieces = list(spans._anchors([1], [t], width))
        pos = np.concatenate([p for _, _, p in pieces])
        assert sorted(pos) == list(cover_positions(len(t), width))
    docs = [(i, long[i][: 997 * (i + 1)] + passage + long[i][997 * (i + 1) :], 1, "") for i in range(3)]
    got = {tuple(r) for r in span_pairs(rows(docs, DOCS), key="doc_id", text="text", length=150).collect()}
    assert got == {(0, 1), (0, 2), (1, 2)}


def test_hot_passage_over_many_flushes(rows, monkeypatch):
    layout = spans._Layout(3000)
    blobs = spans._anchor_blobs(78, layout)
    rnd = random.Random(5)
    p = "".join(rnd.choice("abcdef") for _ in range(160))
    import pandas as pd

    monkeypatch.setattr(spans, "FLUSH", 50)
    texts = [p + "".join(rnd.choice("abcdef") for _ in range(100)) for _ in range(40)]
    out = pd.concat(list(blobs(iter([pd.DataFrame({"id": range(40), "text": texts})]))))
    found = pd.concat([spans._shared_anchors(layout)(g) for _, g in out.groupby("part")])
    spots = {}
    for i, s, h in zip(found.id, found.spots, found.hashes):
        at = cover_positions(260, 78)
        hit = np.isin(window_hashes(code_points(texts[i]), 78, at) & layout.mask, np.asarray(h, dtype=np.int64).view(np.uint64))
        spots.setdefault(i, set()).update(np.asarray(s, dtype=np.int64).tolist(), at[hit].tolist())
    want = {k for k in cover_positions(260, 78).tolist() if k + 78 <= 160}
    assert len(spots) == 40 and all(want <= s for s in spots.values())


def test_share(rows):
    docs = corpus(4)
    want = brute(docs)[1]
    cover = {}
    for i, t, *_ in docs:
        mark = np.zeros(len(t or ""), bool)
        for k in range(len(t or "") - 149):
            if len(want[t[k : k + 150]]) > 1:
                mark[k : k + 150] = True
        cover[i] = int(mark.sum())
    got = {r.doc_id: r for r in shared_share(rows(docs, DOCS), key="doc_id", text="text", length=150).collect()}
    assert {i: r.shared_chars for i, r in got.items()} == cover
    assert got[900].shared_share == 0.0 and got[902].n_chars == len(docs[62][1])


def test_nothing(rows):
    assert span_pairs(rows([], DOCS), key="doc_id", text="text", length=150).count() == 0
    assert span_pairs(rows([(1, None, 1, ""), (2, "", 1, ""), (3, "x" * 149, 1, ""), (4, "x" * 149, 1, "")], DOCS), key="doc_id", text="text", length=150).count() == 0


def test_two_steps_find_the_same(rows, monkeypatch):
    monkeypatch.setattr(spans, "FLUSH_PARTS", 3)
    monkeypatch.setattr(spans, "STEP_TASKS", 2)
    assert spans._Layout(100).together == 3
    docs = corpus(9)
    assert {tuple(r) for r in span_pairs(rows(docs, DOCS), key="doc_id", text="text", length=150).collect()} == brute(docs)[0]
