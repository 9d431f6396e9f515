import itertools
import os
import random
from fractions import Fraction

import pytest

from shutterlake.llm.mixing import block_counts, mix, pfair_schedule, plan_mixture, share_report
from shutterlake.llm.packing import fullest, pack, pack_documents, packing_report
from shutterlake.llm.tokens import DEFAULT_VOCABULARY, count_tokens, encoder


def test_fullest_is_the_best_combination():
    rnd = random.Random(4)
    for _ in range(60):
        items = [rnd.randrange(1, 30) for _ in range(rnd.randrange(0, 9))]
        room = rnd.randrange(0, 60)
        stock = {}
        for i, n in enumerate(items):
            stock.setdefault(n, []).append(i)
        got = fullest(stock, sorted(stock, reverse=True), room)
        best = max(sum(c) for r in range(len(items) + 1) for c in itertools.combinations(items, r) if sum(c) <= room)
        assert sum(got) == best and all(got.count(n) <= len(stock[n]) for n in got)


def first_fit_decreasing(sizes, capacity):
    bins = []
    for n in sorted(sizes, reverse=True):
        i = next((i for i, b in enumerate(bins) if b + n <= capacity), None)
        if i is None:
            bins.append(n)
        else:
            bins[i] += n
    return len(bins)


def test_pack_takes_each_item_once():
    rnd = random.Random(8)
    sizes = [rnd.randrange(1, 101) for _ in range(500)]
    bins = pack(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= first_fit_decreasing(sizes, 100)
    small = [rnd.randrange(1, 40) for _ in range(3000)]
    assert len(pack(small, 100)) == -(-sum(small) // 100)
    assert pack([], 10) == []


DOCS = "doc_id long, n long, bin int, shard string, text string"


def test_pack_documents(rows):
    rnd = random.Random(2)
    sizes = {i: rnd.choice([None, 0, 1, 7, 40, 99, 100, 101, 250, rnd.randrange(1, 90)]) for i in range(600)}
    docs = rows([(i, n, 1, "clash", "x") for i, n in sizes.items()], DOCS)
    out = pack_documents(docs, key="doc_id", tokens="n", capacity=100, shard_items=50).collect()
    by_doc, by_bin = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.container_id, []).append(r.n_tokens)
    for i, n in sizes.items():
        pieces = sorted(by_doc[i], key=lambda r: r.piece_no)
        assert sum(r.n_tokens for r in pieces) == (n or 0)
        assert len(pieces) == max(1, -(-(n or 0) // 100)) and all(r.n_tokens == 100 for r in pieces[:-1])
        assert [r.start_token for r in pieces] == [100 * k for k in range(len(pieces))]
    assert all(sum(b) <= 100 for b in by_bin.values())
    assert all(r.fill == sum(by_bin[r.container_id]) for r in out)
    assert sum(1 for b in by_bin.values() if sum(b)) <= first_fit_decreasing([r.n_tokens for r in out if r.n_tokens], 100) + 3
    assert pack_documents(docs.limit(0), key="doc_id", tokens="n", capacity=100).count() == 0
    assert packing_report(pack_documents(docs.limit(0), key="doc_id", tokens="n", capacity=100), 100).first().n_tokens == 0


@pytest.mark.parametrize("shares", [[0.1, 0.14, 0.08, 0.16, 0.22, 0.12, 0.1, 0.08], [1.0], [0.5, 0.5], [1 / 3, 1 / 3, 1 / 3], [0.7, 0.299999, 0.000001]])
def test_schedule_stays_within_one_block(shares):
    counts = block_counts(shares)
    slots, done = pfair_schedule(counts), [0] * len(counts)
    n = sum(counts)
    for t, s in enumerate(slots, 1):
        done[s] += 1
        assert all(abs(d - Fraction(c * t, n)) < 1 for d, c in zip(done, counts))
    assert done == counts and all(abs(c / n - x) < 1e-3 for c, x in zip(counts, shares))


def test_plan_respects_repeats():
    p = plan_mixture([("a", 0.5, 2, 1000), ("b", 0.5, 1, 100_000), ("none", 0.1, 1, 0), ("zero", 0.0, 3, 10)], 10)
    assert p.sources == ["a", "b"] and p.blocks == [200, 200] and [p.passes(i) for i in (0, 1)] == [2, 1]
    assert plan_mixture([], 10).blocks == []


def test_mixture(rows):
    rnd = random.Random(6)
    docs = [(i, rnd.choice(["a"] * 6 + ["b", "c", None, "other"]), rnd.choice([None, 0, rnd.randrange(1, 50)]), "clash", 1) for i in range(900)]
    d = rows(docs, "doc_id long, source string, n long, slots string, pass_no int")
    t = rows([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    out = mix(d, t, key="doc_id", source="source", tokens="n", block_tokens=64).collect()
    caps = {"a": 1, "b": 3, "c": 2}
    size = {i: n or 0 for i, _, n, _, _ in docs}
    uses = {}
    for r in out:
        uses.setdefault(r.doc_id, set()).add(r.pass_no)
        assert r.n_tokens == size[r.doc_id]
    assert all(len(u) <= caps[docs[i][1]] for i, u in uses.items())
    total = sum(r.n_tokens for r in out)
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        mine = sorted((r for r in out if r.source == s), key=lambda r: (r.start_token, r.n_tokens))
        assert abs(sum(r.n_tokens for r in mine) - w * total) < 64 + 3 * 50
        ends = 0
        for r in mine:  # laid end to end, without gap or overlap
            assert r.start_token == ends and r.block_no == ends // 64
            ends += r.n_tokens
    # At any slot each source has its share but for less than a block and the text that crosses its end.
    for cut in (5, 20, 50):
        got = {s: sum(r.n_tokens for r in out if r.source == s and r.slot < cut) for s in caps}
        assert all(abs(got[s] - w * cut * 64) < 64 + 50 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    rep = {r.source: r for r in share_report(mix(d, t, key="doc_id", source="source", tokens="n", block_tokens=64), t).collect()}
    assert abs(sum(rep[s].actual_share for s in caps) - 1) < 1e-9 and rep[None].mix_tokens == 0
    assert mix(d.limit(0), t, key="doc_id", source="source", tokens="n").count() == 0
    assert mix(d, t.limit(0), key="doc_id", source="source", tokens="n").count() == 0


@pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="needs the vocabulary")
def test_tokens_round_trip():
    for text in ("Hello, world!", "日出 9371\r\n\t  x", "naïve Straße", "<|endoftext|>", "a" * 5000):
        e = encoder(DEFAULT_VOCABULARY)
        assert e.decode(e.encode_ordinary(text)) == text and count_tokens(text) == len(e.encode_ordinary(text))
    assert count_tokens("") == count_tokens(None) == 0


def test_deviation_is_that_of_the_reading_order(rows):
    from shutterlake.llm.mixing import deviation_report, mix

    docs = rows([(i, "abc"[i % 3], 40 + 7 * (i % 11)) for i in range(600)], "doc_id long, source string, n_tokens long")
    targets = rows([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.2, 2), ("d", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mix(docs, targets, key="doc_id", source="source", tokens="n_tokens", block_tokens=256)
    upto, total, over, under = {s: 0 for s in "abc"}, 0, {s: -1e9 for s in "abc"}, {s: 1e9 for s in "abc"}
    read = sorted(((r.slot, r.start_token, r.source, r.n_tokens) for r in m.collect()))
    for i, (slot, _, s, n) in enumerate(read):
        upto[s] += n
        total += n
        if i + 1 == len(read) or read[i + 1][0] != slot:
            for k, w in zip("abc", (0.5, 0.3, 0.2)):
                over[k], under[k] = max(over[k], upto[k] - w * total), min(under[k], upto[k] - w * total)
    got = {r.source: (r.most_over, r.most_under) for r in deviation_report(m, targets).collect()}
    assert got == {s: (pytest.approx(over[s], abs=0.001), pytest.approx(under[s], abs=0.001)) for s in "abc"}
    assert all(abs(x) < 256 + 110 for v in got.values() for x in v)
