import itertools
import random

import numpy as np
import pytest

from shutterlake.llm.batch_dedup import BatchDeduplicator, name_content, replay, winnow
from shutterlake.llm import batch_dedup, store
from shutterlake.llm.store import FingerprintStore, build_filter, may_hold

OPS = "register_id long, run_id long, repository_id string, source_path string, size_bytes long, source_volume_serial long, source_file_id binary, content string, prints string"
NAMES = ["DSC_1.JPG", "dsc_1.jpg", "DSC_1 (2).JPG", "DSC_1 - Copy.JPG", "DSC_1 - Copy (3).JPG", "DSC_1~4.jpg", "DSC_1_copy.JPG", "DSC_1 copy.JPG", "DSC_1 - 副本.JPG", "DSC_1 - Kopie.JPG", "Copy of DSC_1.JPG"]


@pytest.mark.parametrize("name", NAMES)
def test_copy_marks(name):
    assert name_content("E:\\DCIM\\" + name) == name_content("/mnt/x/" + name) == "dsc_1.jpg"


def test_names_that_differ():
    forms = [name_content(x) for x in ("a/DSC_1.JPG", "a/DSC_11.JPG", "a/DSC_1.ARW", "a/final_1.JPG", "a/copy.JPG", "a/(2).JPG", "a/.hidden", "a/E\u0301.jpg")]
    assert len(set(forms)) == len(forms) and forms[-1] == "\u00e9.jpg"
    assert name_content(None) is None and name_content("") is None and name_content("a/b/") == "b"


def test_winnowing_keeps_what_equal_texts_share():
    assert winnow("abcdefghijklmnop") == winnow("abcdefghijklmnop") and winnow("") and winnow("ab")
    a, b = winnow("common-part-of-both/" * 3 + "x"), winnow("y" + "common-part-of-both/" * 3)
    assert set(a) & set(b)


def ops(seed, n=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        size = rnd.choice([None, 0, -5, 1000, 1005, 1006, 40_000, 40_201, 40_202, rnd.randrange(30_000, 60_000)])
        out.append((i, i // 20, rnd.choice(["a", "a", "b", None]), rnd.choice([None, "", *(f"D:\\x{k}\\{m}" for k, m in enumerate(NAMES)), f"u/{rnd.randrange(40)}.raw"]), size, rnd.choice([None, 1, 2]), rnd.choice([None, bytes(16), bytes([1] * 16), bytes([2] * 16), b""]), "clash", "clash"))
    return out + out[:30]


def brute(data):
    from shutterlake.llm.batch_dedup import name_content as key

    usable = lambda d: d[5] is not None and d[6] is not None and any(d[6])
    out = set()
    for d in data:
        first = [
            e[0] for e in data
            if e[2] == d[2] and d[2] is not None and e[1] < d[1] and None not in (d[4], e[4]) and min(d[4], e[4]) >= 0 and abs(d[4] - e[4]) * 1000 <= 5 * max(d[4], e[4])
            and (usable(d) and usable(e) and d[5:7] == e[5:7] or key(d[3]) is not None and key(d[3]) == key(e[3]))
        ]
        if first:
            out.add((min(first), d[0]))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_against_brute_force(rows, batches):
    data = ops(1)
    got = [tuple(r) for r in replay(rows(data, OPS), batches).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data) and got


def one(i, run, path, size=5000, lib="a", volume=None, file=None):
    return (i, run, lib, path, size, volume, file, "", "")


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_history_is_found_across_batches_and_restarts(spark, rows, tmp_path):
    path = f"file://{tmp_path}/h"
    d = BatchDeduplicator(spark, path)
    assert d.check(rows([one(1, 1, "x/P1.JPG"), one(2, 1, "x/P2.JPG", 6000, volume=3, file=bytes([7] * 16))], OPS)).count() == 0
    d.accept()
    again = BatchDeduplicator(spark, path)
    two = [one(3, 2, "y/p1 (2).jpg", 5010), one(4, 2, "y/other.JPG", 6000, volume=3, file=bytes([7] * 16)), one(5, 2, "y/P1.JPG", lib="b"), one(6, 2, "y/P1.JPG", 9000)]
    assert found(again.check(rows(two, OPS))) == [(1, 3), (2, 4)]
    again.accept()
    last = BatchDeduplicator(spark, path)
    assert found(last.check(rows([one(9, 3, "P1.JPG", 9001)], OPS))) == [(6, 9)]
    with pytest.raises(ValueError):
        BatchDeduplicator(spark, path, coverage=0.6)


def test_partitions_of_any_size_keep_the_history(spark, rows, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/h"
    history = [one(i, 1, f"x/HOLIDAY_{i * 7919:07d}.JPG") for i in range(200)]
    monkeypatch.setattr(store, "PARTITION_ENTRIES", 30)
    d = BatchDeduplicator(spark, path)
    d.check(rows(history, OPS)).count()
    d.accept()
    assert d.store.segments[0]["parts"] == 8
    monkeypatch.setattr(store, "PARTITION_ENTRIES", 7)
    batch = [one(1000 + i, 2, f"y/holiday_{i * 7919:07d} (1).jpg") for i in range(200)]
    assert found(BatchDeduplicator(spark, path).check(rows(batch, OPS))) == [(i, 1000 + i) for i in range(200)]


def test_segments_merge_and_repeats_add_nothing(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PARTITION_ENTRIES", 10)
    d = BatchDeduplicator(spark, f"file://{tmp_path}/h")
    for run in range(9):
        d.check(rows([one(run * 100 + i, run, f"x/N{run}_{i:05d}.JPG") for i in range(8)], OPS)).count()
        d.accept()
    assert len(d.store.segments) == 3 and sum(s["entries"] for s in d.store.segments) == 72
    d.check(rows([one(2000 + i, 20, f"x/N0_{i:05d}.JPG") for i in range(8)], OPS)).count()
    d.accept()
    assert sum(s["entries"] for s in d.store.segments) == 72
    kept = {s["name"] for s in d.store.segments} | set(d.store._manifest["retired"])
    assert {p.name for p in (tmp_path / "h").iterdir() if p.name.startswith("segment")} <= kept
    probe = rows([one(3000 + r, 30, f"z/n{r}_00003.jpg") for r in range(9)], OPS)
    assert found(d.check(probe)) == [(r * 100 + 3, 3000 + r) for r in range(9)]


def test_a_look_up_reads_as_much_of_a_long_history_as_of_a_short_one(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PARTITION_ENTRIES", 50)
    read = []
    for n in (400, 4000):
        d = BatchDeduplicator(spark, f"file://{tmp_path}/h{n}")
        d.check(rows([one(i, 1, f"x/HOLIDAY_{i * 7919 % 10**7:07d}.JPG") for i in range(n)], OPS)).count()
        d.accept()
        d.check(rows([one(9000 + i, 2, f"y/HOLIDAY_{i * 7919:07d}.JPG") for i in range(3)] + [one(9100, 2, "y/never seen before.JPG")], OPS)).count()
        keys = d._entries.select("key").distinct()
        chosen = d.store.positives(keys, keys.count())
        read.append(sum((tmp_path / f"h{n}" / s / "rows" / f"part={p}" / f.name).stat().st_size for s, ps in chosen.items() for p in ps for f in (tmp_path / f"h{n}" / s / "rows" / f"part={p}").glob("*.parquet")))
    assert 0 < read[1] < 1.5 * read[0]


def test_two_writers_do_not_overtake_each_other(spark, rows, tmp_path):
    a, b = (BatchDeduplicator(spark, f"file://{tmp_path}/h") for _ in range(2))
    for d, i in ((a, 1), (b, 2)):
        d.check(rows([one(i, i, f"x/P{i}.JPG")], OPS)).count()
    a.accept()
    with pytest.raises(RuntimeError):
        b.accept()
    (tmp_path / "h/_manifest/000000002").write_text('{"no": 2, "se')  # a writer that was lost while it committed
    c = FingerprintStore(spark, f"file://{tmp_path}/h", a.store._manifest["settings"])
    assert c.segments == a.store.segments


def test_filters():
    rnd = np.random.default_rng(1)
    keys, others = (rnd.integers(-(2**63), 2**63 - 1, 20_000) for _ in range(2))
    bits = build_filter(keys)
    assert may_hold(bits, keys).all() and may_hold(bits, others).mean() < 0.01


def covered(a, b):
    a, b = set(winnow(name_content(a))), set(winnow(name_content(b)))
    return len(a & b) / len(a | b)


def edited(rnd, name):
    stem, at = name[:-4], rnd.randrange(4, len(name) - 6)
    return rnd.choice([stem[:at] + rnd.choice("qxz") + stem[at:], stem[:at] + stem[at + 1 :], stem[:at] + rnd.choice("qxz") + stem[at + 1 :]]) + name[-4:]


def test_near_names_against_brute_force_and_planted_edits(spark, rows, monkeypatch):
    monkeypatch.setattr(batch_dedup, "COMMON_SHARE", 20)
    rnd = random.Random(7)
    words = ["holiday", "lake", "mountain", "sunset", "market", "old town", "harbour", "family", "garden", "winter"]
    names = [f"IMG_{rnd.randrange(10**5):05d}_{'_'.join(rnd.sample(words, 4))}_{rnd.randrange(2000, 2020)}.jpg" for _ in range(120)] + ["a.jpg", "b.jpg", "DSC_1.JPG", "DSC_2.JPG"]
    first = [(i, i // 40, rnd.choice("ab"), "x/" + n, rnd.choice([9000, 9040, 20_000])) for i, n in enumerate(names)]
    later = [(1000 + i, 10 + i // 40, lib, "y/" + edited(rnd, n[2:]), size) for i, _, lib, n, size in first[:120]]
    data = [(*r, None, None, "", "") for r in first + later] + [(2000, 30, "a", "z/" + names[0], 9000, None, None, "", "")]
    got = {(r.first_id, r.dup_id): r.coverage for r in replay(rows(data, OPS), 3, coverage=0.6).collect()}
    classes = {}
    for i, run, lib, path, size, *_ in data:
        classes.setdefault((lib, name_content(path), size), (i, run))
    want = {}
    for ((la, na, sa), (ia, ra)), ((lb, nb, sb), (ib, rb)) in itertools.permutations(classes.items(), 2):
        if la == lb and na != nb and ra < rb and abs(sa - sb) * 1000 <= 5 * max(sa, sb) and covered(na, nb) >= 0.6:
            want[ia, ib] = round(covered(na, nb), 6)
    assert got == pytest.approx(want) and want
    planted = [(i, 1000 + i) for i in range(120)]
    assert sum(p in got for p in planted) >= 0.9 * len(planted)


def test_keys_meet_wherever_the_coverage_is_reached():
    rnd = random.Random(3)
    for _ in range(400):
        a = set(rnd.sample(range(60), rnd.randrange(1, 20)))
        b = (a - set(rnd.sample(sorted(a), rnd.randrange(0, min(4, len(a)))))) | set(rnd.sample(range(60), rnd.randrange(0, 3)))
        if b and len(a & b) / len(a | b) >= 0.6:
            ka, kb = (batch_dedup.keys_of([np.array(sorted(x))], np.array([5]), 0.6, np.array(range(10)))[0] for x in (a, b))
            assert set(ka) & set(kb)


def test_nothing_is_near_at_full_coverage(spark, rows, tmp_path):
    d = BatchDeduplicator(spark, f"file://{tmp_path}/h")
    d.check(rows([one(1, 1, "x/P1.JPG")], OPS))
    with pytest.raises(ValueError):
        d.near()


def test_empty(rows):
    assert replay(rows([], OPS)).count() == 0 and replay(rows([], OPS), coverage=0.6).count() == 0
    assert replay(rows([one(1, 1, None), one(2, 2, ""), one(3, 3, "x" * 100_000)], OPS)).count() == 0
