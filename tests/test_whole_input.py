"""Queries that take in all rows of their tables, where SQL or an older version left some out."""

import re
import unicodedata

from compare import DATA, connect

from shutterlake.plans import registry

Q = registry.queries()


def normal(s):
    if s is None:
        return None
    s = unicodedata.normalize("NFC", s).replace("\\", "/")
    flat = re.sub("/+", "/", s)
    flat = flat if len(flat) == 1 or re.fullmatch("[A-Za-z]:/", flat) else re.sub("/$", "", flat)
    return "/" + flat if s.startswith("//") else flat


def test_path_normalise_of_every_register(spark, rows, tmp_path):
    data = connect().execute("SELECT register_id, source_path FROM registers").fetchall()
    assert any(s.startswith("\\\\") for _, s in data)
    assert sorted(tuple(r) for r in Q["path_normalise"](spark, DATA).collect()) == sorted((i, normal(s)) for i, s in data)
    assert set(connect().execute(registry.oracle_sql()["path_normalise"]).fetchall()) == set(map(tuple, Q["path_normalise"](spark, DATA).collect()))
    odd = [(1, None), (2, "\\\\srv\\share\\\\e\u0301\\"), (3, "C:\\")]
    rows(odd, "register_id long, source_path string").write.parquet(f"{tmp_path}/registers.parquet")
    assert dict(tuple(r) for r in Q["path_normalise"](spark, str(tmp_path)).collect()) == {1: None, 2: "//srv/share/\u00e9", 3: "C:/"}


def test_reconcile_across_a_skipped_delivery(rows, spark, tmp_path):
    one = lambda no, lib, path, size: (no, lib, path, size, 0, None, None)
    data = [one(1, "a", "x", 1), one(1, "a", "y", 1), one(3, "a", "x", 2), one(3, "a", "z", 9), one(4, "a", "x", 2), one(2, "b", "x", 1)]
    rows(data, "snapshot_no int, repository_id string, rel_path string, size_bytes long, mtime_ms long, volume_serial long, file_id binary").write.parquet(f"{tmp_path}/rescan_files.parquet")
    got = {(r.scope, r.state, r.n) for r in Q["reconcile_snapshots"](spark, str(tmp_path)).collect()}
    assert got == {("a#3", "modified", 1), ("a#3", "missing", 1), ("a#3", "new", 1), ("a#4", "unchanged", 1), ("a#4", "missing", 1)}


def sessions(data, gap):
    out = []
    for user in {u for u, _ in data}:
        run = []
        for t in sorted(t for u, t in data if u == user):
            if run and t - run[-1] >= gap:
                out.append((user, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        out.append((user, run[0], run[-1], len(run)))
    return sorted(out)


def test_stream_sessions_are_all_of_the_batch(spark):
    data = connect().execute("SELECT user_id, epoch_us(ts) FROM events WHERE ts IS NOT NULL").fetchall()
    got = sorted((r.user_id, r.start_ms, r.end_ms, r.n_events) for r in Q["stream_sessions"](spark, DATA).collect())
    assert got == sorted((u, a // 1000, b // 1000, n) for u, a, b, n in sessions(data, 30 * 60_000_000))


def runs(data, quiet, longest):
    out = {}
    for scope, t, item in sorted(data):
        held = out.setdefault(scope, [])
        if held and t - held[-1][1] < quiet and t - held[-1][0] < longest:
            held[-1][1] = t
            held[-1][2].append(item)
        else:
            held.append([t, t, [item]])
    return out


def test_bursts_are_all_of_the_log(spark):
    data = connect().execute("SELECT user_id, epoch_us(ts) // 1000, event_id FROM events WHERE ts IS NOT NULL").fetchall()
    got = sorted((r.scope, r.first_ms, r.last_ms, r.n) for r in Q["stream_debounce"](spark, DATA).collect())
    assert got == sorted((s, a, b, len(i)) for s, rs in runs(data, 600_000, 3_600_000).items() for a, b, i in rs)


def test_notices_list_items_or_ask_for_everything(spark, rows, tmp_path, monkeypatch):
    from shutterlake.streaming import changes

    data = connect().execute("SELECT event_type, epoch_us(ts) // 1000, user_id FROM events WHERE ts IS NOT NULL").fetchall()
    want = sorted((s, a, b, [] if len(set(i)) > changes.MAX_ITEMS else sorted(map(str, set(i)))) for s, rs in runs(data, 60_000, 3_600_000).items() for a, b, i in rs)
    assert sorted((r.scope, r.first_ms, r.last_ms, r["items"]) for r in Q["stream_dirty"](spark, DATA).collect()) == want
    log = [("a", 0, f"d{i}") for i in range(70)] + [("b", 0, "x"), ("b", 100, "y"), ("b", 100, "x"), ("b", 5000, "z")]
    d = rows(log, "scope string, ms long, dir string").selectExpr("scope", "timestamp_millis(ms + 1000000) AS at", "dir")
    d.write.parquet(f"{tmp_path}/log")
    stream = changes.read_log(spark, f"{tmp_path}/log", d.schema)
    out = changes.drain_ended(spark, stream, lambda x: changes.dirty_batches(x, scope="scope", item="dir", at="at"), at="at", work=f"file://{tmp_path}/work")
    assert sorted(map(tuple, out.collect())) == [("a", 1000000, 1000000, []), ("b", 1000000, 1000100, ["x", "y"]), ("b", 1005000, 1005000, ["z"])]
