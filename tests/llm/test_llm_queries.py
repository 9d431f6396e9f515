import pytest
from compare import DATA, same

from shutterlake.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(spark, registry.queries()[name], SQL[name])


@pytest.fixture(scope="module")
def run(spark):
    """The rows of a query over whole tables, read once."""
    held = {}
    return lambda name: held.setdefault(name, registry.queries()[name](spark, DATA).collect())


def test_packing_of_all_documents(spark, run):
    from shutterlake.llm.queries import CAPACITY
    from shutterlake.llm.tokens import token_count

    sizes = {r.doc_id: r.n for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", token_count("text").alias("n")).collect()}
    fill, pieces = {}, {}
    for r in run("p8_packed"):
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
    assert set(pieces) == set(sizes) and max(fill.values()) <= CAPACITY
    for doc, parts in pieces.items():
        parts.sort()
        assert sum(n for _, n in parts) == sizes[doc] and (len(parts) == 1 or sizes[doc] > CAPACITY)
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    least = -(-sum(sizes.values()) // CAPACITY)
    (report,) = run("p8_report")
    assert (report.n_containers, report.n_tokens, report.least_containers) == (len(fill), sum(sizes.values()), least) and len(fill) <= least * 1.02 + 1


def test_mixture_of_all_sources(spark, run):
    targets = {r.source: r for r in spark.read.parquet(f"{DATA}/mix_targets.parquet").collect()}
    uses, tokens, own = {}, {}, {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source").collect()}
    for r in run("p9_mixture"):
        assert own[r.doc_id] == r.source
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
        tokens[r.source] = tokens.get(r.source, 0) + r.n_tokens
    assert all(n <= targets[own[d]].max_repeats for d, n in uses.items())
    longest = max(r.n_tokens for r in run("p9_mixture"))
    for r in run("p9_shares"):
        assert r.mix_tokens == tokens.get(r.source, 0) and abs(r.mix_tokens - targets[r.source].target_share * sum(tokens.values())) <= 1024 + longest
    for r in run("p9_deviation"):
        assert -1024 - longest <= r.most_under <= r.most_over <= 1024 + longest


def test_look_alikes_of_all_tags(spark, run):
    import itertools

    from shutterlake.llm.lookalikes import canonical

    forms, classes = {}, {}
    for r in spark.read.parquet(f"{DATA}/tags.parquet").select("id", "name").collect():
        if r.name is not None:
            forms.setdefault(canonical(r.name), set()).add(r.id)
    pairs = {p for ids in forms.values() for p in itertools.combinations(sorted(ids), 2)}
    assert {tuple(r) for r in run("p7_found")} == pairs and pairs
    for r in run("p7_classes"):
        classes.setdefault(r.class_id, set()).add(r.tag_id)
    assert sorted(map(sorted, classes.values())) == sorted(sorted(i) for i in forms.values() if len(i) > 1)
    assert {r.id: r.name_folded for r in run("p7_folded") if r.name_folded is not None} == {i: f for f, ids in forms.items() for i in ids}


def test_groups_of_all_documents_are_the_pairs(run):
    import itertools

    groups = {}
    for r in run("p10_groups"):
        groups.setdefault((r.group_id, r.passage), set()).add(r.doc_id)
    assert {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)} == {tuple(r) for r in run("p10_found")}


def test_near_names_of_all_registers(spark, run):
    from shutterlake.llm.batch_dedup import name_content, winnow

    rows = spark.read.parquet(f"{DATA}/registers.parquet").select("register_id", "run_id", "repository_id", "source_path", "size_bytes").collect()
    classes, want = {}, set()
    for r in sorted(set(map(tuple, rows)), key=lambda r: (r[1], r[0])):
        if r[4] is not None and r[4] >= 0 and name_content(r[3]) is not None:
            classes.setdefault((r[2], name_content(r[3]), r[4]), r[:2])
    prints = {k: set(winnow(k[1])) for k in classes}
    for (a, (ia, ra)) in classes.items():
        for b, (ib, rb) in classes.items():
            if a[0] == b[0] and ra < rb and a[1] != b[1] and abs(a[2] - b[2]) * 1000 <= 5 * max(a[2], b[2]) and len(prints[a] & prints[b]) / len(prints[a] | prints[b]) >= 0.6:
                want.add((ia, ib))
    assert {(r.first_id, r.dup_id) for r in run("p4_near")} == want


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    import shutterlake

    root = Path(shutterlake.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "shutterlake.llm" in p.read_text()]
