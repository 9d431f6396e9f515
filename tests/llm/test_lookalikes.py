import pytest

from shutterlake.llm.lookalikes import DISPUTED, LOOKALIKES, Conflict, _classes, _composed, canonical, canonical_names, lookalike_pairs, mapping, transducer

SAME = [
    ("Amber Hill", "\uff21mber\u3000Hill"), ("Amber", "\u0410mb\u0435r"), ("HAZY", "h\u0391\u0396\u03a5"), ("caf\u00e9", "cafe\u0301"), ("caf\u00e9", "caf\u0435\u0301"),
    ("affine", "a\ufb03ne"), ("night", "ni\u200bght\u2060"), ("a b", "a\u00a0b "), ("a b", "a\u2007b"), ("\u30d1\u30ce\u30e9\u30de", "\uff8a\uff9f\uff89\uff97\uff8f"),
    ("\u65e5\u51fa", "\u2f47\u51fa"), ("\u6797", "\uf9f4"), ("well-kept", "well\u2010kept"), ("well-kept", "well\u2011kept"), ("K", "\u212a"), ("1951", "\uff11\uff19\uff15\uff11"),
    ("\u30ab\u3099", "\u30ab\u200b\u3099"), ("\u0446\u0438\u0440\u043a", "\u0446\u0438pk"), ("so\u00adft", "soft"), ("\u03c3\u03c2", "\u03a3\u03a3"), ("\u00c5", "\u212b"),
]
DIFFERENT = [
    ("cafe", "caf\u00e9"), ("a b", "ab"), ("a_b", "a b"), ("a-b", "a b"), ("O0", "OO"), ("l1", "ll"), ("rn", "m"), ("stra\u00dfe", "strasse"), ("\u0153uvre", "oeuvre"),
    ("x\u00b2", "x2"), ("\u2460", "1"), ("a  b", "a b"), ("vw", "w"), ("\u30cf", "\u30d1"), ("tag", "tags"), ("\u0438", "\u0439"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert canonical(a) != canonical(b)


def test_basic_characters_stay_apart():
    forms = [canonical(chr(c)) for c in range(33, 127)]
    assert forms == [chr(c).lower() for c in range(33, 127)]


def test_idempotent_and_edges():
    for a, b in SAME + DIFFERENT:
        assert canonical(canonical(a)) == canonical(a) and canonical(canonical(b)) == canonical(b)
    assert canonical("") == "" == canonical("\u200b \u3000") and canonical(None) is None
    long = "\u0430\u0301" * 20_000 + "\u0300" * 5000
    assert canonical(canonical(long)) == canonical(long)


@pytest.mark.parametrize("extra", [[("v", DISPUTED["v"])], [("l", DISPUTED["l"]), ("i", DISPUTED["i"])]])
def test_conflicts_are_refused(extra):
    pairs = [(k, c) for k, cs in LOOKALIKES.items() for c in cs.replace(" ", "")]
    _classes(pairs)
    with pytest.raises(Conflict):
        _classes(pairs + extra)


def test_pairs_and_folded(rows):
    t = rows([(1, "Amber", None, "x"), (2, "\u0410mber", "old", "x"), (3, None, None, "x"), (2, "\u0410mber", "old", "x"), (4, "amber", "amber", "x"), (5, "", None, ""), (6, "\u200b", "", "")], "id long, name string, name_folded string, form string")
    assert sorted(map(tuple, lookalike_pairs(t, key="id", name="name").collect())) == [(1, 2), (1, 4), (2, 4), (5, 6)]
    folded = {r.id: (r.name_folded, r.folded_changed) for r in canonical_names(t).collect()}
    assert folded == {1: ("amber", True), 2: ("amber", True), 3: (None, False), 4: ("amber", False), 5: ("", True), 6: ("", False)}
    assert lookalike_pairs(t.limit(0), key="id", name="name").count() == 0


def test_transducer_agrees_with_mapping_character_by_character():
    import random

    rnd = random.Random(7)
    chars = sorted(mapping()) + [k for k in transducer()[0] if len(k) > 1] * 2 + list("aeiou \u0301\u0308\u3099\u200d\u65e5")
    for _ in range(3000):
        text = "".join(rnd.choice(chars) for _ in range(rnd.randrange(1, 8)))
        assert canonical(text) == _composed(text).strip(" "), ascii(text)


def test_capitals_of_more_scripts_and_slashes():
    for other, plain in (("\u13aa", "A"), ("\u2c9e", "O"), ("\ua4d0", "b"), ("\ua4df", "M"), ("a\u2044b", "a/b"), ("1\u22361", "1:1")):
        assert canonical(other) == canonical(plain)
    assert canonical("\u0131") != canonical("i")


def test_classes_are_the_pairs(rows):
    import itertools

    from shutterlake.llm.lookalikes import lookalike_classes

    t = rows([(1, "Sea"), (2, "\u0455ea"), (3, "sea "), (4, "see"), (5, None), (6, ""), (7, "\u200b"), (2, "\u0455ea"), (8, "See")], "id long, name string")
    classes = {}
    for r in lookalike_classes(t, key="id", name="name").collect():
        classes.setdefault(r.class_id, []).append((r.tag_id, r.n_tags))
    assert {k: sorted(v) for k, v in classes.items()} == {1: [(1, 3), (2, 3), (3, 3)], 4: [(4, 2), (8, 2)], 6: [(6, 2), (7, 2)]}
    pairs = {tuple(r) for r in lookalike_pairs(t, key="id", name="name").collect()}
    assert pairs == {p for v in classes.values() for p in itertools.combinations(sorted(i for i, _ in v), 2)}
