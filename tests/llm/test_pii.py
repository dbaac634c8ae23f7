"""Personal data: rules against plain patterns, messages against enumeration, and what the field adds and leaves."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from cohortlens.llm import pii, queries

rnd = random.Random(12)


def rules_by_hand(text):
    out = []
    digits = lambda t: re.sub("[^0-9]", "", t)
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    forms = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(digits(t)) <= 19 and luhn(digits(t))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15),
    ]
    for k, (form, ok) in enumerate(forms):
        out += [(m.start(), k, m.end()) for m in re.finditer(form, text) if ok(m.group())]
    return sorted(out)


def card():
    d = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if pii.luhn(d + c))


def phone():
    return f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(0, 9999):04d}"


def prose(n):
    return " ".join(rnd.choice(["thing", "onat", "è", "wer", "then,", "so."]) for _ in range(n))


def entity():
    return rnd.choice([card, phone, lambda: ".".join(str(rnd.randint(1, 255)) for _ in range(4)), lambda: f"ann.{rnd.randint(10, 99)}@mail{rnd.randint(1, 9)}.example.com"])()


def test_rules_are_the_patterns():
    for _ in range(4000):
        t = "".join(rnd.choice(["a", "b1", "@", ".", "1", "25", "256", "4", "-", " ", "+", "(", ")", "+1 (743) 555-38", "a@b.c", "1.2.3.4", "é", "٣", "0001"]) for _ in range(rnd.randint(0, 25)))
        assert pii.rules(t)[0] == rules_by_hand(t), t
    for _ in range(200):
        t = " ".join(rnd.choice([entity(), prose(3)]) for _ in range(10))
        assert pii.rules(t)[0] == rules_by_hand(t)


def test_rules_in_linear_time():
    began = time.time()
    for t in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "+1" + " " * 2_000_000, "a@" * 500_000, "a-" * 500_000 + "@b", "x@" + "a" * 2_000_000):
        pii.rules(t)
    assert time.time() - began < 20


def test_messages_are_exact_on_trees():
    r = np.random.default_rng(0)
    field = pii.Field(r.normal(size=(pii.FEATURES, pii.LABELS)), [r.normal(size=(pii.LABELS, pii.LABELS)) for _ in range(3)])
    t = pii.Tokens("", [], [])
    t.spans, t.label, t.features = [(0, 1)] * 5, np.array([-1, -1, 2, -1, -1]), r.normal(size=(5, pii.FEATURES))
    t.chain, t.same, t.alike = np.array([(0, 1), (1, 2)]), np.array([(1, 3)]), np.array([(0, 4)])
    want = np.zeros((5, pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=5):
        if y[2] == 2:
            s = sum((t.features[i] @ field.weights)[y[i]] for i in (0, 1, 3, 4)) + sum(p[y[a], y[b]] for e, p in zip((t.chain, t.same, t.alike), field.potentials) for a, b in e)
            for i in range(5):
                want[i, y[i]] += np.exp(s)
    want /= want.sum(1, keepdims=True)
    assert np.allclose(field.marginals([t])[0], want, atol=1e-6)
    assert np.allclose(field.marginals([t, t])[1], want, atol=1e-6)


@pytest.fixture(scope="module")
def field():
    return pii.Field.fit(pii.examples([f"{prose(20)} {entity()} {prose(30)} {entity()} {prose(5)}" for _ in range(400)] + [prose(60) for _ in range(200)]))


def spans(field, text):
    found, failed = pii.rules(text)
    t = pii.Tokens(text, found, failed)
    return [text[a:b] for a, _, b in pii.added(text, t, field.marginals([t])[0])] if len(t.spans) else []


def test_field_adds_restated_and_hidden_entities(field):
    """A number that the rules lose beside another one, and other forms of an entity far away in the same document."""
    hits = tried = 0
    for _ in range(60):
        p, c = phone(), card()
        assert rules_by_hand(f"x {p} {c} y") == []
        got = spans(field, f"{prose(20)} {p} {c} {prose(9)}")
        hits += (p in got) + (c in got)
        d = re.sub("[^0-9]", "", p)
        got = spans(field, f"{prose(9)} {p} {prose(300)} call ({d[1:4]}) 555-{d[7:]} now")
        hits += f"({d[1:4]}) 555-{d[7:]}" in got or f"555-{d[7:]}" in got
        slip = str((int(c[0]) + 1) % 10) + c[1:]
        hits += slip in spans(field, f"{slip} {prose(200)} {c}")
        tried += 4
    assert hits / tried > 0.95


def test_field_leaves_other_numbers(field):
    """The same forms without an entity to be tied to stay as they are."""
    for _ in range(200):
        t = f"{prose(9)} {pii._noise(rnd)} {prose(9)} 555-{rnd.randint(0, 9999):04d} in {rnd.randint(1900, 2030)}, v1.2.3 {prose(3)}"
        assert spans(field, t) == []


def test_query_is_the_contract(spark, tmp_path):
    texts = [None, "", " \n ", "é😀 ann.10@mail1.example.com 😀", "+1 (743) 555-3824", "4111 1111 1111 1111", "1.2.3.4 1.2.3.456", "no digits @ all", "7" * 3000, "a.b+c@d-e.f.g@h.i"]
    texts += [f"{prose(10)} {entity()} {prose(4)} {entity()} {entity()}" for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[5]), (None, texts[4])]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS base", "'x' AS spans").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_skip_chain_pii(spark, str(tmp_path)).collect()
    tell = lambda found: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)
    want = []
    for i, t in rows:
        found = rules_by_hand(t or "")
        want.append((i, *(sum(x[1] == k for x in found) for k in range(4)), hashlib.sha256(tell(found).encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r)[:-1] for r in got))) == sorted(map(repr, want))
    more = 0
    for r in got:
        text = dict(rows)[r.doc_id] if r.doc_id is not None else texts[4]
        all_, own = r.spans.split(",") if r.spans else [], tell(rules_by_hand(text or ""))
        assert set(own.split(",")) - {""} <= set(all_)
        cut = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in all_)]
        assert cut == sorted(cut, key=lambda x: (x[0], pii.KINDS.index(x[2])))
        extra = [x for x in cut if f"{x[2]}:{x[0]}:{x[1]}" not in own.split(",")]
        assert not any(a < d and c < b for a, b, _ in extra for c, d, _ in cut if (c, d) != (a, b))
        more += len(extra)
    assert more > 0


def test_without_a_sample(spark):
    df = spark.createDataFrame([(1, "only words"), (2, None)], "doc_id long, text string")
    assert pii.fit(df) is None and pii.fit(df.limit(0)) is None
    assert [r.spans for r in pii.find(df, None).collect()] == [[], []]
    assert pii.find(df.limit(0), None).count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    """A part of many documents is taken, all of few, and repeated rows can't make it large."""
    monkeypatch.setattr(pii, "SAMPLE_DOCS", 50)
    seen = []
    monkeypatch.setattr(pii, "examples", lambda texts: seen.append(texts) or [])
    df = spark.range(5000).selectExpr("id AS doc_id", "concat('a ', id) AS text")
    pii.fit(df)
    pii.fit(df.limit(40))
    pii.fit(spark.range(5000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'n 1' AS text"))
    assert 20 <= len(seen[0]) <= 90 and len(seen[1]) == 40 and len(seen[2]) <= 100
