"""Phrases against a walk over all of them."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from cohortlens.llm import phrases

rnd = random.Random(13)


def by_hand(rows, least, most, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for text, lang in rows:
        own = f.setdefault(lang or "und", Counter()) if lang != "" else f.setdefault("", Counter())
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                own.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, own in f.items():
        found = []
        for p, a in own.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and 100 * b >= 100 * a and b >= least and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in own.items()):
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus():
    words = ["a", "b", "B", "ab", "é", "É", "x y", "😀", "c", "d"]
    rows = []
    for _ in range(400):
        parts = []
        for _ in range(rnd.randint(0, 12)):
            w = [rnd.choice(words) for _ in range(rnd.randint(0, 6))]
            if rnd.random() < 0.3:
                w += rnd.choice(["new york city hall gate", "New York", "to be or not to be", "a a a a a a"]).split()
            parts.append(rnd.choice([" ", "\t", "  "]).join(w))
        rows.append((rnd.choice(["", ". ", ", ", "\n", "\r\n", "!? ", "\x0b"]).join(parts), rnd.choice(["en", "en", "de", None, ""])))
    return rows + [(None, "en"), ("", "fr"), (" .,\n", None), ("new york. " * 50, "en"), ("new york " * 50, "en")] + [("twice told tale", "de")] * 8


def listed(df):
    return sorted(tuple(r) for r in df.collect())


def test_all_phrases(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "'x' AS phrase", "1 AS n", "2 AS gid").repartition(3)
    for least, most, top in ((5, 5, 2000), (3, 3, 7), (8, 2, 1)):
        assert listed(phrases.collocations(df, min_count=least, max_words=most, top=top)) == by_hand(rows, least, most, top)
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df, min_count=10**6).count() == 0
    assert dict(phrases.collocations(df.limit(0)).dtypes)["score"] == "bigint"


def test_small_slices_and_groups(spark, monkeypatch):
    """Many slices and groups change nothing."""
    rows = [*corpus(), (" ".join(rnd.choice(["a", "b", "c"]) for _ in range(9000)), "en"), (". ".join(rnd.choice(["a b", "b c d", "c"]) for _ in range(3000)), "de")]
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    monkeypatch.setattr(phrases, "SLICE_WORDS", 500)
    monkeypatch.setattr(phrases, "GROUP_WORDS", 2000)
    assert listed(phrases.collocations(df, min_count=4)) == by_hand(rows, 4, 5, 2000)


def test_windows():
    text = b"ab cd. ef  g,h\n" * 50 + b"x" * 300 + b". tail"
    parts = list(phrases._windows(text, 64))
    assert b"".join(parts) == text and len(parts) > 5
    words = [phrases.split_words(p)[0].to_pylist() for p in parts]
    assert sum(words, []) == phrases.split_words(text)[0].to_pylist()
    assert list(phrases._windows(b"")) == [b""]


def test_packed_numbers_and_pairs():
    for top in (0, 255, 256, 70_000, 1 << 40):
        a = np.array([0, top, 1])
        assert (phrases.unpack(phrases.pack(a)) == a).all()
    assert len(phrases.unpack(phrases.pack(np.zeros(0, np.int64)))) == 0
    g, w = np.array([1, 1 << 40, 1, 1 << 40]), np.array([2, 3, 2, 2])
    assert [len(set(phrases._pairs(*x)[[0, 2]])) for x in ((g, w), (w, g))] == [1, 1] and len(set(phrases._pairs(g, w))) == 3
    words, step = phrases.split_words(" New York. New\tJersey\r\n".encode())
    assert pa.array(words).to_pylist() == [b"new", b"york", b"new", b"jersey"] and step.tolist() == [2, 1, 2, 1]
