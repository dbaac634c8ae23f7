"""The training-data operators on small fixtures: brute force, round trips, held-out rows and odd input."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import ann, bpe, html, langid, lines, minhash, mixing, quality, substrings, toxicity

rnd = random.Random(3)
WORDS = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(400)]


def words(n, seed=None):
    r = random.Random(seed) if seed is not None else rnd
    return " ".join(r.choice(WORDS) for _ in range(n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "src1", 0), (3, "  \n\t ", "en", "src1", 5), (4, "x" * 50_000, "de", "src2", 1), (5, "ok\nok\nok", None, "src2", 8), (5, "ok\nok\nok", None, "src2", 8), (None, "no id here", "en", None, 10), (6, "😀 éÉ   \u0085", "fr", "s", 3)]
ODD = [(i, t.encode("utf-16", "surrogatepass").decode("utf-16") if t else t, a, b, c) for i, t, a, b, c in ODD]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


# ---- line dedup


def lines_by_hand(rows, least=20, docs=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(low)
    held = {}
    for i, t, *_ in rows:
        if i is not None and t is not None:
            for x in t.split("\n"):
                if len(key(x)) >= least:
                    held.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= docs}
    out = []
    for i, t, *_ in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if i is None or t is None or key(x) not in gone or gone[key(x)] == i]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines(spark, odd):
    hot = "A LINE that Many documents É share"
    rows = [(i, f"{words(3)}\n {hot.lower().replace('É'.lower(), 'É')}\t\n{words(5)}\n{hot}", "en", "s", 1) for i in range(40)] + [(90, "short", "en", "s", 1), (91, hot.replace("É", "é"), "en", "s", 1)] + ODD
    df = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit("clash")).withColumn("__n", F.lit(1))
    out = lines.drop_common_lines(df)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()), key=repr)
    assert got == lines_by_hand(rows)
    assert lines.drop_common_lines(df.limit(0)).count() == 0


# ---- mixing


def test_mixing_budgets(spark):
    leaves = spark.createDataFrame([("a", "en", "x", 100), ("a", "en", "y", 1000), ("a", "de", "z", 50), ("b", "en", "w", 5000)], "__domain string, __lang string, __source string, __tokens long")
    got = {r[2]: r[3] for r in mixing.leaf_budgets(leaves, {"domain": {"a": 1, "b": 1}}, 2000 / 6150, 1.0).collect()}
    # a gets 1000: de holds 50 of its 500, so en gets 950: x is full with 100, y takes the rest
    assert got == {"x": 100, "y": 850, "z": 50, "w": 1000}
    zero = {r[2]: r[3] for r in mixing.leaf_budgets(leaves, {"domain": {"b": 0}}, 1.0, 1.0).collect()}
    assert zero["w"] == 0 and zero["y"] == 1000


def test_mixing_prefix(spark, odd):
    rows = [(i, words(1 + i % 50), "en" if i % 3 else "de", f"src{i % 5}", 1) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_sources(df, {"source": {"src0": 9}}, 0.5, 2.0).collect()
    assert len(out) == 600 and sum(r.n_tokens for r in out) == sum(1 + i % 50 for i in range(600))
    total = sum(r.n_tokens * r.copies for r in out)
    assert 0.9 * 0.5 * sum(r.n_tokens for r in out) < total <= 0.5 * sum(r.n_tokens for r in out)
    by = {}
    for r in out:
        by.setdefault((r.domain, r.lang, r.source), []).append(r)
    for leaf in by.values():
        full = min(r.copies for r in leaf)
        order = sorted(leaf, key=lambda r: (hashlib.md5(f"17:{full}:{r.doc_id}".encode()).hexdigest(), r.doc_id))
        taken = [r.copies - full for r in order]
        assert taken == sorted(taken, reverse=True) and set(taken) <= {0, 1}
    strange = mixing.mix_sources(odd.withColumn("copies", F.lit("clash")), {}, 0.9, 2.0)
    assert strange.count() == len(ODD) and strange.where("doc_id = 5").select("copies").distinct().count() == 1
    assert mixing.mix_sources(df.limit(0), {}).count() == 0


# ---- byte-level BPE


def test_bpe_equals_tiktoken(spark, odd):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["<|endoftext|> a", "a  b", " a", "a ", "a \n b", "it's 'S x", "\x1c \x1d", "é è ê", "日本 語", "🙂🙂 🙂", "1 22  333", "a  b", "\n\n \n", "x" * 3000, words(200)] + ["".join(rnd.choice(" \n\t'aé1.🙂 \x85　") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(df, offsets=True)).orderBy("doc_id").collect()
    for t, r in zip(texts, out, strict=True):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == ref.encode_ordinary(t), repr(t)
        assert bytes(r.decoded) == t.encode()
        raw = t.encode()
        assert r.byte_at == [sum(len(ref.decode_single_token_bytes(x)) for x in ids[:k]) for k in range(len(ids))]
        assert all(len(raw[:b].decode(errors="ignore")) in (c, c + 1) for b, c in zip(r.byte_at, r.char_at, strict=True))
    d = {(r.doc_id, r.n_tokens) for r in bpe.digests(odd).collect()}
    assert (1, 0) in d and (2, 0) in d and bpe.digests(odd.limit(0)).count() == 0


# ---- main text


def page(article, extra=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li>Menu</ul></nav><div class='ad'>Buy</div>{extra}<article>{article}</article><div id=comments><p>first!</p></div><footer>&copy; F</footer>"


def test_html(spark):
    rows = [
        (1, "http://h/1", page("<h1>A &amp; B</h1><p><b>one\n two<br><p>three&nbsp;four</p><script>var t='</p>';</script>")),
        (2, "http://h/2", None), (3, None, ""), (4, "http://h/4", "<p>plain <i>in</i>line<p>second<div hidden>no</div>"), (5, "http://h/5", "no markup at all & <"), (5, "http://h/5", "no markup at all & <"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash")).withColumn("uid", F.lit(1))
    got = sorted((r.page_id, r.text) for r in html.main_text(df).collect())
    assert got[0] == (1, "A & B\none two\nthree four") and got[1] == (2, "") and got[2] == (3, "")
    assert got[3] == (4, "plain inline\nsecond") and got[4][1].startswith("no markup at all &")
    assert html.main_text(df.limit(0)).count() == 0


def test_templates(spark):
    """A box on many pages of one host goes there, inside the article too; paragraphs and other hosts' boxes stay."""
    box = "<div class=tip><p>Read our other stories</p></div>"
    rows = [(i, f"http://a.x/{i}", page(f"<p>Common paragraph</p>{box}<p>{words(6)}</p>")) for i in range(12)] + [(50 + i, f"http://b.x/{i}", page(f"{box}<p>{words(6)}</p>")) for i in range(3)]
    rows += [(80 + i, "http://c.x/", page("<div><p>Copied page</p></div>")) for i in range(30)] + [(120, "http://a.x/none", f"{box}<p>bare</p>")]
    out = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Common paragraph" in out[i] and "other stories" not in out[i] for i in range(12))
    assert all("other stories" in out[50 + i] for i in range(3)) and all(out[80 + i] == "Copied page" for i in range(30)) and out[120] == "bare"


def test_wrappers_and_small_hosts(spark):
    """Class words take no article or main with them and no text in these; boxes of hosts with few pages go by their share."""
    box = "<div class=tip><p>Read our other stories</p></div>"
    rows = [
        (1, "http://w.x/1", "<body><div class='with-sidebar'><article><p>A</p><p class='notice'>B</p><section id='menu'><p>C</p></section></article></div><div class=ad>x</div>"),
        (2, "http://w.x/2", "<form class='page login'><main><p>D</p></main></form><div class='no-comments'>out of main</div>"),
        (3, "http://w.x/3", "<div class='no-comments'><p>E</p></div><div class='comments big'>first!</div>"), (4, "http://w.x/4", "<div class=sidebar>all there is</div>"),
        (5, "http://w.x/5", "<div class=ad>x</div><article></article>"),
    ]
    rows += [(10 + i, f"http://s.x/{i}", page(f"{box if i else ''}<p>{words(6)}</p>")) for i in range(6)] + [(20 + i, f"http://t.x/{i}", page(f"{box if i < 4 else ''}<p>{words(6)}</p>")) for i in range(9)]
    out = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[i] for i in range(1, 6)] == ["A\nB\nC", "D", "E", "all there is", ""]
    assert not any("other stories" in out[10 + i] for i in range(6)) and all("other stories" in out[20 + i] for i in range(4))


# ---- quality


def test_base_counts_and_viterbi(spark, odd):
    import re

    texts = [r[1] for r in ODD] + [words(9) + "\n" + words(9), (words(10, 1) + "\n") * 3, "a # b|c\n\n<d>", words(30, 2) + " " + words(30, 2)]
    base, f, text, chars = quality.measure(texts)
    pattern = re.compile(r"[^\x20\x09-\x0D]+")
    for k, t in enumerate(texts):
        w = pattern.findall(t or "")
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        repeat = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)} if len(w) < 500 else set()
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if pattern.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(repeat))
        assert tuple(int(base[x][k]) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
    chain = quality.Chain(np.random.default_rng(0).normal(size=(quality.FEATURES, 2)), np.array([[0.5, -0.5], [-0.2, 0.3]]))
    states = chain.viterbi(f, text, len(texts))
    score = f @ chain.weights
    for k in range(len(texts)):
        at = np.flatnonzero(text == k)
        if len(at) <= 8:
            value = lambda p: sum(score[a, s] for a, s in zip(at, p, strict=True)) + sum(chain.moves[p[i], p[i + 1]] for i in range(len(p) - 1))
            best = max(itertools.product((0, 1), repeat=len(at)), key=value)
            assert value(states[at].tolist()) == pytest.approx(value(best))
    out = quality.judge(odd.withColumn("kept", F.lit("clash")), None).collect()
    assert len(out) == len(ODD) and not any(r.kept for r in out)
    assert quality.judge(odd.limit(0), chain).count() == 0


def test_crf_learns(spark):
    good, bad = [words(40).replace(" ", ". ", 3) for _ in range(60)], [" ".join(w + "***" for w in words(40).split()) for _ in range(60)]
    docs = spark.createDataFrame([(i, "\n".join([t] * 1)) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120) if i % 3], "doc_id long, quality int")
    out = quality.judge(docs, quality.fit(docs, labels)).collect()
    assert all(r.kept == (r.doc_id < 60) for r in out)
    assert quality.fit(docs, labels.limit(0)) is None


# ---- neighbours


def test_neighbours_exact_scores_and_recall(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(1500, 48))
    x[100:400] = x[50]  # a third of one bucket: equal vectors
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2001, [0.0] * 48), (2002, [float("nan")] * 48), (2003, [None] * 48), (None, [1.0] * 48), (50, [float(v) for v in x[50]]), (2050, [1.0, 2.0]), (2051, [float("inf")] * 48)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    out = {}
    for r in ann.nearest(df, every=25).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = n = 0
    for q in range(0, 1500, 25):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        got = sorted(out[q])
        assert [r for r, *_ in got] == list(range(1, len(got) + 1)) and all(abs(s[i] - v) < 1e-12 for _, i, v in got)
        hit += len({i for _, i, _ in got} & set(best.tolist()))
        n += 5
    assert hit / n >= 0.9 and [i for _, i, _ in sorted(out[50])] == [100, 101, 102, 103, 104]
    assert not set(out) & {2000, 2001, 2002, 2003, 2050} and ann.nearest(df.limit(0)).count() == 0


def test_few_neighbours_are_all_found(spark):
    """2 to 6 vectors of a length, padded to 64 dimensions: each finds all others of its length, best first."""
    g = np.random.default_rng(3)
    x = {100 * m + i: v for m in range(2, 7) for i, v in enumerate(g.normal(size=(m, 66 - m)))}
    out = {}
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id long, embedding array<double>"), every=1).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    for i, v in x.items():
        near = sorted((-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 9), j) for j, w in x.items() if j // 100 == i // 100 and j != i)
        assert sorted(out[i]) == [(n + 1, j, -c) for n, (c, j) in enumerate(near)]


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 33))
    assert np.allclose(np.linalg.norm(ann.rotate(x, 7), axis=1), np.linalg.norm(x, axis=1))


# ---- language


def test_language(spark, odd):
    r = random.Random(5)
    syllables = {"aa": ["ou", "ai", "ch", "re", "le"], "bb": ["sch", "ung", "er", "ei", "ge"], "cc": ["ñ", "do", "os", "ci", "ar"]}
    make = lambda k: " ".join("".join(r.choice(syllables[k]) for _ in range(r.randint(1, 4))) for _ in range(40))
    rows = [(i, make(k), k, "s", 1) for i in range(240) for k in [sorted(syllables)[i % 3]]]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.fit(df)
    assert model[0] == ["aa", "bb", "cc"] and np.allclose(model[1].sum(0), 1)
    out = langid.predict(df.withColumn("score", F.lit("clash")), model).where("crc32(cast(doc_id AS string)) % 4 = 2").collect()
    assert len(out) > 30 and all(x.lang_pred == x.lang and 0.9 < x.score <= 1 for x in out)
    strange = {(x.doc_id, x.lang_pred, x.score) for x in langid.predict(odd, model).collect() if x.doc_id in (1, 2, 3)}
    assert strange == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)}
    assert langid.predict(odd, langid.fit(df.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_forward_sums_all_segmentations():
    v = langid.load(langid.vocabulary_path())
    p = np.random.default_rng(2).dirichlet(np.ones(len(v.pieces) + 1))
    number = {x: i for i, x in enumerate(v.pieces)}
    for w in ("there", "ßx", "q" * 31, "été", "a"):
        s, a = "▁" + w, [1.0]
        for end in range(1, len(s) + 1):
            a.append(sum(a[end - k] * p[number.get(s[end - k : end], v.unknown)] for k in range(1, min(end, v.longest) + 1) if k == 1 or s[end - k : end] in number))
        buf, start, size, _ = v.words([w])
        assert v.forward(buf, start, size, p[:, None])[0, 0] == pytest.approx(np.log(a[-1]))


# ---- near duplicates


def near_by_hand(rows):
    sets = {}
    for i, t, *_ in rows:
        low = (t or "").encode().lower().split()
        s = frozenset(tuple(low[k : k + 5]) for k in range(len(low) - 4)) if len(low) >= 5 else frozenset([tuple(low)] if low else [])
        sets[i] = s
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sorted(k for k in sets if sets[k] and k is not None), 2):
        n = len(sets[a] & sets[b])
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            p, q = find(a), find(b)
            label[max(p, q)] = min(p, q)
    return {i: (len(s), find(i) if i is not None else None) for i, s in sets.items()}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    base = words(150, 9).split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(random.Random(i).randint(0, 14)):
            w[random.Random(i * 77 + _).randrange(len(w))] = f"x{i}y{_}"
        rows.append((1000 + i, " ".join(w), "en", "s", 1))
    rows += [(200 + i, words(60), "en", "s", 1) for i in range(40)] + [(300 + i, "Same Text of five words", "en", "s", 1) for i in range(30)] + [(400, "two words", "en", "s", 1), (401, "TWO\twords", "en", "s", 1)] + ODD
    out = {}
    for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect():
        out[r.doc_id] = (r.n_shingles, r.component_id)
        assert r.kept == (r.doc_id == r.component_id or r.doc_id is None)
    want = near_by_hand(rows)
    assert out == want and len({c for _, c in want.values()}) < len(want) - 50
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_tiny_sets_that_share_no_band_are_linked(spark):
    """8 words and their first 7: 3 of 4 shingles, exactly the threshold; 7 and 6 words are 2 of 3, below it."""
    texts = [" ".join(f"{w}q{j}" for j in range(8)) for w in ("w0x440", "w1x461", "w3x805")]
    less = [t.rsplit(" ", 1)[0] for t in texts]
    a, b = (minhash.bands(minhash.registers(*minhash.shingle_sets(x))) for x in (texts, less))
    assert not (a == b).any()
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([*texts, *less, "a b c d e f g", "a b c d e f"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == near_by_hand(rows) == {0: (4, 0), 1: (4, 1), 2: (4, 2), 3: (3, 0), 4: (3, 1), 5: (3, 2), 6: (3, 6), 7: (2, 7)}


def test_registers_merge_and_estimate():
    g = np.random.default_rng(4)
    a, b = (np.unique(g.integers(0, 2**63, 900).astype(np.uint64)) for _ in range(2))
    both = np.unique(np.concatenate([a, b]))
    regs = minhash.registers(np.concatenate([a, b, both]), np.cumsum([0, len(a), len(b), len(both)]))
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
    shared = np.unique(np.concatenate([a[:850], b[:60]]))
    r = minhash.registers(np.concatenate([a, shared]), np.cumsum([0, len(a), len(shared)]))
    n = [np.array([float(x)]) for x in (len(a), len(shared))]
    assert minhash.may_link(np.array([(r[0] > r[1]).sum()]), np.array([(r[0] < r[1]).sum()]), *n, 0.75)[0]
    assert not minhash.may_link(np.array([(regs[0] > regs[1]).sum()]), np.array([(regs[0] < regs[1]).sum()]), *n, 0.75)[0]


# ---- toxicity


def test_toxicity(spark, odd):
    bad = ["grumblefoot", "snarkwit", "mudbrainer"]
    rows, labels = [], []
    for i in range(500):
        t = words(60).split()
        if i % 5 == 0:
            for _ in range(4):
                t[rnd.randrange(60)] = rnd.choice(bad)
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 5 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    out = toxicity.score(docs.withColumn("score", F.lit("clash")), model).where("crc32(cast(doc_id AS string)) % 3 = 1").collect()
    assert np.mean([(r.score >= 0.7) == (r.doc_id % 5 == 0) for r in out]) > 0.95
    spelt = spark.createDataFrame([(1, words(20) + " grumblefoots snarkwits"), (2, words(22))], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(spelt, model).collect()}
    assert s[1] > s[2]
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(odd.limit(0), model).count() == 0 and toxicity.fit(docs, marks.limit(0))[1] < 0


# ---- repeated strings


def repeats_by_hand(rows, length):
    at = {}
    raw = [((i, k), (t or "").encode()) for k, (i, t, *_) in enumerate(rows)]
    for key, r in raw:
        for s in range(len(r) - length + 1):
            at.setdefault(r[s : s + length], []).append((key, s))
    cover = {key: np.zeros(len(r), bool) for key, r in raw}
    for places in at.values():
        if len(places) > 1:
            for key, s in places:
                cover[key][s : s + length] = True
    out = []
    for key, r in raw:
        c = cover[key]
        kept = bytes(np.frombuffer(r, np.uint8)[~c]) if len(r) else b""
        out.append((key[0], len(r), int(c.sum()), int((np.diff(np.r_[0, c.astype(int)]) == 1).sum()), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2048, 2])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    passage = words(40, 11)
    rows = [(i, f"{words(30)} {passage[i : 160 + i]} {words(10)}", "en", "s", 1) for i in range(12)] + [(50, "ab" * 300, "en", "s", 1), (51, words(100, 13), "en", "s", 1), (52, words(100, 13), "en", "s", 1), (53, "é" * 90 + words(40, 17), "en", "s", 1), (54, words(40, 17), "en", "s", 1)] + [r for r in ODD if r[0] != 4]
    out = substrings.remove_repeats(spark.createDataFrame(rows, DOCS), length=100)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()), key=repr)
    assert got == repeats_by_hand(rows, 100)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out.limit(5).collect())


def test_repeats_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("hot", [2048, 2])
def test_passages_shorter_than_what_is_removed_are_counted(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    short, brief = words(55, 21)[:380], words(45, 22)
    assert len(short.split()) > substrings.WORDS and len(short) >= substrings.SHORT
    bodies = [f"{words(30, 31)} {short} {words(30, 32)}", f"{short} {words(80, 33)}", words(200, 34), f"{brief} {words(40, 35)}", f"{words(50, 36)} {brief}", f"{words(70, 37)} {short}", None, ""]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(bodies)]
    got = {r.doc_id: (r.n_removed, r.n_passages) for r in substrings.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: (0, int(i in (0, 1, 5))) for i in range(len(bodies))}


def test_members_of_different_labels_meet_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    labels = [0] * 13 + [100, 100, 101, 102, 103, 104, 105, 106, 107, 108]
    rows = [(7, 1, len(labels), i, c, 0, 13) for i, c in enumerate(labels)]
    dealt = minhash._dealt(spark.createDataFrame(rows, "key long, band int, size long, id long, label long, most long, n_most long")).collect()
    groups = {}
    for r in dealt:
        groups.setdefault((r.i, r.j), []).append(r)
    met = {}
    for (i, j), members in groups.items():
        assert len(members) <= 23
        for x in members:
            for y in members:
                if x.id < y.id and x.label != y.label and ({x.blk, y.blk} == {i, j} or (i == -1 and x.blk == y.blk == j)):
                    met[x.id, y.id] = met.get((x.id, y.id), 0) + 1
    assert met == {(x, y): 1 for x in range(23) for y in range(x + 1, 23) if labels[x] != labels[y]}


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "DOCS_PER_LANGUAGE", 20)
    monkeypatch.setattr(langid, "MAX_CHARS", 50)
    rows = [(i, f"text {i}", "en", "s", 1) for i in range(2000)] + [(5, "text 5", "en", "s", 1)] * 500 + [(i, "rare", "de", "s", 1) for i in range(8)] + [(9, "x" * 51, "de", "s", 1), (10, None, "de", "s", 1), (None, "no id", "de", "s", 1), (11, "no language", None, "s", 1)]
    found = [(r.lang, r.text) for r in langid.sample(spark.createDataFrame(rows, DOCS)).collect()]
    assert sum(x == "en" for x, _ in found) == 20 and len(set(found)) <= len(found) and {t for x, t in found if x == "de"} == {"rare"}
