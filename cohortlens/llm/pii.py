"""Personal data: rules for clear forms, and a skip-chain conditional random field for what they miss.

The field labels the tokens of a document that hold a digit or an ``@``; other words are outside any entity. Neighbouring
tokens form the chain. Each token is also tied to the last one before it that is the same or similar (the same last four digits,
the same local part), however far away, so that all mentions of a number or an address support one label. Tokens
of rule matches are given; loopy belief propagation carries their labels along the ties.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import chunks_of, frugal, ship

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
LABELS = OUTSIDE + 1
#: The bound of the training sample (twice as many if rows repeat), which has no labels but those of the rules.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 10_000
STEPS, STEP, RIDGE = 300, 0.1, 3e-4
ROUNDS, DAMPING, SURE = 20, 0.3, 0.9

# Forms of the contract. Fixed values.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_ANY = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"[A-Za-z0-9@._%+()-]+")
_GAP = re.compile(r"[ ().-]{0,4}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def rules(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the rule matches, sorted; and where a form matched but its digits didn't pass.

    Each kind is leftmost and without overlaps, in time linear in the text.
    """
    found, failed = [], []
    if not _ANY.search(text):
        return found, failed
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append((begin, 0, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        at, row = m.start(), []
        for part in [*m.group().split("."), ""]:
            if part:
                row.append((at, part))
            if len(row) == 4:
                end = at + len(part)
                ok = all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for _, p in row)
                (found.append((row[0][0], 1, end)) if ok else failed.append((row[0][0], end)))
                row = []
            elif not part:
                row = []
            at += len(part) + 1
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        (found.append((m.start(), 2, m.end())) if 12 <= len(d) <= 19 and luhn(d) else failed.append(m.span()))
    for m in _PHONE.finditer(text):
        (found.append((m.start(), 3, m.end())) if 9 <= len(_digits(m.group())) <= 15 else failed.append(m.span()))
    return sorted(found), failed


class Tokens:
    """The open tokens of one text: spans, features, rule labels, ties."""

    def __init__(self, text: str, found: list, failed: list):
        self.spans, rows = [], []
        for m in _TOKEN.finditer(text):
            a, b = m.span()
            while a < b and text[a] in ".%-)_":
                a += 1
            while b > a and text[b - 1] in ".%+-(_":
                b -= 1
            if a < b and _ANY.search(text, a, b):
                self.spans.append((a, b))
        n = len(self.spans)
        self.label = np.full(n, -1)
        self.doubtful = np.zeros(n, bool)
        if not n:
            self.features = np.zeros((0, FEATURES))
            self.chain, self.same, self.alike = (np.zeros((0, 2), int) for _ in range(3))
            return
        starts, ends = np.array(self.spans).T
        # Later kinds of the list win where rule matches overlap: the more specific phone holds card-like digits.
        for kind in range(OUTSIDE):
            for a, _, b in (x for x in found if x[1] == kind):
                self.label[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)] = kind
        for a, b in failed:
            if len(_digits(text[a:b])) >= 9:
                self.doubtful[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)] = True
        self.doubtful &= self.label < 0
        beside = [bool(_GAP.fullmatch(text, self.spans[i][1], self.spans[i + 1][0])) for i in range(n - 1)]
        last_same: dict[str, int] = {}
        last_alike: dict[str, int] = {}
        same, alike = [], []
        for i, (a, b) in enumerate(self.spans):
            t = text[a:b]
            rows.append(_features(t, i > 0 and beside[i - 1], i < n - 1 and beside[i]))
            low, d = t.lower(), _digits(t)
            if len(low) < 4:
                continue
            j = last_same.get(low)
            if j is not None:
                same.append((j, i))
            last_same[low] = i
            key = low.split("@")[0] if not low.replace("-", "").replace("(", "").replace(")", "").isdigit() else d[-4:] if len(d) >= 4 else ""
            j = last_alike.get(key) if key else None
            if j is not None and text[self.spans[j][0] : self.spans[j][1]].lower() != low:
                alike.append((j, i))
            last_alike[key] = i
        self.features = np.array(rows, np.float64)
        self.chain = np.array([(i, i + 1) for i in range(n - 1) if beside[i]], int).reshape(-1, 2)
        self.same, self.alike = (np.array(x, int).reshape(-1, 2) for x in (same, alike))


def _features(t: str, after: bool, before: bool) -> list[float]:
    d = _digits(t)
    n, letters = len(d), sum(c.isalpha() for c in t)
    name, sign, host = t.partition("@")
    parts = t.split(".")
    quad = len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    plain = not letters and not sign
    size = [n == k for k in (1, 2, 3, 4)] + [5 <= n <= 6, n == 7, 8 <= n <= 9, 10 <= n <= 11, 12 <= n <= 15, n == 16, 17 <= n <= 19, n > 19]
    return [
        1, bool(sign), bool(sign and name and "." in host), quad, plain, *(plain and x for x in size), plain and t[0] == "+", plain and "(" in t, plain and t.count("-") == 1, plain and t.count("-") > 1,
        plain and "." in t and not quad, plain and 12 <= n <= 19 and luhn(d), plain and n == len(t), letters > n, 0 < letters <= n, after, before, plain and t[0] == "+" and before, plain and "(" in t and before,
    ]


FEATURES = len(_features("1", False, False))


class Field:
    """Weights of token features, and potentials of the chain and of the two kinds of ties."""

    def __init__(self, weights: np.ndarray, potentials: list[np.ndarray]):
        self.weights, self.potentials = weights, potentials

    @staticmethod
    def join(tokens: list[Tokens]):
        at = np.cumsum([0] + [len(t.spans) for t in tokens])
        edges = [np.concatenate([getattr(t, k) + a for t, a in zip(tokens, at)] or [np.zeros((0, 2), int)]) for k in ("chain", "same", "alike")]
        return at, np.concatenate([t.features for t in tokens]), np.concatenate([t.label for t in tokens]), edges

    @classmethod
    def fit(cls, tokens: list[Tokens]) -> Field:
        """Maximum pseudo-likelihood with a ridge, by full-batch Adam: each token given its neighbours' labels."""
        _, x, y, edges = cls.join(tokens)
        doubt = np.concatenate([t.doubtful for t in tokens])
        y = np.where(y < 0, OUTSIDE, y)
        one = np.eye(LABELS)[y]
        edges = [e[~doubt[e].any(1)] if len(e) else e for e in edges]
        use = ~doubt
        w = np.zeros((x.shape[1], LABELS))
        pots = [np.zeros((LABELS, LABELS)) for _ in edges]
        params = [w, *pots]
        mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            score = x @ params[0]
            for e, p in zip(edges, params[1:]):
                np.add.at(score, e[:, 1], p[y[e[:, 0]]])
                np.add.at(score, e[:, 0], p.T[y[e[:, 1]]])
            score -= score.max(1, keepdims=True)
            prob = np.exp(score)
            prob /= prob.sum(1, keepdims=True)
            gap = (one - prob) * use[:, None]
            n = max(1, int(use.sum()))
            grads = [x.T @ gap]
            for k, e in enumerate(edges):
                g = one[e[:, 0]].T @ gap[e[:, 1]] + gap[e[:, 0]].T @ one[e[:, 1]]
                grads.append(g if k == 0 else (g + g.T) / 2)  # ties have no direction
            for k, g in enumerate(grads):
                g = g / n - RIDGE * params[k]
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.99 * var[k] + 0.01 * g * g
                params[k] = params[k] + STEP * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)
        return cls(params[0], params[1:])

    def marginals(self, tokens: list[Tokens]) -> list[np.ndarray]:
        """Probabilities of the labels of each token, by ROUNDS damped rounds of messages along all edges."""
        at, x, given, edges = self.join(tokens)
        score = x @ self.weights
        clamped = np.flatnonzero(given >= 0)
        score[clamped] = -1e3
        score[clamped, given[clamped]] = 0
        src = np.concatenate([np.r_[e[:, 0], e[:, 1]] for e in edges])
        dst = np.concatenate([np.r_[e[:, 1], e[:, 0]] for e in edges])
        back = np.concatenate([np.r_[np.arange(len(e)) + len(e), np.arange(len(e))] + 2 * sum(map(len, edges[:k])) for k, e in enumerate(edges)]).astype(int)
        pots = [m for e, p in zip(edges, self.potentials) for m in ([p] * len(e) + [p.T] * len(e))]
        if len(src):
            pot = np.array(pots)
            message = np.zeros((len(src), LABELS))
            for _ in range(ROUNDS):
                belief = score.copy()
                np.add.at(belief, dst, message)
                sent = belief[src] - message[back]
                both = sent[:, :, None] + pot
                top = both.max(1)
                new = top + np.log(np.exp(both - top[:, None]).sum(1))
                new -= new.max(1, keepdims=True)
                message = DAMPING * message + (1 - DAMPING) * new
            np.add.at(score, dst, message)
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(1, keepdims=True)
        return [p[a:b] for a, b in zip(at, at[1:])]


def _variant(rnd: random.Random, kind: int, span: str) -> str:
    """Another form of an entity that no rule takes, or not surely."""
    d = _digits(span)
    if kind == 3:
        d = d[-10:]
        return rnd.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}", d])
    if kind == 2:
        return str((int(d[0]) + 1) % 10) + d[1:]  # a slip: the check digit fails
    if kind == 0:
        return rnd.choice([span.split("@")[0] + "@" + span.split("@")[1].split(".")[0], span])
    return span


def _noise(rnd: random.Random) -> str:
    """Numbers that are nobody's: years, amounts, versions, dates, codes."""
    r = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    return rnd.choice([str(rnd.randint(1900, 2030)), r(rnd.randint(1, 6)), f"{r(2)}.{r(2)}", f"v{r(1)}.{r(1)}.{r(2)}", f"20{r(2)}-{r(2)}-{r(2)}", f"{r(3)}-{r(4)}", f"{rnd.choice('abcdefg')}{r(3)}{rnd.choice('abcdef')}{r(5)}", r(rnd.randint(7, 12)), "1" + r(14) + rnd.choice("0123456789"), f"{r(3)}.{r(3)}"])


def examples(texts: list[str], seed: int = 7) -> list[Tokens]:
    """Training tokens: texts as the rules label them, each with invented numbers and other forms of its entities after it.

    Other forms carry the label of what they restate, and so do entities side by side, which the rules can lose; half
    of the texts restate nothing, so that a form which is not tied to an entity is learnt as what its own features say.
    """
    rnd, out = random.Random(seed), []
    pool = [(k, t[a:b]) for t in texts for a, k, b in rules(t)[0]]
    for text in texts:
        found, failed = rules(text)
        own = list(found)
        for _ in range(rnd.randint(0, 3)):
            text += f" word {_noise(rnd)} word"
        said = []
        if found and rnd.random() < 0.5:
            for a, kind, b in rnd.sample(found, min(3, len(found))):
                v = _variant(rnd, kind, text[a:b])
                said.append((len(text) + 6, kind, len(text) + 6 + len(v)))
                text += f" word {v} word"
        if pool and rnd.random() < 0.25:
            text += " word"
            for kind, v in rnd.choices(pool, k=2):
                said.append((len(text) + 1, kind, len(text) + 1 + len(v)))
                text += f" {v}"
            text += " word"
        t = Tokens(text, sorted(own + said), failed)
        if len(t.spans):
            out.append(t)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """A field from unlabelled documents: about SAMPLE_DOCS of those with a digit or @ and at most SAMPLE_CHARS characters, all if there are fewer.

    They are counted first, and each is taken by its own hash with the chance that makes so many, so tasks send no more to the driver, at
    any size, than what is used. None if there are none. Rows with null ids take part.
    """
    some = docs.where((F.length(text_col) <= SAMPLE_CHARS) & F.col(text_col).rlike("[0-9@]"))
    n = some.count()
    if n > SAMPLE_DOCS:
        some = some.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40)) < int((1 << 40) * SAMPLE_DOCS / n))
    rows = some.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).limit(2 * SAMPLE_DOCS).collect()
    tokens = examples([t for _, t in sorted((r["id"] or "", r["text"]) for r in rows)])
    return Field.fit(tokens) if tokens else None


def added(text: str, tokens: Tokens, p: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans of tokens that no rule took and that the field is SURE of, in valid numbers of digits."""
    out: list[tuple[int, int, int]] = []
    label = np.where(p.max(1) >= SURE, p.argmax(1), OUTSIDE)
    label[tokens.label >= 0] = OUTSIDE
    i, n = 0, len(label)
    while i < n:
        kind = int(label[i])
        if kind == OUTSIDE:
            i += 1
            continue
        a, b = tokens.spans[i]
        count = len(_digits(text[a:b]))
        j = i + 1
        while kind >= 2 and j < n and label[j] == kind and _GAP.fullmatch(text, b, tokens.spans[j][0]) and text[tokens.spans[j][0]] != "+":
            more = len(_digits(text[slice(*tokens.spans[j])]))
            if count >= (12 if kind == 2 else 10) or count + more > (19 if kind == 2 else 15):
                break
            b, count, j = tokens.spans[j][1], count + more, j + 1
        if kind < 2 or (12 if kind == 2 else 7) <= count <= (19 if kind == 2 else 15):
            out.append((a, kind, b))
        i = j
    return out


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: kind, start and end in code points (end exclusive), by start, then kind as in KINDS.

    ``base`` has the rule matches; ``spans`` has these and what the field adds, which overlaps none of them. Without
    a field they are equal. A null or empty text has none; an empty table gives an empty one; columns named like the
    outputs are replaced. Whole texts are worked on where they are read, without a shuffle.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    keep = [c for c in docs.columns if c not in ("base", "spans")]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    told = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(batches):
        model = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            for i, j in chunks_of(texts):
                base, every, open_ = [], [], []
                for k, t in enumerate(texts[i:j]):
                    found, failed = rules(t)
                    base.append(found)
                    every.append(found)
                    if model is not None and _ANY.search(t):
                        tokens = Tokens(t, found, failed)
                        if (tokens.label < 0).any():
                            open_.append((k, tokens))
                if open_:
                    for (k, tokens), p in zip(open_, model.marginals([x for _, x in open_])):
                        more = added(texts[i + k], tokens, p)
                        if more:
                            every[k] = sorted(base[k] + more)
                part = b.slice(i, j - i)
                made = [pa.array([told(x) for x in rows], kind) for rows in (base, every)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, names=[*keep, "base", "spans"])

    schema = docs.select(*keep).withColumn("base", F.lit(None).cast(SPANS)).withColumn("spans", F.lit(None).cast(SPANS)).schema
    return docs.mapInArrow(frugal(run), schema)


def listed(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
