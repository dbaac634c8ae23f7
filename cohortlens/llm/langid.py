"""Language identification by unigram piece models that sum over all segmentations of each word."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import _powers, chunks_of, frugal, mix64, ship

DOCS_PER_LANGUAGE = 1500  # bounds of the training sample: documents, characters of one, and languages (the most frequent)
MAX_CHARS = 20_000
LANGUAGES = 200
ROUNDS = 4  # of expectation maximisation
SMOOTH = 0.05  # added to each piece's expected count
SLICE = 500_000  # characters of texts that a worker scores together
LONGEST = 32  # letters of a word; a longer run of letters is scored in stretches of this length
_MARK = "▁"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _is_letter() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True
    return table


class Vocabulary:
    """The pieces of letters of a public vocabulary, found by hash in one gather; every single letter is a piece too.

    Letters outside the vocabulary share the last number, so each text has a segmentation.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = sorted({model.id_to_piece(i).lower() for i in range(model.get_piece_size())})
        self.pieces = [p for p in pieces if p and all(c.isalpha() or c == _MARK for c in p) and _MARK not in p[1:]]
        self.longest = max(map(len, self.pieces))
        self.letter = _is_letter()
        self.unknown, self.none = len(self.pieces), len(self.pieces) + 1
        h = np.array([self._hash(np.array([ord(c) for c in p], np.uint64)) for p in self.pieces], np.uint64)
        bits = 20
        self.mask = np.uint64((1 << bits) - 1)
        self.key = np.zeros(1 << bits, np.uint64)
        self.number = np.full(1 << bits, self.none, np.int32)
        spill = []
        for i, x in enumerate(h):
            at = int(x & self.mask)
            if self.number[at] == self.none:
                self.key[at], self.number[at] = x, i
            else:
                spill.append(i)
        spill.sort(key=lambda i: h[i])
        self.spill_key, self.spill_number = h[spill], np.array(spill, np.int32)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.uint64:
        pow_, _ = _powers(len(codes) + 1)
        return mix64((codes * pow_[: len(codes)]).sum(dtype=np.uint64)[None])[0]

    def find(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        out = np.where(self.key[at] == h, self.number[at], self.none)
        if len(self.spill_key):
            miss = np.flatnonzero(out == self.none)
            k = np.minimum(np.searchsorted(self.spill_key, h[miss]), len(self.spill_key) - 1)
            hit = self.spill_key[k] == h[miss]
            out[miss[hit]] = self.spill_number[k[hit]]
        return out

    def words(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points with a mark before each word; start and length (mark included) of each word; its text."""
        low = [(t or "").lower() for t in texts]
        at = np.cumsum([0] + [len(t) + 1 for t in low])
        buf = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = self.letter[buf]
        edge = np.diff(np.r_[0, inside.astype(np.int8), 0])
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        parts = np.maximum(1, -(-(e - s) // LONGEST))
        of = np.repeat(np.arange(len(s)), parts)
        k = np.arange(len(of)) - np.r_[0, np.cumsum(parts)[:-1]][of] if len(s) else of
        ws = s[of] + k * LONGEST
        we = np.minimum(ws + LONGEST, e[of])
        text = np.searchsorted(at, ws, side="right") - 1
        return buf.astype(np.uint64), ws, we - ws, text

    def unique(self, buf, start, size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words stand for all that are spelt alike, longest first; the one of each word; how often it stands there."""
        pow_, inv = _powers(len(buf) + 1)
        prefix = np.r_[np.zeros(1, np.uint64), np.cumsum(buf * pow_[: len(buf)])]
        h = mix64((prefix[start + size] - prefix[start]) * inv[start] + size.astype(np.uint64))
        _, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-size[first], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return first[order], rank[inverse], count[order]

    def lattice(self, buf, start, size):
        """For words, longest first: (end, length, pieces of the words that reach that far) of each possible piece."""
        n = int(size.max()) + 1
        codes = np.full((len(start), n), ord(_MARK), np.uint64)
        for i in range(1, n):
            live = size >= i
            codes[live, i] = buf[start[live] + i - 1]
        pow_, inv = _powers(n + 1)
        prefix = np.zeros((len(start), n + 1), np.uint64)
        np.cumsum(codes * pow_[:n], axis=1, out=prefix[:, 1:])
        reach = np.searchsorted(-size, -np.arange(n + 1), side="right")  # words of at least so many letters
        for end in range(1, n + 1):
            m = int(reach[end - 1])
            for k in range(1, min(end, self.longest) + 1):
                got = self.find(mix64((prefix[:m, end] - prefix[:m, end - k]) * inv[end - k]))
                if k == 1 and end > 1:
                    got = np.where(got == self.none, self.unknown, got)
                if k == 1 and end == 1:
                    got = np.full(m, self.pieces.index(_MARK) if _MARK in self.pieces else self.unknown)
                yield end, k, m, got

    def forward(self, buf, start, size, probability: np.ndarray) -> np.ndarray:
        """log of the summed probability of all segmentations, for each word and language."""
        out = np.zeros((len(start), probability.shape[1]))
        table = np.vstack([probability, np.zeros(probability.shape[1])])
        for i in range(0, len(start), 20_000):
            s = slice(i, i + 20_000)
            n = int(size[s].max()) + 1 if len(size[s]) else 0
            a = np.zeros((n + 1, len(start[s]), probability.shape[1]))
            a[0] = 1
            for end, k, m, got in self.lattice(buf, start[s], size[s]):
                some = np.flatnonzero(got != self.none)
                if len(some) * 2 > m:
                    a[end, :m] += a[end - k, :m] * table[got]
                elif len(some):
                    a[end, some] += a[end - k, some] * table[got[some]]
            out[s] = np.log(a[size[s] + 1, np.arange(len(start[s]))])
        return out

    def expect(self, buf, start, size, weight, p: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces under one language's model p, forward and backward."""
        counts = np.zeros(len(p) + 1)
        table = np.r_[p, 0.0]
        for i in range(0, len(start), 20_000):
            s = slice(i, i + 20_000)
            steps = list(self.lattice(buf, start[s], size[s]))
            w, z = len(start[s]), size[s] + 1
            a, b = np.zeros((int(z.max()) + 1, w)), np.zeros((int(z.max()) + 1, w))
            a[0] = 1
            b[z, np.arange(w)] = 1
            for end, k, m, got in steps:
                a[end, :m] += a[end - k, :m] * table[got]
            for end, k, m, got in reversed(steps):
                b[end - k, :m] += b[end, :m] * table[got]
            scale = weight[s] / a[z, np.arange(w)]
            for end, k, m, got in steps:
                counts += np.bincount(got, a[end - k, :m] * table[got] * b[end, :m] * scale[:m], len(counts))
        return counts[:-1]


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def count_words(v: Vocabulary, texts: list) -> Counter:
    """How often each word stands in the texts, which are worked on in slices of bounded size."""
    out: Counter = Counter()
    for i, j in chunks_of(texts, SLICE):
        buf, start, size, _ = v.words(texts[i:j])
        if len(start):
            first, _, count = v.unique(buf, start, size)
            for k, c in zip(first.tolist(), count.tolist(), strict=True):
                out[buf[start[k] : start[k] + size[k]].astype(np.uint32).tobytes()] += c
    return out


def train(counts: Counter, path: str | None = None) -> np.ndarray:
    """The probability of each piece in one language, by expectation maximisation over its counted words."""
    v = load(path or vocabulary_path())
    p = np.full(len(v.pieces) + 1, 1.0 / (len(v.pieces) + 1))
    if counts:
        words = sorted(counts, key=lambda w: (-len(w), w))
        size = np.array([len(w) // 4 for w in words])
        start = np.r_[0, np.cumsum(size)[:-1]]
        buf = np.frombuffer(b"".join(words), np.uint32).astype(np.uint64)
        weight = np.array([counts[w] for w in words], float)
        for _ in range(ROUNDS):
            c = v.expect(buf, start, size, weight, p) + SMOOTH
            p = c / c.sum()
    return p


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text) of at most DOCS_PER_LANGUAGE documents of each language, those of a share of xxhash64(id), then the first by md5.

    Only ids with a crc32(id) mod 4 other than 2, a language and a text of at most MAX_CHARS characters are
    learned from, and of a repeated id one text, so the sample has a bound in bytes. Counts of distinct ids set that
    share, so that the sort only sees about twice the sample and not the language.
    """
    usable = docs.where((F.length(text_col) <= MAX_CHARS) & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 != 2))
    rows = usable.select(F.col(lang_col).alias("__lang"), F.col(id_col).cast("string").alias("__id"), F.col(text_col).alias("__text"))
    totals = rows.groupBy("__lang").agg(F.approx_count_distinct("__id").alias("__total"))
    wanted = F.broadcast(totals.orderBy(F.desc("__total"), "__lang").limit(LANGUAGES))
    some = rows.join(wanted, "__lang").where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) * F.col("__total") <= F.lit(float(2 * DOCS_PER_LANGUAGE) * (1 << 20)))
    one = some.groupBy("__lang", "__id").agg(F.min("__text").alias("__text"))
    order = Window.partitionBy("__lang").orderBy(F.md5("__id"), "__id")
    return one.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= DOCS_PER_LANGUAGE).select(F.col("__lang").alias("lang"), F.col("__text").alias("text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the probability of each piece (rows) in each (columns), learned from ``sample``.

    Each language is a task of its own; the driver gets one row of numbers from each, of the vocabulary's size.
    """
    ship(docs.sparkSession)
    path = vocabulary_path()

    def learn(key, t):
        p = train(count_words(load(path), t.column("text").to_pylist()), path)
        return pa.table({"lang": [key[0].as_py()], "p": pa.array([p.tobytes()], pa.binary())})

    found = {r["lang"]: np.frombuffer(r["p"]) for r in sample(docs, id_col, text_col, lang_col).groupBy("lang").applyInArrow(learn, "lang string, p binary").collect()}
    names = sorted(found)
    return names, np.stack([found[n] for n in names], 1) if names else np.zeros((1, 0))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the share of the likeliest language in the posterior of the whole text.

    Every run of letters, lower-cased, is a word; a word's probability is the sum over all its segmentations
    into pieces. Texts that are null or have no letter are ``und`` with score 0, as are all if nothing
    was learned; equal likelihoods go to the smaller name. Columns named like the outputs are replaced. The model is a
    broadcast of the size of the vocabulary times the languages.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    path = path or vocabulary_path()
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        names, probability = shared.value
        v = load(path)
        for b in batches:
            texts = b.column(text_col).to_pylist()
            for i, j in chunks_of(texts, SLICE):
                buf, start, size, text = v.words(texts[i:j])
                total = np.zeros((j - i, max(1, len(names))))
                known = np.zeros(j - i, bool)
                if len(start) and names:
                    known[text] = True
                    first, which, _ = v.unique(buf, start, size)
                    logp = v.forward(buf, start[first], size[first], probability)
                    for k in range(len(names)):
                        total[:, k] = np.bincount(text, logp[which, k], j - i)
                best = total.argmax(1)
                share = 1 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0)).sum(1)
                part = b.slice(i, j - i)
                label = [names[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(label, pa.string()), pa.array(np.where(known, share, 0.0))], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(frugal(run), schema)
