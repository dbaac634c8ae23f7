"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import _powers, chunks_of, frugal, mix64, ship

BUCKETS = 1 << 17
DIMENSIONS = 8
GRAMS = (3, 4, 5, 6)  # characters of a subword; whole words count besides
SEGMENT = 4  # words that are averaged together
MAX_POSITIVE, MAX_NEGATIVE, MAX_CHARS = 1000, 1500, 2000
EPOCHS, WARM, BATCH, RATE, DECAY = 18, 5, 64, 0.15, 2e-7
_P = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (chr(i).isalnum() or chr(i) == "'")]] = True
    return table


_TABLE: list[np.ndarray] = []


def subwords(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of all subwords of the lower-cased texts, the segment of each, and the text of each segment.

    A word is a run of letters, digits and apostrophes, marked at both ends; its subwords are its character
    n-grams and itself, so a misspelt word shares most of its vectors with the right one. SEGMENT words are a
    segment; every text has one at least.
    """
    if not _TABLE:
        _TABLE.append(_letters())
    low = [(t or "").lower() for t in texts]
    at = np.cumsum([0] + [len(t) + 1 for t in low])
    buf = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _TABLE[0][buf]
    code = np.where(inside, buf, 1).astype(np.uint64)
    n = len(code)
    edge = np.diff(np.r_[0, inside.astype(np.int8), 0])
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(at, s, side="right") - 1
    first = np.searchsorted(s, at[:-1])
    count = np.diff(np.r_[first, len(s)])
    base = np.r_[0, np.cumsum(np.maximum(1, -(-count // SEGMENT)))]
    of_word = base[text] + (np.arange(len(s)) - first[text]) // SEGMENT
    segment_text = np.repeat(np.arange(len(texts)), np.diff(base))
    word_at = np.cumsum(edge[:n] == 1) - 1  # of a character, and of the mark after a word
    # a gram may begin at the mark before a word and end at the mark after it, with nothing but letters between
    gaps = np.cumsum(~inside)
    out, owner = [], []
    h = np.zeros(n, np.uint64)
    for k in range(1, max(GRAMS) + 1):
        h = h[: n - k + 1] * _P + code[k - 1 :]
        if k in GRAMS:
            middle = gaps[k - 2 : n - 1] - gaps[: n - k + 1]
            ok = np.flatnonzero((middle == 0) & (inside[: n - k + 1] | inside[1 : n - k + 2]))
            out.append(mix64(h[ok] + np.uint64(k)))
            owner.append(word_at[ok + 1])
    pow_, inv = _powers(n + 1)
    prefix = np.r_[np.zeros(1, np.uint64), np.cumsum(code * pow_[:n])]
    out.append(mix64((prefix[e] - prefix[s]) * inv[s] + np.uint64(99)))
    owner.append(np.arange(len(s)))
    ids = (np.concatenate(out) & np.uint64(BUCKETS - 1)).astype(np.int32)
    return ids, of_word[np.concatenate(owner)] if len(s) else np.zeros(0, int), segment_text


def _scores(ids, segment, segment_text, weights, bias) -> np.ndarray:
    """The score of each segment: the mean of its subwords' weights, and the bias."""
    n = np.bincount(segment, minlength=len(segment_text))
    return np.bincount(segment, weights[ids], len(segment_text)) / np.maximum(n, 1) + bias


def train(texts: list[str], labels: list[int], seed: int = 5) -> tuple[np.ndarray, float]:
    """The difference of both classes' scores for each bucket, and of their biases.

    Embeddings and output weights are learned together by mini-batches of cross entropy with Adagrad, from
    the segment of each document that scores highest so far (at first all its segments in turn), as a
    document is toxic if any part is. The layer after the average is linear, so scoring needs their product only.
    """
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    out = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = np.full(BUCKETS, 1e-8, np.float32)
    seen_out, seen_bias = np.full_like(out, 1e-3), np.full_like(bias, 1e-3)
    flats, parts, sizes, owners = [], [], [], []
    for i in range(0, len(texts), 128):
        ids, segment, text = subwords(texts[i : i + 128])
        key, count = np.unique(segment * BUCKETS + ids, return_counts=True)
        of = key // BUCKETS
        flats.append((key % BUCKETS).astype(np.int32))
        parts.append((count / np.bincount(segment, minlength=len(text))[of]).astype(np.float32))
        sizes.append(np.bincount(of, minlength=len(text)))
        owners.append(i + text)
    flat, part, owner = np.concatenate(flats), np.concatenate(parts), np.concatenate(owners)
    del flats, parts
    size = np.concatenate(sizes)
    at = np.r_[0, np.cumsum(size)]
    bag_of = np.repeat(np.arange(len(size), dtype=np.int32), size)
    first = np.r_[np.searchsorted(owner, np.arange(len(texts))), len(size)]
    y = np.asarray(labels)
    for epoch in range(EPOCHS):
        if epoch < WARM:
            chosen = np.array([rng.integers(first[d], first[d + 1]) for d in range(len(texts))])
        else:
            z = np.bincount(bag_of, (emb @ (out[:, 1] - out[:, 0]))[flat] * part, len(size))
            chosen = np.array([first[d] + int(np.argmax(z[first[d] : first[d + 1]])) for d in range(len(texts))])
        order = rng.permutation(len(texts))
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(order), BATCH):
            docs = [d for d in order[i : i + BATCH] if size[chosen[d]]]
            some = [chosen[d] for d in docs]
            if not some:
                continue
            ids = np.concatenate([flat[at[k] : at[k + 1]] for k in some])
            w = np.concatenate([part[at[k] : at[k + 1]] for k in some])
            n = size[some]
            mean = np.add.reduceat(emb[ids] * w[:, None], np.r_[0, np.cumsum(n)[:-1]], axis=0)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[docs]] -= 1
            g_out, g_bias, g_mean = mean.T @ p, p.sum(0), p @ out.T
            u, inverse = np.unique(ids, return_inverse=True)
            # the average divides by hundreds of subwords, so a bucket's steps are scaled by its own past gradients
            per = np.repeat(g_mean, n, axis=0) * w[:, None]
            g = np.stack([np.bincount(inverse, per[:, d], len(u)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            seen[u] += (g * g).mean(1)
            emb[u] -= rate * g / np.sqrt(seen[u])[:, None] + DECAY * emb[u]
            seen_out += g_out**2
            seen_bias += g_bias**2
            out -= rate * g_out / np.sqrt(seen_out)
            bias -= rate * g_bias / np.sqrt(seen_bias)
    return (emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Train on a bounded sample of labelled documents whose crc32(id) mod 3 is not 1.

    The bound: at most MAX_POSITIVE and MAX_NEGATIVE documents, of at most MAX_CHARS characters each so
    that whole texts fit, the first by md5 of the id; null texts and labels other than 0 and 1 take no part.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 3 != 1)).select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).distinct()
    usable = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= MAX_CHARS)).select(F.col(id_col).alias("__id"))
    known = usable.join(marked, "__id")
    order = F.md5(F.col("__id").cast("string"))
    some = [known.where(F.col("__y") == y).orderBy(order, "__id").limit(n) for y, n in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    picked = F.broadcast(some[0].unionByName(some[1]))  # bounded by the two limits
    rows = docs.where(F.length(text_col) <= MAX_CHARS).join(picked, F.col(id_col) == F.col("__id")).select(F.col(text_col).alias("text"), "__y").orderBy(F.md5("text")).limit(MAX_POSITIVE + MAX_NEGATIVE).collect()
    if len({r["__y"] for r in rows}) < 2:
        return np.zeros(BUCKETS, np.float32), -2.0
    return train([r["text"] for r in rows], [int(r["__y"]) for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, the probability of label 1 of the text's highest segment; null and empty texts get the bias's.

    The model is a broadcast of fixed size (BUCKETS numbers). A column of the output's name is replaced.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != score_col]

    def run(batches):
        weights, bias = shared.value
        for b in batches:
            texts = b.column(text_col).to_pylist()
            for i, j in chunks_of(texts):
                ids, segment, text = subwords(texts[i:j])
                top = np.full(j - i, -np.inf)
                np.maximum.at(top, text, _scores(ids, segment, text, weights, bias))
                p = 1 / (1 + np.exp(-np.clip(top, -30, 30)))
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(p)], names=[*keep, score_col])

    schema = docs.select(*keep).withColumn(score_col, F.lit(0.0)).schema
    return docs.mapInArrow(frugal(run), schema)
