"""Quality rules with line labels: base counts, and a linear-chain conditional random field over lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import chunks_of, frugal, mix64, ship, span_hashes, word_spans

SYMBOLS = b"#*$%&|<>"
WINDOW = 8  # words
PER_CLASS, MAX_CHARS, MAX_LINES = 1500, 8_000, 80  # bound of the training sample
STEPS, STEP, RIDGE = 150, 0.2, 1e-3
MIN_SHARE = 0.5  # of the word characters that must lie in content lines
FEATURES = 22


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYM, _UPPER, _DIGIT = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(b"0123456789")
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_SHOUT, _BAR, _STOP = _table(b"!"), _table(b"|"), _table(b".!?:;\"'")


def measure(texts: list) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The base counts of each text; features, text number and word characters of each line.

    Words are runs of other characters than ASCII white space. All of it is array work on the UTF-8 bytes.
    """
    n = len(texts)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = np.cumsum([0] + [len(r) + 1 for r in raw])
    buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    s, e = word_spans(buf)
    word_text = np.searchsorted(at, s, side="right") - 1
    n_words = np.bincount(word_text, minlength=n)
    wide = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
    chars = wide[e] - wide[s]
    word_chars = np.bincount(word_text, chars, n).astype(np.int64)
    wh = span_hashes(buf, s, e) if len(s) else np.zeros(0, np.uint64)

    m = max(0, len(wh) - WINDOW + 1)
    roll = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        roll = mix64(roll * np.uint64(0x9E3779B97F4A7C15) + wh[k : m + k])
    whole = np.flatnonzero(word_text[: m] == word_text[WINDOW - 1 :]) if m else np.zeros(0, int)
    covered = np.zeros(len(wh) + 1, np.int64)
    if len(whole):
        key = mix64(roll[whole] + word_text[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = whole[count[inverse] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    repeat = np.cumsum(covered)[:-1] > 0
    n_repeat = np.bincount(word_text, repeat, n).astype(np.int64)

    ends = np.flatnonzero(buf == 10)
    starts = np.r_[0, ends[:-1] + 1]
    line_text = np.searchsorted(at, starts, side="right") - 1
    of_word = np.searchsorted(starts, s, side="right") - 1
    words = np.bincount(of_word, minlength=len(starts))
    line_chars = np.bincount(of_word, chars, len(starts))
    lh = span_hashes(buf, starts, ends) + line_text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    full = np.flatnonzero(words > 0)
    _, first, inverse = np.unique(lh[full], return_index=True, return_inverse=True)
    dup = np.zeros(len(starts), bool)
    dup[full] = first[inverse] != np.arange(len(full))

    def share(table, of):
        c = np.r_[0, np.cumsum(table[buf])]
        return (c[ends] - c[starts]) / np.maximum(of, 1)

    count = np.r_[0, np.cumsum(_SYM[buf])]
    symbols = np.bincount(np.searchsorted(at, starts, side="right") - 1, count[ends] - count[starts], n).astype(np.int64)
    size = np.maximum(1, ends - starts)
    letters = share(_LETTER, np.ones(len(starts)))
    sym, shout, bar, digit = share(_SYM, size), share(_SHOUT, size), share(_BAR, size), share(_DIGIT, size)
    upper = share(_UPPER, np.maximum(1, letters))
    same = np.zeros(len(s))
    if len(s) > 1:
        same[1:] = (wh[1:] == wh[:-1]) & (of_word[1:] == of_word[:-1])
    again = np.bincount(of_word, same, len(starts)) / np.maximum(1, words)
    looped = np.bincount(of_word, repeat, len(starts)) / np.maximum(1, words)
    last = buf[np.maximum(ends - 1, starts)] if len(starts) else buf[:0]
    long = line_chars / np.maximum(1, words)
    f = np.stack(
        [
            np.ones(len(starts)), words == 0, (words > 0) & (words < 4), (words >= 4) & (words < 12), words >= 12,
            sym > 0.01, sym > 0.05, sym > 0.15, shout > 0.02, shout > 0.08, bar > 0.01, bar > 0.05, upper > 0.2, upper > 0.6,
            digit > 0.05, digit > 0.2, dup, again > 0.1, looped > 0.3, _STOP[last], long > 9, letters / size < 0.6,
        ], 1,
    ).astype(np.float32)
    base = {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": np.bincount(line_text, dup, n).astype(np.int64), "n_repeat_words": n_repeat}
    return base, f, line_text, line_chars


class Chain:
    """A linear-chain conditional random field with two states: 0 content, 1 boilerplate."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves  # FEATURES x 2, and 2 x 2 from state to state

    @staticmethod
    def order(text: np.ndarray, n: int):
        """Texts by falling number of lines, the first line of each, and how many have a line t."""
        count = np.bincount(text, minlength=n)
        first = np.r_[0, np.cumsum(count)[:-1]]
        by = np.argsort(-count, kind="stable")
        most = int(count.max()) if n else 0
        reach = np.searchsorted(-count[by], -np.arange(most), side="left")
        return by, first, count, reach

    def viterbi(self, features: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """The likeliest states of all lines; ties go to content."""
        score = features @ self.weights
        by, first, count, reach = self.order(text, n)
        states = np.zeros(len(text), np.int8)
        back = np.zeros((len(text), 2), np.int8)
        best = np.zeros((n, 2))
        for t, m in enumerate(reach):
            line = first[by[:m]] + t
            if t:
                via = best[:m, :, None] + self.moves[None]
                back[line] = via.argmax(1)
                best[:m] = via.max(1)
            best[:m] += score[line]
        final = best.argmax(1)
        current = np.zeros(n, np.int8)
        for t in range(len(reach) - 1, -1, -1):
            m = reach[t]
            line = first[by[:m]] + t
            ends = count[by[:m]] == t + 1
            current[:m] = np.where(ends, final[:m], current[:m])
            states[line] = current[:m]
            current[:m] = back[line, current[:m]]
        return states

    @classmethod
    def fit(cls, features: np.ndarray, text: np.ndarray, n: int, states: np.ndarray) -> Chain:
        """Penalised maximum likelihood by full-batch Adam; expectations by forward and backward sums."""
        by, first, count, reach = cls.order(text, n)
        w = np.zeros((features.shape[1], 2))
        moves = np.zeros((2, 2))
        one = np.eye(2)[states]
        prev = np.r_[-1, np.arange(len(text) - 1)]
        prev[first] = -1
        inner = prev >= 0
        seen_w = features.T @ one
        seen_m = one[prev[inner]].T @ one[inner]
        mean = [np.zeros_like(w), np.zeros_like(moves)]
        var = [np.zeros_like(w), np.zeros_like(moves)]
        for step in range(1, STEPS + 1):
            score = features @ w
            a, b = np.zeros((len(text), 2)), np.zeros((len(text), 2))
            for t, m in enumerate(reach):
                line = first[by[:m]] + t
                a[line] = score[line]
                if t:
                    via = a[line - 1][:, :, None] + moves[None]
                    a[line] += np.logaddexp(via[:, 0], via[:, 1])
            for t in range(len(reach) - 2, -1, -1):
                m = reach[t + 1]
                line = first[by[:m]] + t
                via = moves[None] + (score[line + 1] + b[line + 1])[:, None, :]
                b[line] = np.logaddexp(via[:, :, 0], via[:, :, 1])
            z = np.logaddexp((a + b)[:, 0], (a + b)[:, 1])
            p = np.exp(a + b - z[:, None])
            i = np.flatnonzero(inner)
            pair = np.exp(a[i - 1][:, :, None] + moves[None] + (score[i] + b[i])[:, None, :] - z[i][:, None, None])
            for k, g in enumerate(((seen_w - features.T @ p) / n - RIDGE * w, (seen_m - pair.sum(0)) / n - RIDGE * moves)):
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.99 * var[k] + 0.01 * g * g
                move = STEP * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)
                if k:
                    moves = moves + move
                else:
                    w = w + move
        return cls(w, moves)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Chain | None:
    """A chain from labelled documents, whose lines all carry the document's label.

    The bound: PER_CLASS documents of each label, the first by md5 of the id, of at most MAX_CHARS
    characters and MAX_LINES lines, so that whole texts fit. None if a label is missing.
    """
    short = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(text_col) <= MAX_CHARS) & (F.size(F.split(text_col, "\n")) <= MAX_LINES))
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).distinct()
    known = short.select(F.col(id_col).alias("__id")).join(marked, "__id")
    order = F.md5(F.col("__id").cast("string"))
    some = [known.where(F.col("__y") == y).orderBy(order, "__id").limit(PER_CLASS) for y in (0, 1)]
    picked = F.broadcast(some[0].unionByName(some[1]))  # bounded by the two limits
    rows = short.join(picked, F.col(id_col) == F.col("__id")).select(F.col(text_col).alias("text"), "__y").orderBy(F.md5("text")).limit(2 * PER_CLASS).collect()
    if len({r["__y"] for r in rows}) < 2:
        return None
    texts = [r["text"] for r in rows]
    parts = [(i, measure(texts[i:j])) for i, j in chunks_of(texts)]
    f = np.concatenate([m[1] for _, m in parts])
    text = np.concatenate([i + m[2] for i, m in parts])
    return Chain.fit(f, text, len(rows), 1 - np.array([int(r["__y"]) for r in rows])[text])


def judge(docs: DataFrame, chain: Chain | None, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share and kept.

    base_failed: under 20 words, or over 30 % of the words in windows of 8 words that stand twice or more.
    content_share: word characters in lines that the chain labels content, of all. A text is kept if it
    passes the base rules and its share is MIN_SHARE or more; without a chain the base rules decide. A null
    text has no words. Columns named like the outputs are replaced; whole texts are judged.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    added = [*longs, "base_failed", "content_share", "kept"]
    keep = [c for c in docs.columns if c not in added]

    def run(batches):
        model = shared.value
        for b in batches:
            texts = b.column(text_col).to_pylist()
            for i, j in chunks_of(texts):
                base, f, text, chars = measure(texts[i:j])
                failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
                if model is None:
                    share = np.ones(j - i)
                else:
                    content = model.viterbi(f, text, j - i) == 0
                    share = np.bincount(text, chars * content, j - i) / np.maximum(1, base["word_chars"])
                part = b.slice(i, j - i)
                made = [pa.array(base[k].astype(np.int64)) for k in longs] + [pa.array(failed), pa.array(share), pa.array(~failed & (share >= MIN_SHARE))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, names=[*keep, *added])

    out = docs.select(*keep)
    for k in longs:
        out = out.withColumn(k, F.lit(0).cast("long"))
    schema = out.withColumn("base_failed", F.lit(True)).withColumn("content_share", F.lit(0.0)).withColumn("kept", F.lit(True)).schema
    return docs.mapInArrow(frugal(run), schema)
