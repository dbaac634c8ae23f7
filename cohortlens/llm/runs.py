"""Periodic runs of words: a suffix automaton whose link tree is accessed as a link-cut tree.

Each appended word recolours the path from its automaton state to the root with its position. The path falls
into segments of one old colour, the last place where the segment's strings ended: the distance to that
place and the segment's greatest length give the squares that end at the word, and squares that end at
successive words with one period are one run.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import chunks_of, frugal, mix64, ship, span_hashes, word_spans

MIN_WORDS, MIN_EXPONENT = 6, 4
#: Words of a stretch from which the tree is held in packed arrays, which are slower and a fifth of the size.
PACKED = 100_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _zeros(n: int):
    return [0] * n if n < 2 * PACKED else array("q", bytes(8 * n))


def suffix_automaton(words: list[int]):
    """Lengths and suffix links of the states (1 is the root), and the state of each prefix.

    A state's first transition stands in two arrays and its others in a dictionary, as most states have one.
    """
    most = 2 * len(words) + 2
    length, link, word, to, ends = _zeros(most), _zeros(most), _zeros(most), _zeros(most), _zeros(len(words))
    others: dict[int, dict[int, int]] = {1: {}}
    size, last = 2, 1
    for i, c in enumerate(words):
        cur, size = size, size + 1
        length[cur] = i + 1
        p, q = last, 0
        while p:
            if to[p]:
                if word[p] == c:
                    q = to[p]
                    break
                more = others.get(p)
                if more is None:
                    others[p] = {c: cur}
                else:
                    q = more.get(c, 0)
                    if q:
                        break
                    more[c] = cur
            else:
                word[p], to[p] = c, cur
            p = link[p]
        if not p:
            link[cur] = 1
        elif length[q] == length[p] + 1:
            link[cur] = q
        else:
            new, size = size, size + 1
            length[new], link[new], word[new], to[new] = length[p] + 1, link[q], word[q], to[q]
            if q in others:
                others[new] = others[q].copy()
            while p:
                if word[p] == c and to[p] == q:
                    to[p] = new
                else:
                    more = others.get(p)
                    if more is None or more.get(c) != q:
                        break
                    more[c] = new
                p = link[p]
            link[q] = link[cur] = new
        ends[i] = last = cur
    return length, link, ends, size


def _splay(x: int, up, left, right, colour) -> None:
    """Bring x to the top of the splay tree of its path; a path's colour stands at the top."""
    while True:
        y = up[x]
        if not y or (left[y] != x and right[y] != x):
            return
        z = up[y]
        inner = z and (left[z] == y or right[z] == y)
        if inner:
            above = up[z]
            y_left, x_left = left[z] == y, left[y] == x
            if y_left == x_left:  # y above z, then x above y
                if y_left:
                    b, a = right[y], right[x]
                    left[z], right[y], left[y], right[x] = b, z, a, y
                else:
                    b, a = left[y], left[x]
                    right[z], left[y], right[y], left[x] = b, z, a, y
                up[z], up[y] = y, x
                if b:
                    up[b] = z
                if a:
                    up[a] = y
            else:  # x between y and z
                a, b = left[x], right[x]
                if y_left:
                    right[y], left[z], left[x], right[x] = a, b, y, z
                    if a:
                        up[a] = y
                    if b:
                        up[b] = z
                else:
                    right[z], left[y], left[x], right[x] = a, b, z, y
                    if a:
                        up[a] = z
                    if b:
                        up[b] = y
                up[y] = up[z] = x
            up[x] = above
            if above and left[above] == z:
                left[above] = x
            elif above and right[above] == z:
                right[above] = x
            else:
                colour[x] = colour[z]
                return
        else:
            if left[y] == x:
                a = right[x]
                left[y], right[x] = a, y
            else:
                a = left[x]
                right[y], left[x] = a, y
            if a:
                up[a] = y
            up[y], up[x] = x, z
            colour[x] = colour[y]
            return


def runs_of(words: list[int], min_words: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of max(min_words, exponent * period) words or more, by start and period.

    A run that ends at word i with period q shows at each of its words from that length on, as the segment of
    colour i - q; so the last word at which a period shows without a break has the whole run.
    """
    length, up, ends, size = suffix_automaton(words)
    left, right, colour = _zeros(size), _zeros(size), _zeros(size)
    for v in range(2, size):
        if up[v] == 1:  # the empty string has no squares: its children are roots
            up[v] = 0
    shown: dict[int, tuple[int, int]] = {}
    found = []
    for i, x in enumerate(ends):
        below, now = 0, i + 1
        while x:
            y = up[x]
            if y and (left[y] == x or right[y] == x):
                _splay(x, up, left, right, colour)
            was = colour[x]
            if was:
                d, size_ = now - was, length[x]
                if size_ >= (exponent - 1) * d and size_ + d >= min_words:
                    old = shown.get(d)
                    if old is not None and old[0] != i - 1:
                        found.append((old[0] - old[1] - d + 1, old[1] + d, d))
                    shown[d] = (i, size_)
            r = right[x]
            if r:
                colour[r] = was
            right[x] = below
            below, x = x, up[x]
        colour[below] = now
    found += [(end - n - d + 1, n + d, d) for d, (end, n) in shown.items()]
    return sorted(found, key=lambda r: (r[0], r[2]))


def gram(min_words: int, exponent: int) -> int:
    """Words g such that each g words of a run stand again in it, one period before or after."""
    return min(max(min_words, exponent * q) - 2 * q + 1 for q in range(1, min_words + 1))


def stretches(words: np.ndarray, doc: np.ndarray, g: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of words that hold all runs whole.

    A run's g-grams each have an equal one at most the run's length divided by the exponent away. So words outside all
    such g-grams are in no run, and what remains is cut again, with its own lengths, until nothing goes.
    """
    at, group = np.arange(len(words)), doc.astype(np.int64)
    while True:
        n = len(at)
        bound = np.flatnonzero(np.r_[True, (np.diff(group) != 0) | (np.diff(at) != 1)]) if n else np.zeros(0, int)
        size = np.diff(np.r_[bound, n])
        part = np.repeat(np.arange(len(bound)), size)
        m = n - g + 1
        if m < 2:
            return at[:0], at[:0]
        roll = np.zeros(m, np.uint64)
        w = words[at]
        for k in range(g):
            roll = mix64(roll * np.uint64(0x9E3779B97F4A7C15) + w[k : m + k])
        whole = np.flatnonzero(part[:m] == part[g - 1 :])
        key = mix64(roll[whole] + part[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        one, two = order[:-1], order[1:]
        near = (key[one] == key[two]) & (whole[two] - whole[one] <= size[part[whole[one]]] // exponent)
        marked = np.zeros(n + 1, np.int64)
        some = np.unique(np.r_[whole[one[near]], whole[two[near]]])
        np.add.at(marked, some, 1)
        np.add.at(marked, some + g, -1)
        stay = np.flatnonzero(np.cumsum(marked[:-1]) > 0)
        if len(stay) == n:
            return at[bound], at[bound] + size
        at, group = at[stay], part[stay]


def collapse_runs(
    docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, exponent: int = MIN_EXPONENT
) -> DataFrame:
    """``docs`` with ``runs`` and ``collapsed``, which replace columns of these names.

    Words are runs of other characters than ASCII white space. ``runs`` has each stretch of words of smallest
    period q and max(min_words, exponent * q) words or more (exponent 3 or more) that no neighbour extends: word number of
    the start, words, period; by start, then period. ``collapsed`` has the words that are in no run beyond its
    first period, joined by single spaces. A null or empty text, or one of white space, has no runs and collapses to ''.
    Repeated rows are judged each on its own; an empty table gives an empty one.

    Each text is worked on where it is read, without a shuffle. Only stretches that can hold runs enter the
    automaton; its memory follows the longest of them, some 100 bytes a word.
    """
    if exponent < 3 or min_words < exponent:
        raise ValueError("exponent must be 3 or more, and min_words at least the exponent")
    ship(docs.sparkSession)
    added = ["runs", "collapsed"]
    keep = [c for c in docs.columns if c not in added]
    g = gram(min_words, exponent)
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def one_slice(texts: list) -> tuple[list, list]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        s, e = word_spans(buf)
        doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), s, side="right")
        words = span_hashes(buf, s, e) if len(s) else np.zeros(0, np.uint64)
        first = np.searchsorted(doc, np.arange(len(raw)))
        runs: list[list] = [[] for _ in raw]
        for a, b in zip(*stretches(words, doc, g, exponent)):
            k = int(doc[a])
            shift = int(a - first[k])
            for start, length, period in runs_of(np.unique(words[a:b], return_inverse=True)[1].tolist(), min_words, exponent):
                runs[k].append((start + shift, length, period))
        left = []
        for r, own in zip(raw, runs):
            own.sort(key=lambda x: (x[0], x[2]))
            w = r.split()  # of bytes: at ASCII white space
            if own:
                gone = np.zeros(len(w) + 1, np.int64)
                for start, length, period in own:
                    gone[start + period] += 1
                    gone[start + length] -= 1
                w = [w[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
            left.append(b" ".join(w).decode("utf-8", "surrogatepass"))
        return [[{"start": a, "length": b, "period": c} for a, b, c in own] for own in runs], left

    def run(batches):
        for b in batches:
            texts = b.column(text_col).to_pylist()
            for i, j in chunks_of(texts):
                runs, left = one_slice(texts[i:j])
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(runs, kind), pa.array(left, pa.string())], names=[*keep, *added])

    schema = docs.select(*keep).withColumn("runs", F.lit(None).cast(RUNS)).withColumn("collapsed", F.lit("")).schema
    return docs.mapInArrow(frugal(run), schema)


def longest(runs: Column) -> Column:
    """The run of greatest length; ties go to the smallest start, then period. Null if there is none."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))


def looped(text: Column, a: Column, p: Column) -> Column:
    """The words of a text, where each word i from number a on is word a + (i - a) % p, joined by single spaces."""
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    moved = F.transform(
        F.array(split),  # a lambda's argument is computed once
        lambda w: F.array_join(F.transform(w, lambda x, i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "),
    )
    return moved[0]
