"""Phrase collocations by set-oriented mining: sorted occurrence relations are extended word by word.

The occurrence relation of length k says where each frequent phrase of k words stands, sorted by piece and
position. Its merge join with the words at the next position gives the candidates of length k + 1; these are
counted by group, and only occurrences of frequent groups go into the next relation. Relations are Parquet tables
with one row for each slice of the corpus, in which occurrences are packed arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import frugal, mix64, ship, span_hashes, stage, unstage

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
SLICE_WORDS = 1 << 20
#: Occurrences for each group of candidates that is counted together, and bytes of text that are split at once.
GROUP_WORDS, WINDOW_BYTES = 1 << 21, 4 << 20

# The contract's separators of words and of pieces. Fixed values.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pack(a: np.ndarray) -> bytes:
    """Numbers from 0 up in the narrowest type that holds them all, behind its width: all lowest bytes, then all second ones, and so on.

    High bytes are mostly alike, so codecs of shuffles and files make little of them when they stand together.
    """
    most = int(a.max()) if len(a) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{b[0]}").ravel().astype(np.int64)


def _windows(raw: bytes, size: int = WINDOW_BYTES):
    """Parts of a text of about ``size`` bytes, cut at piece separators; a longer piece stays whole."""
    at = 0
    while len(raw) - at > size:
        cuts = np.flatnonzero(_CLASS[np.frombuffer(raw, np.uint8, size, at)] == 2)
        if len(cuts):
            end = at + int(cuts[-1]) + 1
        else:
            end = at + size
            while end < len(raw) and _CLASS[raw[end]] != 2:
                end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def split_words(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of a text, and each one's step from the word before: 1 in one piece, else 2."""
    buf = _LOWER[np.frombuffer(raw, np.uint8)]
    kind = _CLASS[buf]
    inside = kind == 0
    edge = np.diff(np.r_[np.int8(0), inside.view(np.int8), np.int8(0)])
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    breaks = np.r_[0, np.cumsum(kind == 2, dtype=np.int32)][starts] if len(buf) else np.zeros(0, np.int32)
    step = np.ones(len(starts), np.uint8)
    if len(step):
        step[0] = 2
        step[1:] += breaks[1:] > breaks[:-1]
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(buf[inside]))])
    return words, step


#: Words are joined by spaces, which stand in none.
SLICES = "slice long, lang string, n long, words binary, counts binary, ids binary, step binary"


def _slices(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """The relation of single words: a row for each language of a stretch of rows, with its own dictionary."""

    def run(batches):
        held: dict[str, tuple[list, list]] = {}
        total, made = 0, 0
        first = TaskContext.get().partitionId() << 32

        def flush():
            nonlocal made
            for lang, (words, steps) in held.items():
                coded = pa.chunked_array(words, pa.large_binary()).dictionary_encode().combine_chunks()
                coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
                ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.bincount(ids, minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([first + made]), pa.array([lang], pa.string()), pa.array([len(ids)]), pa.array([b" ".join(coded.dictionary.to_pylist())], pa.binary()),
                        pa.array([pack(counts)], pa.binary()), pa.array([pack(ids)], pa.binary()), pa.array([pack(np.concatenate(steps))], pa.binary()),
                    ],
                    names=["slice", "lang", "n", "words", "counts", "ids", "step"],
                )
                made += 1

        for b in batches:
            langs, texts = b.column(1).to_pylist(), b.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                joined = "\n".join(t for t, g in zip(texts, langs) if g == lang and t).encode("utf-8", "surrogatepass")
                for raw in _windows(joined):
                    words, step = split_words(raw)
                    if len(words):
                        own = held.setdefault(lang, ([], []))
                        own[0].append(words)
                        own[1].append(step)
                        total += len(words)
                    if total >= 2 * SLICE_WORDS:
                        yield from flush()
                        held, total = {}, 0
        yield from flush()

    return docs.select(F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(lang_col, F.lit("und")).alias("lang")).mapInArrow(frugal(run), SLICES)


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, and their sums."""
    order = np.argsort(keys, kind="stable")
    head = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0]) if len(keys) else np.zeros(0, int)
    return keys[order[head]], order[head], np.add.reduceat(counts[order], head) if len(head) else counts[:0]


def _pairs(g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number for each pair, the same for equal ones: packed where both fit in 32 bits, else by ranks."""
    if len(g) and (int(g.max()) >= 1 << 31 or int(w.max()) >= 1 << 32):
        g, w = (np.unique(x, return_inverse=True)[1] for x in (g, w))
    return (g.astype(np.int64) << 32) | w


def _spread(h: np.ndarray, groups: int):
    """(group, members) by hash, of the groups that have members."""
    part = (h % np.uint64(groups)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    head = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0]) if len(part) else np.zeros(0, int)
    for a, b in zip(head, [*head[1:], len(order)]):
        yield int(part[order[a]]), order[a:b]


WORD_BLOCKS = "p long, slice long, lang string, idx binary, words binary, counts binary"
#: Counted groups: rows with a slice tell it which of its candidates are frequent; those without are the groups.
WORD_COUNTS = "slice long, idx binary, gid binary, lang string, words binary, counts binary"


def _hash_words(joined: bytes) -> np.ndarray:
    buf = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(buf == 0x20)
    return span_hashes(buf, np.r_[0, gaps + 1], np.r_[gaps, len(buf)])


def _word_blocks(slices: DataFrame, groups: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                joined = b.column("words")[k].as_py()
                words = np.array(joined.split(b" "), object)
                counts = unpack(b.column("counts")[k].as_py())
                out = [(p, m, b" ".join(words[m]), counts[m]) for p, m in _spread(_hash_words(joined), groups)]
                n = len(out)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in out], pa.int64()), pa.array([b.column("slice")[k].as_py()] * n, pa.int64()), pa.array([b.column("lang")[k].as_py()] * n, pa.string()),
                        pa.array([pack(x[1]) for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary()), pa.array([pack(x[3]) for x in out], pa.binary()),
                    ],
                    names=["p", "slice", "lang", "idx", "words", "counts"],
                )

    return slices.select("slice", "lang", "words", "counts").mapInArrow(frugal(run), WORD_BLOCKS)


def _count_words(blocks: DataFrame, groups: int, min_count: int) -> DataFrame:
    def run(key, t):
        p, out, made = key[0].as_py(), [], 0
        for lang in pc.unique(t.column("lang")).to_pylist():
            own = t.filter(pc.equal(t.column("lang"), lang))
            rows = [unpack(x) for x in own.column("counts").to_pylist()]
            words = [w for x in own.column("words").to_pylist() for w in x.split(b" ")]
            flat = pa.table({"w": pa.array(words, pa.large_binary()), "c": pa.array(np.concatenate(rows))})
            total = flat.group_by("w").aggregate([("c", "sum")])
            total = total.filter(pc.greater_equal(total.column("c_sum"), min_count))
            gid = (made + np.arange(total.num_rows)) * groups + p + 1
            made += total.num_rows
            if not total.num_rows:
                continue
            place = pc.index_in(flat.column("w"), value_set=total.column("w").combine_chunks()).fill_null(-1).to_numpy()
            at = 0
            for s, idx, c in zip(own.column("slice").to_pylist(), own.column("idx").to_pylist(), rows):
                here = place[at : at + len(c)]
                at += len(c)
                hit = here >= 0
                if hit.any():
                    out.append((s, pack(unpack(idx)[hit]), pack(gid[here[hit]]), None, None, None))
            out.append((None, None, pack(gid), lang, b" ".join(total.column("w").to_pylist()), pack(total.column("c_sum").to_numpy())))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary()]
        names = ["slice", "idx", "gid", "lang", "words", "counts"]
        return pa.table([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=names)

    return blocks.groupBy("p").applyInArrow(run, WORD_COUNTS)


RELATION = "slice long, n long, gid binary, next binary, step binary"


def _table(rows: list[tuple], kinds: list, names: list[str]) -> pa.Table:
    return pa.table([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _relation(rows: list[tuple]) -> pa.Table:
    return _table(rows, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], ["slice", "n", "gid", "next", "step"])


def _shown(s: int, keep: np.ndarray, gid: np.ndarray, following: np.ndarray | None, step: np.ndarray) -> pa.Table:
    """A slice of the next relation: the occurrences that stay, with the step from the one before that stays."""
    at = np.flatnonzero(keep)
    if not len(at):
        return _relation([])
    beside = np.r_[False, (np.diff(at) == 1) & (step[at[1:]] == 1)]
    return _relation([(s, len(at), pack(gid[at]), None if following is None else pack(following[at]), pack(np.where(beside, 1, 2)))])


def _frequent_words(slices: DataFrame, counted: DataFrame) -> DataFrame:
    """The relation of length 1: occurrences of frequent words. Longer ones also have the word that follows."""

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return _relation([])
        coded, step = unpack(left.column("ids")[0].as_py()), unpack(left.column("step")[0].as_py())
        number = np.zeros(int(coded.max()) + 1, np.int64)
        for idx, gid in zip(right.column("idx").to_pylist(), right.column("gid").to_pylist()):
            number[unpack(idx)] = unpack(gid)
        gid = number[coded]
        return _shown(left.column("slice")[0].as_py(), gid > 0, gid, None, step)

    back = counted.where(F.col("slice").isNotNull()).select("slice", "idx", "gid")
    return slices.select("slice", "ids", "step").groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(run, RELATION)


def _joined(gid: bytes, following: bytes | None, step: bytes) -> tuple[np.ndarray, ...]:
    """The merge join with the words at the next position: phrase, word, word after that, place in the relation.

    An extension needs the phrase at the next position to be frequent too, so it stands in the relation, one step
    away, and knows the word after.
    """
    g, s = unpack(gid), unpack(step)
    w = np.r_[np.where(s[1:] == 1, g[1:], 0), 0] if following is None else unpack(following)
    at = np.flatnonzero((w[:-1] > 0) & (s[1:] == 1))
    return g[at], w[at], w[at + 1], at, s


#: Candidates come sorted, so of g the differences are kept.
BLOCKS = "p long, slice long, g binary, w binary, counts binary"
COUNTS = "slice long, g binary, w binary, gid binary, counts binary"


def _blocks(relation: DataFrame, groups: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                g, w, *_ = _joined(*(b.column(c)[k].as_py() for c in ("gid", "next", "step")))
                _, at, counts = _sum(_pairs(g, w), np.ones(len(g), np.int64))
                g, w = g[at], w[at]
                h = mix64(mix64(g.astype(np.uint64)) + w.astype(np.uint64))
                out = [(p, b.column("slice")[k].as_py(), pack(np.diff(g[m], prepend=0)), pack(w[m]), pack(counts[m])) for p, m in _spread(h, groups)]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield from _table(out, kinds, ["p", "slice", "g", "w", "counts"]).to_batches()

    return relation.mapInArrow(frugal(run), BLOCKS)


def _count(blocks: DataFrame, groups: int, min_count: int) -> DataFrame:
    def run(key, t):
        p, out = key[0].as_py(), []
        g, w, c = ([unpack(x) for x in t.column(name).to_pylist()] for name in ("g", "w", "counts"))
        g = [np.cumsum(x) for x in g]
        size = [len(x) for x in c]
        ga, wa = np.concatenate(g), np.concatenate(w)
        key_ = _pairs(ga, wa)
        found, at, total = _sum(key_, np.concatenate(c))
        often = total >= min_count
        found, at, total = found[often], at[often], total[often]
        gid = np.arange(len(found)) * groups + p + 1
        if len(found):
            place = np.minimum(np.searchsorted(found, key_), len(found) - 1)
            hit = found[place] == key_
            begin = 0
            for s, n in zip(t.column("slice").to_pylist(), size):
                i = begin + np.flatnonzero(hit[begin : begin + n])
                begin += n
                if len(i):
                    out.append((s, pack(ga[i]), pack(wa[i]), pack(gid[place[i]]), None))
            out.append((None, pack(ga[at]), pack(wa[at]), pack(gid), pack(total)))
        return _table(out, [pa.int64(), *[pa.binary()] * 4], ["slice", "g", "w", "gid", "counts"])

    return blocks.groupBy("p").applyInArrow(run, COUNTS)


def _extend(relation: DataFrame, counted: DataFrame) -> DataFrame:
    """The relation of one word more: the semi-join of the joined occurrences with the frequent groups."""

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return _relation([])
        g, w, after, at, step = _joined(*(left.column(c)[0].as_py() for c in ("gid", "next", "step")))
        fg, fw, number = (np.concatenate([unpack(x) for x in right.column(c).to_pylist()]) for c in ("g", "w", "gid"))
        key = _pairs(np.r_[fg, g], np.r_[fw, w])
        mine, key = key[: len(fg)], key[len(fg) :]
        order = np.argsort(mine)
        place = np.minimum(np.searchsorted(mine, key, sorter=order), len(mine) - 1)
        hit = mine[order[place]] == key
        gid, following, keep = (np.zeros(len(step), np.int64) for _ in range(3))
        gid[at], following[at], keep[at] = number[order[place]], after, hit
        return _shown(left.column("slice")[0].as_py(), keep > 0, gid, following, step)

    back = counted.where(F.col("slice").isNotNull()).select("slice", "g", "w", "gid")
    return relation.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(run, RELATION)


def _words_of(counted: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                words = [w.decode("utf-8", "surrogatepass") for w in b.column("words")[k].as_py().split(b" ")]
                gid = pa.array(unpack(b.column("gid")[k].as_py()))
                n = len(gid)
                yield pa.RecordBatch.from_arrays([gid, pa.array([b.column("lang")[k].as_py()] * n, pa.string()), pa.array(words, pa.string()), pa.array(unpack(b.column("counts")[k].as_py()))], names=["gid", "lang", "phrase", "a"])

    found = counted.where(F.col("slice").isNull()).select("gid", "lang", "words", "counts")
    return found.mapInArrow(run, "gid long, lang string, phrase string, a long").withColumn("ids", F.array("gid"))


def _groups_of(counted: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(unpack(b.column(c)[k].as_py())) for c in ("g", "w", "gid", "counts")], names=["g", "w", "gid", "a"])

    return counted.where(F.col("slice").isNull()).select("g", "w", "gid", "counts").mapInArrow(run, "g long, w long, gid long, a long")


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS
) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to max_words words that occur min_count times in a language, and the words of each language.

    The first table has lang, phrase (its words joined by spaces), ids (one number for each word), a (occurrences);
    the second lang and n. Words and pieces are those of ``collocations``. Phrases of a word are frequent words.

    Candidates are counted in groups by hash, of about GROUP_WORDS occurrences each: a slice sends a group its
    distinct candidates with counts, once, so a pair of words that is everywhere costs a row for each slice.
    """
    spark = docs.sparkSession
    ship(spark)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = lambda t: max(least, -(-(t.agg(F.sum("n")).first()[0] or 0) // GROUP_WORDS))
    slices = stage(_slices(docs, text_col, lang_col), "phrase_slices")
    k = groups(slices)
    counted = stage(_count_words(_word_blocks(slices, k), k, min_count), "phrase_words")
    words = stage(_words_of(counted), "phrase_found1")
    relation = stage(_frequent_words(slices, counted), "phrase_relation1")
    totals = stage(slices.groupBy("lang").agg(F.sum("n").alias("n")), "phrase_totals")
    unstage(slices, counted)
    out = [words]
    for size in range(2, max_words + 1):
        k = groups(relation)
        counted = stage(_count(_blocks(relation, k), k, min_count), f"phrase_counts{size}")
        last = words.select(F.col("gid").alias("w"), F.col("phrase").alias("__word"))
        before = out[-1].select(F.col("gid").alias("g"), "lang", F.col("phrase").alias("__phrase"), F.col("ids").alias("__ids"))
        made = _groups_of(counted).join(before, "g").join(last, "w")
        out.append(stage(made.select("gid", "lang", F.concat("__phrase", F.lit(" "), "__word").alias("phrase"), "a", F.concat("__ids", F.array("w")).alias("ids")), f"phrase_found{size}"))
        if size < max_words:
            longer = stage(_extend(relation, counted), f"phrase_relation{size}")
            unstage(relation, counted)
            relation = longer
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every.select("lang", "phrase", "ids", "a"), totals


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP
) -> DataFrame:
    """The first ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; texts are split at ``.,;:!?`` and line ends into pieces, and those at spaces and tabs into words.
    Candidates are phrases of 2 to max_words words in one piece that occur a >= min_count times; l and r are the
    occurrences of the two parts of the cut with the lowest score floor(1000 * a * n / (l * r)), the first of
    equal ones; n is the number of words of the language. Candidates that stand in a longer one that is as frequent go.
    A null language is ``und``; null and empty texts have no words; repeated rows count each; an empty table gives an
    empty one; other columns than the two are not read.
    """
    every, totals = frequent_phrases(docs, text_col, lang_col, min_count, max_words)
    size = F.size("ids")
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    part = lambda name, key: every.select(F.col("ids").alias(key), F.col("a").alias(name))
    cut = every.where(size >= 2).select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.withColumn("__left", F.slice("ids", F.lit(1), F.col("k"))).withColumn("__right", F.slice("ids", F.col("k") + 1, size - F.col("k")))
    cut = cut.join(part("l", "__left"), "__left").join(part("r", "__right"), "__right").join(totals, "lang")
    cut = cut.withColumn("__above", exact("a") * exact("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("__below", exact("l") * exact("r"))
    scored = cut.withColumn("score", F.expr("__above div __below"))
    best = scored.groupBy("lang", "phrase", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # A longer phrase that is as frequent passes that on to each phrase between them, so one word more is enough to look at.
    longer = every.where(size >= 3).select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), F.col("a").alias("__longer"))
    longer = longer.groupBy("ids").agg(F.max("__longer").alias("__longer"))
    kept = best.join(longer, "ids", "left").where(F.col("__longer").isNull() | (F.col("__longer") * 100 < F.col("a") * 100))
    order = [F.col("b.score").desc(), F.col("a").desc(), F.col("phrase")]
    # First within shares of a language, so that no task sorts all of its candidates.
    share = kept.withColumn("__share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    share = share.withColumn("__near", F.row_number().over(Window.partitionBy("lang", "__share").orderBy(*order))).where(F.col("__near") <= top)
    ranked = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
