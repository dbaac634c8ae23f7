"""Removal of long repeated byte strings by bucket-pointer refinement of sampled suffixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import _powers, chunks_of, frugal, mix64, ship, stage

GRAM = 64  # q: bytes of the initial buckets
SHORT = 250  # bytes of the shorter strings by which repeated passages are found
WORDS = 50  # words that such a passage has more of
HOT = 2048  # contexts in a bucket beyond which its windows are counted as rows
STRIDE = 16  # windows of a chunk of a huge bucket's context
ROUND = 700_000  # bytes of whole buckets that are refined together
PIECE = 1_000_000  # bytes of one text that are worked on at a time
_LOW = np.uint64((1 << 24) - 1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class _Hash:
    """Hashes of any span of a buffer from one prefix sum."""

    def __init__(self, buf: np.ndarray):
        self.pow, self.inv = _powers(len(buf) + 1)
        self.prefix = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.pow[: len(buf)], out=self.prefix[1:])

    def spans(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[e] - self.prefix[s]) * self.inv[s])


def anchors(buf: np.ndarray, at: np.ndarray, starts: np.ndarray, short: int, length: int) -> tuple[np.ndarray, ...] | None:
    """Sampled suffixes: text number, bucket, context hash, first and last window start, for each anchor.

    at: where each text begins in buf, and the end; starts: how many windows begin in each. A window is a string of
    ``short`` bytes; its anchor is the leftmost of its GRAM-byte strings with the least hash, so equal windows have
    equal anchors at equal places. An anchor's windows are consecutive, its bucket is its q-gram's hash, and its
    context ends ``length`` bytes after the start of its last window, or with the text. Equal strings of ``length``
    bytes begin with equal windows, so they meet in the same bucket.
    """
    n, w = len(buf), short - GRAM + 1
    if n < short:
        return None
    hashed = _Hash(buf)
    i = np.arange(n - GRAM + 1)
    h = hashed.spans(i, i + GRAM)
    least, k = (h & ~_LOW) | i.astype(np.uint64), 1
    size = len(least) - w + 1
    while k * 2 <= w:
        least, k = np.minimum(least[:-k], least[k:]), k * 2
    least = np.minimum(least[:size], least[w - k : w - k + size])
    start = np.arange(size)
    text = np.searchsorted(at, start, side="right") - 1
    ok = start - at[text] < starts[text]
    start, text, pos = start[ok], text[ok], (least[ok] & _LOW).astype(np.int64)
    if not len(start):
        return None
    first = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (text[1:] != text[:-1])])
    lo, hi, pos, text = start[first], start[np.r_[first[1:] - 1, len(start) - 1]], pos[first], text[first]
    end = np.minimum(hi + length, at[text + 1])
    shape = (hi - lo).astype(np.uint64) * _GOLD + (pos - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (end - hi).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    context = mix64(hashed.spans(lo, end) + shape)
    return text, h[pos].view(np.int64), context.view(np.int64), lo - at[text], hi - at[text]


def refine(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, end: np.ndarray, short: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings of ``short`` and of ``length`` bytes that start in lo..hi stand twice or more.

    Contexts are lo..end of buf. Bucket-pointer refinement: positions start in the buckets of their GRAM-byte
    strings; a bucket of strings of n bytes is refined by sorting on the pointers of the buckets n bytes later, which
    the round before left there, so lengths double; positions alone in a bucket leave at once and are never
    sorted again. Only starts in lo..hi count for the results, as contexts of a text may overlap beyond.
    """
    hashed = _Hash(buf)
    size = end - lo
    live = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    limit, last = np.repeat(end, size), np.repeat(hi, size)
    room = live + GRAM <= limit
    live, limit, last = live[room], limit[room], last[room]
    names, inverse, count = np.unique(hashed.spans(live, live + GRAM), return_inverse=True, return_counts=True)
    n, found = GRAM, []
    while True:
        if n in (short, length):
            own = live <= last
            found.append(live[own][np.bincount(inverse[own], minlength=len(names))[inverse[own]] > 1])
        if n == length:
            return found[0], found[-1]
        pointer = np.full(len(buf) + 1, -1, np.int64)
        pointer[live] = np.where(count[inverse] > 1, inverse, -1)
        step = min(n, (short if n < short else length) - n)
        room = (pointer[live] >= 0) & (live + n + step <= limit)
        live, limit, last = live[room], limit[room], last[room]
        later = pointer[live + step]
        fit = later >= 0
        live, limit, last, later = live[fit], limit[fit], last[fit], later[fit]
        pairs = pointer[live] * np.int64(len(names) + 1) + later
        names, inverse, count = np.unique(pairs, return_inverse=True, return_counts=True)
        n += step


def _pieces(raw: list[bytes], short: int, length: int):
    """(text number, offset, bytes, windows that begin here), so that each window is one piece's alone."""
    for k, r in enumerate(raw):
        windows = len(r) - short + 1
        for s in range(0, windows, PIECE):
            yield k, s, r[s : s + PIECE + length - 1], min(PIECE, windows - s)


def _sampled(texts: DataFrame, short: int, length: int) -> DataFrame:
    """All anchors of (id, u, text): bucket h, context hash c, and where they are."""
    ship(texts.sparkSession)

    def run(batches):
        for b in batches:
            held = b.column("text").to_pylist()
            ids, us = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "u"))
            for i, j in chunks_of(held):
                parts = list(_pieces([(t or "").encode() for t in held[i:j]], short, length))
                group, size = [], 0
                for p in [*parts, None]:
                    if group and (p is None or size + len(p[2]) > PIECE + length):
                        at = np.cumsum([0] + [len(g[2]) for g in group])
                        found = anchors(np.frombuffer(b"".join(g[2] for g in group), np.uint8), at, np.array([g[3] for g in group]), short, length)
                        if found is not None:
                            which, h, c, lo, hi = found
                            of = np.array([g[0] for g in group])[which] + i
                            shift = np.array([g[1] for g in group])[which]
                            yield pa.RecordBatch.from_pydict({"h": h, "c": c, "id": ids[of], "u": us[of], "lo": lo + shift, "hi": hi + shift})
                        group, size = [], 0
                    if p is not None:
                        group.append(p)
                        size += len(p[2])

    return texts.mapInArrow(frugal(run), "h long, c long, id long, u long, lo long, hi long")


def _packed(texts: DataFrame) -> DataFrame:
    """Texts as zstd-compressed bytes, which is what moves in the two joins."""
    ship(texts.sparkSession)

    def run(batches):
        for b in batches:
            codec = pa.Codec("zstd", 3)
            raw = [(t or "").encode() for t in b.column("text").to_pylist()]
            packed = [codec.compress(r, asbytes=True) if r else b"" for r in raw]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("u"), pa.array([len(r) for r in raw], pa.int64()), pa.array(packed, pa.binary())], names=["id", "u", "n", "packed"])

    return texts.mapInArrow(frugal(run), "id long, u long, n long, packed binary")


def _unpacked(n: int, packed: bytes) -> bytes:
    return pa.Codec("zstd").decompress(packed, decompressed_size=n, asbytes=True) if n else b""


def _contexts(joined: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for n, packed, id_, u, spans in zip(*(b.column(c).to_pylist() for c in ("n", "packed", "id", "u", "spans")), strict=True):
                raw = _unpacked(n, packed)
                for i in range(0, len(spans), 5000):
                    part = spans[i : i + 5000]
                    out = {k: [s[k] for s in part] for k in ("h", "lo", "hi")} | {"id": [id_] * len(part), "u": [u] * len(part)}
                    yield pa.RecordBatch.from_pydict({k: out[k] for k in ("h", "id", "u", "lo", "hi")} | {"bytes": [raw[s["lo"] : s["hi"] + length] for s in part]})

    return joined.mapInArrow(frugal(run), "h long, id long, u long, lo long, hi long, bytes binary")


_FOUND = "id long, u long, lo long, hi long, of int"


def _refined(contexts: DataFrame, short: int, length: int) -> DataFrame:
    """Repeated strings (id, u, first and last start, their length) of buckets that a task can hold; whole buckets are refined together."""

    def done(t):
        raw = t.column("bytes").to_pylist()
        size = np.array([len(r) for r in raw])
        at = np.r_[0, np.cumsum(size)]
        begin, lo = t.column("lo").to_numpy(), at[:-1]
        both = refine(np.frombuffer(b"".join(raw), np.uint8), lo, lo + t.column("hi").to_numpy() - begin, at[1:], short, length)
        for twice, of in zip(both, (short, length), strict=True):
            if len(twice):
                context = np.searchsorted(at, twice, side="right") - 1
                start = np.flatnonzero(np.r_[True, (np.diff(twice) > 1) | (np.diff(context) > 0)])
                stop = np.r_[start[1:] - 1, len(twice) - 1]
                k = context[start]
                base = begin[k] - lo[k]
                yield pa.RecordBatch.from_pydict(
                    {"id": t.column("id").to_numpy()[k], "u": t.column("u").to_numpy()[k], "lo": base + twice[start], "hi": base + twice[stop], "of": np.full(len(k), of, np.int32)}
                )

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if rest is not None and rest.num_rows:
                t = pa.concat_tables([rest, t])
            h = t.column("h").to_numpy()
            size = np.cumsum(pc.binary_length(t.column("bytes")).to_numpy())
            begin = 0
            for cut in (np.flatnonzero(h[1:] != h[:-1]) + 1).tolist():
                if size[cut - 1] - (size[begin - 1] if begin else 0) > ROUND:
                    yield from done(t.slice(begin, cut - begin).combine_chunks())
                    begin = cut
            rest = t.slice(begin).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from done(rest)

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(frugal(run), _FOUND)


def _counted(contexts: DataFrame, short: int, length: int) -> DataFrame:
    """Repeated strings of ``length`` bytes of the few huge buckets, by counts that are aggregated on the map side.

    Windows are the strings of ``length`` bytes that start in a context's lo..hi and end in its text. A context's windows are dealt to chunks of STRIDE places relative to its anchor, so equal windows are in like
    chunks. A chunk whose core, what all its windows share, stands once has no repeated window; one whose union
    stands twice has only such; just the windows of the others are counted one by one.
    """

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("core", "whole", "id", "u", "lo", "ws")}
            for raw, id_, u, lo, hi in zip(*(b.column(c).to_pylist() for c in ("bytes", "id", "u", "lo", "hi")), strict=True):
                n = min(len(raw) - length, hi - lo) + 1
                if n <= 0:
                    continue
                hashed = _Hash(np.frombuffer(raw, np.uint8))
                g = np.arange(short - GRAM + 1)
                anchor = int(np.argmin(hashed.spans(g, g + GRAM) & ~_LOW))
                s = np.arange(n)
                windows = hashed.spans(s, s + length).view(np.int64)
                first = np.flatnonzero(np.r_[True, np.diff((s - anchor) // STRIDE) != 0])
                for x, y in zip(first.tolist(), [*first[1:].tolist(), n], strict=True):
                    begin = (x - anchor) // STRIDE * STRIDE + anchor
                    core = hashed.spans(np.array([begin + STRIDE - 1]), np.array([begin + length]))
                    whole = hashed.spans(np.array([x]), np.array([y - 1 + length])).view(np.int64)[0] if y - x == STRIDE else None
                    for k, v in zip(out, (core.view(np.int64)[0], whole, id_, u, lo + x, windows[x:y].tolist()), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.list_(pa.int64()) if k == "ws" else pa.int64()) for k in out]))

    chunks = stage(contexts.mapInArrow(frugal(run), "core long, whole long, id long, u long, lo long, ws array<long>"), "chunks")
    again = lambda c: stage(chunks.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1").select(c), f"twice_{c}")
    open_ = chunks.join(again("core"), "core").join(again("whole").withColumn("all", F.lit(True)), "whole", "left")
    whole = open_.where("all").select("id", "u", "lo", (F.col("lo") + F.size("ws") - 1).alias("hi"))
    single = open_.where("all IS NULL").select("id", "u", "lo", F.posexplode("ws").alias("k", "w"))
    # a window of a whole chunk repeats already; one chunk tells it to the others that are cut off within the chunk
    told = open_.where("all").groupBy("whole").agg(F.any_value("ws").alias("ws")).select(F.explode("ws").alias("w"), F.lit(2).alias("n"))
    counted = single.select("w", F.lit(1).alias("n")).unionByName(told)
    twice = stage(counted.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").select("w"), "hot_windows")
    one = single.join(twice, "w").select("id", "u", (F.col("lo") + F.col("k")).alias("lo"), (F.col("lo") + F.col("k")).alias("hi"))
    return whole.unionByName(one).withColumn("of", F.lit(length))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, short: int = SHORT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, kept (binary), n_removed, n_spans, kept_sha256, n_passages.

    Each byte goes that lies in a string of ``length`` bytes (GRAM at least) which also starts anywhere else in the
    corpus, the same text included. Texts are UTF-8, matches never cross texts, a null text is empty, and
    strings are judged on the input. Repeated rows are texts of their own, so all their windows repeat. A null
    id is kept as null. Empty input gives empty output.

    n_passages counts what is found besides and not removed by it: the maximal runs of bytes in repeated strings of ``short``
    bytes (``length``, if that is less) that hold more than WORDS words, as such a passage can be shorter than ``length``.

    Only about 2 in (short - GRAM) suffixes are sampled, by content, so that equal windows are sampled
    alike. Buckets are counted with map-side aggregation; where all anchors of a bucket have the same context, all its windows
    repeat and no text moves. Other buckets' contexts, windows and their surroundings of under 2 * length bytes, are
    refined bucket by bucket, and beyond HOT contexts window by window. Texts move twice, compressed.
    """
    if min(length, short) < GRAM:
        raise ValueError(f"lengths must be {GRAM} or more")
    short = min(short, length)
    texts = docs.select(F.col(id_col).cast("long").alias("given"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.col(text_col)).alias("u"), F.col(text_col).alias("text"))
    texts = texts.withColumn("u", F.when(F.col("given").isNull(), F.xxhash64("u", F.lit("null"))).otherwise(F.col("u"))).select("id", "u", "text")
    sampled = stage(_sampled(texts, short, length), "sampled")
    counts = sampled.groupBy("h").agg(F.count("*").alias("k"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    buckets = stage(counts.where("k > 1").select("h", "k", (F.col("c0") != F.col("c1")).alias("mixed")), "buckets")
    hits = stage(sampled.join(buckets, "h").select("h", "k", "mixed", "id", "u", "lo", "hi", "c"), "anchors")
    same = stage(hits.where("mixed").groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "u", "lo", "hi")).alias("one")), "contexts_counted")
    alike = hits.where("mixed").join(same.where("n > 1"), ["h", "c"])
    # one of several equal contexts stands for them in the refinement of the others
    open_ = hits.where("mixed").join(same.where("n = 1").select("h", "c"), ["h", "c"], "left_semi").select("id", "u", "h", "lo", "hi")
    stand_in = same.where("n > 1").select("one.id", "one.u", "h", "one.lo", "one.hi")
    wanted = stage(open_.unionByName(stand_in), "open_anchors")
    by_text = wanted.groupBy("id", "u").agg(F.collect_list(F.struct("h", "lo", "hi")).alias("spans"))
    contexts = stage(_contexts(_packed(texts).join(by_text, ["id", "u"]).dropDuplicates(["id", "u"]), length), "contexts")
    sizes = wanted.groupBy("h").count().where(F.col("count") > HOT)
    hot = stage(sizes.select("h"), "hot_buckets")
    huge = contexts.join(hot, "h", "left_semi")
    found = _refined(contexts.join(hot, "h", "left_anti"), short, length)
    for n in {short, length}:
        found = found.unionByName(_counted(huge, short, n))
    found = stage(found, "repeated")
    spans = hits.where("not mixed").select("id", "u", "lo", "hi").unionByName(alike.select("id", "u", "lo", "hi")).withColumn("of", F.lit(0)).unionByName(found)
    per_text = spans.groupBy("id", "u").agg(F.collect_list(F.struct("lo", "hi", "of")).alias("spans"))
    joined = _packed(texts).join(per_text, ["id", "u"], "left")

    def runs(spans_, n, of):
        """Maximal runs of bytes in the spans' strings of ``of`` bytes; spans of equal contexts (0) hold those of either length."""
        out: list[list[int]] = []
        for lo, hi in sorted({(s["lo"], min(s["hi"] + of, n)) for s in spans_ if s["of"] in (0, of) and s["lo"] + of <= n}):
            if out and lo <= out[-1][1]:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
        return out

    def run(batches):
        for b in batches:
            rows = {k: [] for k in ("id", "n_bytes", "n_removed", "n_spans", "kept", "sha", "n_passages")}
            for n, packed, id_, spans_ in zip(*(b.column(c).to_pylist() for c in ("n", "packed", "id", "spans")), strict=True):
                raw = _unpacked(n, packed)
                gone = runs(spans_ or (), n, length)
                left = b"".join(raw[x:y] for x, y in zip([0, *[hi for _, hi in gone]], [*[lo for lo, _ in gone], n], strict=True))
                passages = sum(len(raw[lo:hi].split()) > WORDS for lo, hi in runs(spans_ or (), n, short))
                for k, v in zip(rows, (id_, n, n - len(left), len(gone), left, hashlib.sha256(left).hexdigest(), passages), strict=True):
                    rows[k].append(v)
            kinds = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("sha", pa.string()), ("n_passages", pa.int64())]
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(kinds))

    out = joined.mapInArrow(frugal(run), "id long, n_bytes long, n_removed long, n_spans long, kept binary, sha string, n_passages long")
    return out.select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", F.col("sha").alias("kept_sha256"), "n_passages")
