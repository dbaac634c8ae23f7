"""Near-duplicate documents by SetSketch registers: band, estimate by likelihood, verify on full sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import chunks_of, frugal, mix64, ship, span_hashes, stage, word_spans

WIDTH = 5  # words in a shingle
REGISTERS = 128  # m, a power of two
ROWS = 4  # registers in a band
BASE, RATE, TOP = 1.001, 20.0, 65534  # b, a and q of the sketch
#: A pair is dropped by the estimate only if the threshold is this much less likely (natural log) than the best fit.
DOUBT = 10.0
#: Sets of up to so many shingles are also linked without bands: with 75 percent or more, such a set and a smaller one differ in one shingle.
SMALL = 6
BLOCK = 512  # documents on each side of one comparison task
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts one after another, and where each text's begin.

    Words are runs of other characters than ASCII white space, A-Z lower-cased. Fewer words than WIDTH are
    one shingle; no words, none.
    """
    raw = [(t or "").encode().lower() for t in texts]
    at = np.cumsum([0] + [len(r) + 1 for r in raw])
    buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    s, e = word_spans(buf)
    first = np.searchsorted(s, at)
    words = span_hashes(buf, s, e) if len(s) else np.zeros(0, np.uint64)
    n = max(0, len(words) - WIDTH + 1)
    comb = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        comb = mix64(comb * np.uint64(0x9E3779B97F4A7C15) + words[k : n + k])
    out, where = [], [0]
    for i in range(len(texts)):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo >= WIDTH:
            h = np.unique(comb[lo : hi - WIDTH + 1])
        elif hi > lo:
            one = np.full(1, hi - lo, np.uint64)
            for w in words[lo:hi]:
                one = mix64(one * np.uint64(0xD6E8FEB86659FD93) + w)
            h = one
        else:
            h = words[:0]
        out.append(h)
        where.append(where[-1] + len(h))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(where)


def registers(hashes: np.ndarray, where: np.ndarray) -> np.ndarray:
    """A row of REGISTERS register values for each set; mergeable by elementwise maximum.

    Element by element, the j-th smallest point falls in the j-th of m equally likely strata of an
    exponential distribution and goes to the j-th register of the element's permutation. Later strata only
    hold larger points, so a set is done once all its registers are filled: about n + m log m points in all.
    The register keeps floor(1 - log_b(least point)), cut to 0..q+1; an empty set has zeros.
    """
    n, m = len(where) - 1, REGISTERS
    least = np.full(n * m, _EMPTY)
    owner = np.repeat(np.arange(n), np.diff(where))
    h = hashes
    start, step = mix64(h ^ np.uint64(0x5851F42D4C957F2D)), None
    step = (start >> np.uint64(32)) | np.uint64(1)
    for j in range(m):
        if not len(h):
            break
        value = (np.uint64(j) << np.uint64(48)) | (mix64(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(16))
        reg = ((start + np.uint64(j) * step) & np.uint64(m - 1)).astype(np.int64)
        np.minimum.at(least, owner * m + reg, value)
        if j >= 1:
            going = (least.reshape(n, m) == _EMPTY).any(axis=1)[owner]
            if not going.all():
                h, owner, start, step = h[going], owner[going], start[going], step[going]
    least = least.reshape(n, m)
    u = least.astype(np.float64) / (m * 2.0**48)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = -np.log1p(-np.minimum(u, 1 - 1e-15)) / RATE
        k = np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE))
    return np.where(least == _EMPTY, 0, np.clip(k, 0, TOP + 1)).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each group of ROWS registers."""
    n = len(regs)
    parts = regs.reshape(n, REGISTERS // ROWS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, REGISTERS // ROWS + 1, dtype=np.uint64), (n, REGISTERS // ROWS)).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


_GRID = np.linspace(0.0, 1.0, 201)


def may_link(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a Jaccard similarity of ``threshold`` or more is within DOUBT of the likeliest one.

    more, less: registers where a's value is above, below b's. With u = n_a / (n_a + n_b) these have
    probabilities p(u - vJ) and p(v - uJ), p(x) = -log_b(1 - x (b - 1) / b), and the rest are equal.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    cap = np.minimum(u / v, v / u)
    out = np.zeros(len(u), bool)
    step = 20_000
    for i in range(0, len(u), step):
        s = slice(i, i + step)
        j = np.minimum(_GRID[None, :], cap[s, None])

        def p(x):
            return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

        up, down = p(u[s, None] - v[s, None] * j), p(v[s, None] - u[s, None] * j)
        same = np.maximum(1 - up - down, 1e-12)
        fit = more[s, None] * np.log(up) + less[s, None] * np.log(down) + (REGISTERS - more[s, None] - less[s, None]) * np.log(same)
        above = np.where(_GRID[None, :] >= threshold - 1e-9, fit, -np.inf).max(axis=1)
        out[s] = (above >= fit.max(axis=1) - DOUBT) & (cap[s] >= threshold - 1e-12)
    return out


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fingerprint of the set (fp1, fp2), registers and band keys, from doc_id and text.

    less: for sets of 2 to SMALL shingles, the fingerprints without each of these.
    """
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in chunks_of(texts):
                hashes, where = shingle_sets(texts[i:j])
                n = np.diff(where)
                one, two = mix64(hashes), mix64(hashes ^ np.uint64(0xA0761D6478BD642F))
                sums = np.concatenate([[np.uint64(0)], np.cumsum(one, dtype=np.uint64)])
                both = np.concatenate([[np.uint64(0)], np.cumsum(two, dtype=np.uint64)])
                fp1, fp2 = sums[where[1:]] - sums[where[:-1]], both[where[1:]] - both[where[:-1]]
                small = (n >= 2) & (n <= SMALL)
                out = np.repeat(small, n)
                less = [pa.array((np.repeat(f, n) - x)[out].view(np.int64)) for f, x in ((fp1, one), (fp2, two))]
                ends = np.concatenate([[0], np.cumsum(np.where(small, n, 0))])
                regs = registers(hashes, where)
                keys = bands(regs)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i),
                        pa.array(n, pa.int64()),
                        pa.array(fp1.view(np.int64)),
                        pa.array(fp2.view(np.int64)),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel())),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(less, names=["fp1", "fp2"])),
                    ],
                    names=["id", "n", "fp1", "fp2", "regs", "bands", "less"],
                )

    return docs.mapInArrow(frugal(run), "id long, n long, fp1 long, fp2 long, regs binary, bands array<long>, less array<struct<fp1:bigint,fp2:bigint>>")


def _estimated(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose registers leave ``threshold`` possible."""
    side = lambda s: sketches.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"r_{s}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
            n_a, n_b = (t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
            ok = may_link((ra > rb).sum(1), (ra < rb).sum(1), n_a, n_b, threshold)
            yield t.select(["a", "b"]).filter(pa.array(ok))

    return joined.mapInArrow(frugal(run), "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * shared >= percent * union on full shingle sets. Texts move, as they pack better than hashes."""
    side = lambda s: texts.select(F.col("id").alias(s), F.col("text").alias(f"t_{s}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for t in batches:
            if not t.num_rows:
                continue
            a, b = t.column("a").to_pylist(), t.column("b").to_pylist()
            ta, tb = t.column("t_a"), t.column("t_b")
            size, begin = 0, 0
            spans = []
            lengths = np.add(pc.binary_length(ta).to_numpy(zero_copy_only=False), pc.binary_length(tb).to_numpy(zero_copy_only=False))
            for i, n in enumerate(lengths):
                if i > begin and size + n > 2_000_000:
                    spans.append((begin, i))
                    begin, size = i, 0
                size += n
            if a:
                spans.append((begin, len(a)))
            for i, j in spans:
                keys = [((a[k], ta[k].as_py()), (b[k], tb[k].as_py())) for k in range(i, j)]
                stay = {y for _, y in keys}
                held = {k: v for k, v in held.items() if k in stay}
                new = list(dict.fromkeys(k for both in keys for k in both if k not in held))
                h, where = shingle_sets([t for _, t in new])
                held |= {key: h[where[x] : where[x + 1]] for x, key in enumerate(new)}
                ok = []
                for x, y in keys:
                    x, y = held[x], held[y]
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.searchsorted(y, x)
                    shared = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                    ok.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
                yield t.slice(i, j - i).select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.mapInArrow(frugal(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id reachable, for every id in the edges (a, b); alternating large and small stars.

    Each round keeps one edge for each edge at most, and takes minima that are aggregated on the map side.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = stage(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    stars = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label"))
    return stage(stars.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()), "labels")


def _grouped(rows: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """``work(table, bounds)`` on runs of whole (key, i, j) groups; a group is at most two blocks of documents."""

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if rest is not None and rest.num_rows:
                t = pa.concat_tables([rest, t]).combine_chunks()
            cut = yield from step(t, False)
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from step(rest.combine_chunks(), True)

    def step(t, last):
        if not t.num_rows:
            return 0
        key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
        edge = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        bounds = [0, *edge.tolist()] + ([len(key)] if last else [])
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            yield from work(t.slice(lo, hi - lo))
        return bounds[-1]

    return rows.select("key", "i", "j", *columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(frugal(run), schema)


def _pairs_of(t, threshold: float):
    """(y numbers, x number) of a group's possible links between labels that share no earlier band."""
    blk, n, label = (t.column(c).to_numpy() for c in ("blk", "n", "label"))
    i, j, band = (t.column(c)[0].as_py() for c in ("i", "j", "band"))
    if (label == label[0]).all():
        return
    ids = t.column("id").to_numpy()
    regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    right = np.flatnonzero(blk == j)
    for x in np.flatnonzero((blk == i) | (i == -1)):
        y = right[(label[right] != label[x]) & ((ids[right] > ids[x]) if blk[x] == j else True)]
        if not len(y):
            continue
        equal = regs[y] == regs[x]
        # with at most half of the registers equal the threshold is ruled out, whatever the sizes
        near = 2 * equal.sum(1) > REGISTERS
        y, equal = y[near], equal[near]
        first = equal.reshape(len(y), -1, ROWS).all(2).argmax(1) if len(y) else y
        y = y[first == band]
        if len(y):
            a, b = regs[y], regs[x]
            y = y[may_link((a > b).sum(1), (a < b).sum(1), n[y].astype(float), np.full(len(y), float(n[x])), threshold)]
            if len(y):
                yield y, x


def _dealt(members: DataFrame) -> DataFrame:
    """Members of each bucket in groups (key, i, j) in which every two of different labels meet once.

    members: key, band, size, id, label, most (the label with most members), n_most. The members of that label
    need not meet each other, so their blocks -1, -2, ... only meet the blocks 0, 1, ... of the rest. Within
    block j the rest meets in group (-1, j). A member goes to as many groups as the other side has blocks, which
    is one where the rest fits a block.
    """
    major = F.col("label") == F.col("most")
    at = members.withColumn("many", F.ceil(F.col("n_most") / BLOCK).cast("int")).withColumn("few", F.ceil((F.col("size") - F.col("n_most")) / BLOCK).cast("int"))
    hashed = F.xxhash64("id")
    at = at.withColumn("blk", F.when(major, -1 - F.pmod(hashed, F.col("many"))).otherwise(F.pmod(hashed, F.col("few"))).cast("int"))
    others = F.when(major, F.sequence(F.lit(0), F.col("few") - 1)).otherwise(F.sequence(-F.col("many"), F.col("few") - 1))
    at = at.select("key", "band", "id", "label", "blk", F.explode(others).alias("other")).where("blk <> other")
    return at.select("key", "band", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "id", "label")


def _cross_links(members: DataFrame, sketches: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links within each bucket between members that no path of links joins yet.

    members: as in ``_dealt``, whose groups are one task's work at a time, so no task holds a large bucket. A first
    pass over the registers finds who has a possible link at all; only their texts go to the same groups, where
    each possible link is verified on the full sets unless links found before it in the group imply it. Pairs
    never leave a group.
    """
    threshold = percent / 100
    columns = ["band", "blk", "id", "label", "n", "regs"]

    def possible(t):
        some = set()
        for y, x in _pairs_of(t, threshold):
            some.add(int(x))
            some.update(y.tolist())
        if some:
            yield t.take(pa.array(sorted(some))).select(["key", "i", "j", *columns]).combine_chunks().to_batches()[0]

    dealt = _dealt(members).join(sketches.select("id", "n", "regs"), "id")
    open_ = stage(_grouped(dealt, columns, possible, "key long, i int, j int, band int, blk int, id long, label long, n long, regs binary"), "possible")

    def verified(t):
        h, where = shingle_sets(t.column("text").to_pylist())
        ids = t.column("id").to_pylist()
        head = {}

        def find(v):
            while head.get(v, v) != v:
                v = head[v]
            return v

        label, found = t.column("label").to_pylist(), []
        for ys, x in _pairs_of(t, threshold):
            for y in ys.tolist():
                p, q = find(label[x]), find(label[y])
                if p != q:
                    u, v = h[where[x] : where[x + 1]], h[where[y] : where[y + 1]]
                    if len(u) > len(v):
                        u, v = v, u
                    shared = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
                    if 100 * shared >= percent * (len(u) + len(v) - shared):
                        head[max(p, q)] = min(p, q)
                        found.append((ids[x], ids[y]))
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _grouped(open_.join(texts, "id"), [*columns, "text"], verified, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Two documents are linked if their shingle sets have 100 * intersection >= percent * union; a component
    is what links join, named by its smallest id, which alone is kept. Documents without words are linked with
    nothing. Rows of one id are one document, so their components are one. Rows with a null id
    are linked with nothing, have a null component and are kept. Empty input gives empty output.

    Equal sets collapse to their smallest id first, so copies cost a row. In each bucket all members are
    compared with its smallest member; sets of up to SMALL shingles also with those of one shingle less. Only buckets whose members then lie in several components go
    on to comparisons of the others, in blocks. Sketches, estimates, verification and components are
    tables in the shared folder. Nothing of the corpus reaches the driver.
    """
    threshold = percent / 100
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    all_rows = stage(_sketches(texts), "sketches")
    some = all_rows.where(F.col("id").isNotNull() & (F.col("n") > 0))
    reps = stage(some.groupBy("fp1", "fp2").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "representatives")
    sketches = stage(
        some.join(reps.select("fp1", "fp2", F.col("id").alias("rep")), ["fp1", "fp2"]).where("id = rep").select("id", "n", "regs", "bands", "less", "fp1", "fp2").dropDuplicates(["id", "fp1", "fp2"]),
        "distinct_sets",
    )
    # an id whose rows hold different sets is linked by any of them
    rows = sketches.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = stage(rows.groupBy("key").agg(F.min("id").alias("center"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = stage(rows.join(buckets, "key"), "members")
    pairs = members.where("id <> center").select(F.col("id").alias("a"), F.col("center").alias("b")).distinct()
    own_sets = some.groupBy("id", "fp1", "fp2").count().groupBy("id").count().where("count > 1").select("id")
    same_id = (
        some.join(own_sets, "id", "left_semi").select("id", "fp1", "fp2").join(reps.select("fp1", "fp2", F.col("id").alias("rep")), ["fp1", "fp2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    )
    present = texts.where(F.col("id").isNotNull())
    less = sketches.where(F.size("less") > 0).select(F.col("id").alias("a"), F.explode("less").alias("l")).select("a", F.col("l.fp1").alias("fp1"), F.col("l.fp2").alias("fp2"))
    tiny = less.join(sketches.where(F.col("n") < SMALL).select("fp1", "fp2", F.col("id").alias("b")), ["fp1", "fp2"]).where("a <> b").select("a", "b")
    near = _estimated(pairs, sketches, threshold).unionByName(tiny).distinct()
    links = stage(_verified(near, present, percent).unionByName(same_id), "links")
    labels = components(links)

    labelled = members.where("size > 2").join(labels, "id", "left").select("key", "band", "size", "id", F.coalesce("label", "id").alias("label"))
    classes = labelled.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label")).alias("top"), F.count("*").alias("labels"))
    split = classes.where("labels > 1").select("key", F.col("top.label").alias("most"), F.col("top.count").alias("n_most"))
    open_ = stage(labelled.join(split, "key"), "open_buckets")
    new = stage(_cross_links(open_, sketches, present, percent), "more_links")
    if not new.isEmpty():
        labels = components(links.unionByName(new))

    named = reps.join(labels, "id", "left").where((F.col("copies") > 1) | F.col("label").isNotNull())
    named = stage(named.select("fp1", "fp2", F.coalesce("label", "id").alias("label")), "named")
    out = all_rows.select("id", "n", "fp1", "fp2").join(named, ["fp1", "fp2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("label", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
