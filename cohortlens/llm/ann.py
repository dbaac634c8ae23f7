"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import frugal, ship, stage

TABLES = 4
PROBES = 24  # nearest signed axes that a query looks under, of twice the padded dimensions
BLOCK = 4096  # vectors of a bucket that one group of queries is compared with at a time
SEED = 20_24


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform; columns padded to a power of two."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(3):
        y = y * rng.choice([-1.0, 1.0], d)
        h = 1
        while h < d:
            z = y.reshape(len(y), d // (2 * h), 2, h)
            y = np.concatenate([z[:, :, :1] + z[:, :, 1:], z[:, :, :1] - z[:, :, 1:]], axis=2).reshape(len(y), d)
            h *= 2
        y /= np.sqrt(d)
    return y


def nearest_axes(x: np.ndarray, seed: int, probes: int) -> np.ndarray:
    """The signed axes (2 * axis + sign) nearest to each rotated vector, nearest first."""
    y = rotate(x, seed)
    signed = np.concatenate([y, -y], axis=1)
    d = y.shape[1]
    top = np.argsort(-signed, axis=1, kind="stable")[:, : min(probes, 2 * d)]
    return np.where(top < d, 2 * top, 2 * (top - d) + 1)


def nearest(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = TABLES, probes: int = PROBES, every: int = 50,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest by cosine, of all other rows.

    Queries are the rows of ``queries`` (same columns), or those of ``vectors`` whose id is divisible by ``every``. Every
    vector is indexed under its nearest signed axis in each of ``tables`` rotations; a query looks
    under its ``probes`` nearest axes in each and reranks all it finds by the exact cosine of the original
    vectors in double precision, ties to the smaller id. Vectors that are null, zero or hold null or
    non-finite components, null ids, and vectors of another length than the query's take no part; rows of
    one id and vector are one. A query that finds fewer than ``k`` this way is compared with all rows of its length.
    Fewer than ``k`` candidates give fewer rows; empty input none.

    Equal vectors go into the index as their k + 1 smallest ids (no query can need more of them), by a
    limit that Spark applies before the shuffle. A bucket larger than BLOCK is cut into blocks, each with its
    own copy of the bucket's queries, and a block sends on k rows for each query.
    """
    ship(vectors.sparkSession)

    def valid(df):
        v = F.col(vector_col).cast("array<double>")
        size = F.aggregate(v, F.lit(0.0), lambda a, b: a + b * b)
        ok = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & size.isNotNull() & ~F.isnan(size) & (size > 0) & (size < F.lit(float("inf")))
        return df.where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    base = valid(vectors)
    asked = valid(vectors.where(F.col(id_col) % every == 0) if queries is None else queries).distinct()
    window = Window.partitionBy("v").orderBy("id")
    kept = base.distinct().withColumn("r", F.row_number().over(window)).where(F.col("r") <= k + 1).drop("r")

    def hashed(wide: bool):
        def run(batches):
            for b in batches:
                ids = b.column("id").to_numpy()
                size = np.diff(b.column("v").offsets.to_numpy())
                flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
                first = np.r_[0, np.cumsum(size)]
                for d in np.unique(size):
                    at = np.flatnonzero(size == d)
                    x = flat[first[at][:, None] + np.arange(d)]
                    unit = x / np.sqrt((x * x).sum(1))[:, None]
                    raw = pa.array([r.tobytes() for r in x], pa.binary())
                    for t in range(tables):
                        axes = nearest_axes(unit, SEED + t, probes if wide else 1)
                        n = axes.shape[1]
                        key = (np.int64(d) << 32) + t * (1 << 24) + axes
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key.ravel(), pa.int64()), pa.array(np.repeat(ids[at], n), pa.int64()), raw.take(pa.array(np.repeat(np.arange(len(at)), n)))], names=["key", "id", "raw"]
                        )

        return run

    def whole(batches):
        for b in batches:
            v = b.column("v").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in v], pa.int64()), b.column("id"), pa.array([np.array(x, float).tobytes() for x in v], pa.binary())], names=["key", "id", "raw"])

    shape = "key long, id long, raw binary"
    index = stage(kept.mapInArrow(frugal(hashed(False)), shape), "ann_index")
    sizes = stage(index.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "ann_sizes")

    def dealt(indexed, wanted, sizes):
        """Index rows in blocks of their bucket, and the queries of the bucket with each of these."""
        rows = indexed.join(sizes, "key").select("key", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind"), "id", "raw")
        return rows, wanted.join(sizes, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "id", "raw")

    rows, probes_ = dealt(index, asked.mapInArrow(frugal(hashed(True)), shape), sizes)

    def best(q, qid, x, xid):
        """The k best of x for each q; exact cosines."""
        score = q @ x.T / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None, :]
        score[qid[:, None] == xid[None, :]] = -np.inf
        for i in range(len(q)):
            s = score[i]
            m = min(k, len(s))
            cut = np.partition(s, len(s) - m)[len(s) - m]
            near = np.flatnonzero((s >= cut) & (s > -np.inf))
            near = near[np.lexsort((xid[near], -s[near]))][:k]
            yield qid[i], xid[near], s[near]

    def compare(batches):
        rest = None

        def done(t):
            key, block, kind, ids = (t.column(c).to_numpy() for c in ("key", "block", "kind", "id"))
            raw = t.column("raw").to_pylist()
            edge = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1, len(key)]
            out = ([], [], [])
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                mid = lo + int((kind[lo:hi] == 0).sum())
                if lo < mid < hi:
                    x = np.frombuffer(b"".join(raw[mid:hi])).reshape(hi - mid, -1)
                    for a in range(lo, mid, 1024):
                        z = min(mid, a + 1024)
                        q = np.frombuffer(b"".join(raw[a:z])).reshape(z - a, -1)
                        for qid, near, s in best(q, ids[a:z], x, ids[mid:hi]):
                            out[0].append(np.full(len(near), qid))
                            out[1].append(near)
                            out[2].append(s)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])

        for b in batches:
            t = pa.Table.from_batches([b])
            if rest is not None and rest.num_rows:
                t = pa.concat_tables([rest, t])
            key, block = t.column("key").to_numpy(), t.column("block").to_numpy()
            edge = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            cut = int(edge[-1]) if len(edge) else 0
            if cut:
                yield from done(t.slice(0, cut).combine_chunks())
            rest = t.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from done(rest)

    shape_found = "query_id long, vec_id long, score double"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def reranked(indexed, wanted):
        both = indexed.unionByName(wanted).repartition("key", "block").sortWithinPartitions("key", "block", "kind")
        return both.mapInArrow(frugal(compare), shape_found)

    def ranked(found):
        one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    # Queries that found fewer than k: all rows of their length, which the index holds once in its first table.
    top = stage(ranked(reranked(rows, probes_)), "ann_found")
    enough = top.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = stage(asked.join(enough, "id", "left_anti").mapInArrow(frugal(whole), shape), "ann_short")
    once = index.where(F.shiftright("key", 24).bitwiseAND(255) == 0).withColumn("key", F.shiftright("key", 32))
    sizes = stage(once.join(short.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "ann_short_sizes")
    rest = reranked(*dealt(once, short, sizes))
    return ranked(top.select("query_id", "vec_id", "score").unionByName(rest))
