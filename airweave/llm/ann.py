"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors go through pseudo-rotations (three rounds of random signs and a fast
Hadamard transform) and fall to their nearest signed axis. Several such tables
are probed axis by axis, nearest first, and every candidate found is reranked
exactly on the original vectors.

Work is laid out as *packed blocks*: each input partition groups its own vectors
by (table, bucket) and emits them as matrices of bounded size, so no bucket is
ever gathered anywhere and a hot bucket is just more rows of an equi-join that
Spark can split. Identical vectors are one class that keeps its ``k + 1``
smallest ids, which is all that any answer can use.

Defined cases: vectors that are null, zero, of another dimension, or hold null
or non-finite components take no part; a repeated id never answers itself and
is listed once; ties go to the smaller id; a query with fewer candidates returns
all of those found; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airweave.llm.common import mapped, stored

#: Rows of one packed block, rows a worker gathers before it packs, and candidates it holds back before it passes them on.
BLOCK, CHUNK, HELD = 512, 32768, 4_000_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform along the last axis (a power of two), orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """``tables`` hash functions, each of ``hashes`` pseudo-rotations, over vectors of ``dim``.

    ``top`` is the largest norm if norms differ; inner products are then turned
    into angles by a further coordinate that brings every vector to that norm.
    """

    def __init__(self, dim: int, tables: int, hashes: int, seed: int, top: float | None = None):
        self.dim, self.tables, self.hashes, self.top = dim, tables, hashes, top
        self.width = 1 << max(1, int(np.ceil(np.log2(dim + (top is not None)))))
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, self.width))
        self.buckets = (2 * self.width) ** hashes

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        out[:, : self.dim] = x
        norm = np.sqrt((x * x).sum(1))
        if self.top is None or query:
            return out / np.maximum(norm, 1e-300)[:, None]
        out[:, self.dim] = np.sqrt(np.maximum(self.top**2 - norm**2, 0))
        return out / self.top

    def rotated(self, unit: np.ndarray, table: int, i: int) -> np.ndarray:
        for s in self.signs[table, i]:
            unit = hadamard(unit * s)
        return unit

    def axes(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Bucket of each row: its nearest signed axis under each rotation, as one number."""
        out = np.zeros(len(unit), np.int64)
        for i in range(self.hashes):
            r = self.rotated(unit, table, i)
            a = np.abs(r).argmax(1)
            out = out * 2 * self.width + 2 * a + (r[np.arange(len(r)), a] < 0)
        return out

    def ranked(self, unit: np.ndarray, table: int) -> np.ndarray:
        """All buckets of each row, nearest first."""
        score = np.zeros((len(unit), 1))
        for i in range(self.hashes):
            r = self.rotated(unit, table, i)
            both = np.stack((r, -r), 2).reshape(len(r), -1)
            score = (score[:, :, None] + both[:, None, :]).reshape(len(r), -1)
        return np.argsort(-score, axis=1, kind="stable")


def _matrix(col) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False)).reshape(len(col), -1)


def _best(qid, vid, score, k):
    """The ``k`` nearest rows of each query, each id once."""
    if not len(qid):
        return qid, vid, score
    order = np.lexsort((vid, -score, qid))
    qid, vid, score = qid[order], vid[order], score[order]
    new = np.r_[True, (qid[1:] != qid[:-1]) | (vid[1:] != vid[:-1]) | (score[1:] != score[:-1])]
    qid, vid, score = qid[new], vid[new], score[new]
    first = np.r_[True, qid[1:] != qid[:-1]]
    rank = np.arange(len(qid)) - np.maximum.accumulate(np.where(first, np.arange(len(qid)), 0))
    keep = rank < k
    return qid[keep], vid[keep], score[keep]


def _block_top(q, qids, x, ids, ends, k):
    """Exact candidates of the queries ``q`` among the classes ``x``: the ``k`` nearest ids of each query, ties to the smaller.

    Classes as near as the k-th are all compared. Of these the ``k + 1`` nearest, by
    score and smallest id, hold the answer: an id among the first ``k`` lies in a
    class whose smallest id is no larger, and one class may be the query's own.
    """
    q, x = q.astype(np.float64), x.astype(np.float64)
    rough = q @ x.T
    m = min(len(x), k + 1)
    least = np.partition(rough, len(x) - m, axis=1)[:, len(x) - m]
    # rounding of a sum of products, many times over
    slack = 1e-12 * np.sqrt((q * q).sum(1) * (x * x).sum(1).max(initial=0.0))
    rows, cols = np.nonzero(rough >= (least - slack)[:, None])
    score = (q[rows] * x[cols]).sum(1)  # row by row: equal vectors, equal scores
    starts = np.r_[0, ends[:-1]]
    order = np.lexsort((ids[starts[cols]], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    first = np.r_[True, rows[1:] != rows[:-1]]
    keep = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0)) < m
    rows, cols, score = rows[keep], cols[keep], score[keep]
    n = ends[cols] - starts[cols]
    at = np.repeat(starts[cols] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    qid, vid, score = np.repeat(qids[rows], n), ids[at], np.repeat(score, n)
    other = qid != vid
    return _best(qid[other], vid[other], score[other], k)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part, whatever else the table holds."""
    given = df.schema[vec_col].dataType.elementType.simpleString()
    v = F.col(vec_col).cast("array<float>" if given == "float" else "array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def nearest(df: DataFrame, query_ids, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = 4, hashes: int = 1, recall: float = 0.96, sample: int = 128, seed: int = 7) -> DataFrame:
    """The ``k`` largest inner products of each query row among all other rows.

    ``query_ids``: a condition on the id column that names the queries. ``sample``
    bounds the queries whose exact answers tell how many axes to probe for
    ``recall``; every row is indexed. ``hashes`` rotations name a bucket together:
    a second one makes as many buckets as the square. Scores are sums of products
    in double precision, of float or double vectors as they are given. Returns
    query_id, rank, vec_id, score.
    """
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(df, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["n"]
    rows = rows.where(F.size("v") == dim)
    first = Window.partitionBy("v").orderBy("id")
    classes = stored(rows.distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, low, high = classes.agg(F.count("*"), F.min(norm), F.max(norm)).collect()[0]
    index = CrossPolytope(dim, tables, hashes, seed, None if low >= high * 0.999 else high)
    kind = np.float32 if rows.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
    queries = rows.where(query_ids(F.col("id"))).distinct()
    asked = queries.orderBy(F.xxhash64("id"), "id", "v").limit(sample).collect()
    if not asked:
        return spark.createDataFrame([], schema)
    probes = _fit_probes(classes, index, np.array([r["v"] for r in asked], kind), np.array([r["id"] for r in asked]), k, recall)

    def pack(batch, query: bool):
        v = _matrix(batch.column(0))
        ids = batch.column(1)
        chunk = max(64, min(CHUNK, (1 << 22) // index.buckets)) if query else CHUNK  # a query ranks all buckets
        for lo in range(0, len(v), chunk):
            x = v[lo : lo + chunk]
            unit = index.unit(x.astype(np.float64), query)
            if query:
                flat, count = ids.to_numpy()[lo : lo + chunk], np.ones(len(x), np.int64)
            else:
                own = ids.slice(lo, chunk)
                flat, count = own.flatten().to_numpy(), own.value_lengths().to_numpy().astype(np.int64)
            end = np.cumsum(count)
            for t in range(index.tables):
                if query:
                    bucket = index.ranked(unit, t)[:, :probes].ravel()
                    row = np.repeat(np.arange(len(x)), bucket.size // len(x))
                else:
                    bucket, row = index.axes(unit, t), np.arange(len(x))
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                for part in np.split(order, cuts):
                    for at in range(0, len(part), BLOCK):
                        some = part[at : at + BLOCK]
                        r = row[some]
                        held = np.concatenate([flat[e - c : e] for e, c in zip(end[r], count[r], strict=True)])
                        yield {"t": [t], "b": [int(bucket[some[0]])], "vecs": [x[r].astype(kind).tobytes()], "ids": [held.astype(np.int64).tobytes()], "ends": [np.cumsum(count[r]).tobytes()]}

    shape = "t int, b long, vecs binary, ids binary, ends binary"
    # few partitions, so that blocks are full: their pairs number as the product of both sides' partitions
    parts = lambda rows: max(-(-rows // CHUNK), min(8, -(-rows // 4096)), 1)
    left = mapped(queries.select("v", "id").coalesce(parts(queries.count())), lambda b: pack(b, True), shape, CHUNK).select("t", "b", F.col("vecs").alias("q"), F.col("ids").alias("qids"))
    right = mapped(classes.select("v", "ids").coalesce(parts(n)), lambda b: pack(b, False), shape, CHUNK)
    pairs = left.join(right.hint("merge"), ["t", "b"])

    def search(batches):
        import pyarrow as pa

        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        kept = [none]

        def rows(found):
            for lo in range(0, len(found[0]), 1 << 16):
                yield pa.RecordBatch.from_pydict({n: x[lo : lo + (1 << 16)] for n, x in zip(("query_id", "vec_id", "score"), found, strict=True)})

        for batch in batches:
            for q, qids, x, ids, ends in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                kept.append(_block_top(np.frombuffer(q, kind).reshape(-1, dim), np.frombuffer(qids, np.int64), np.frombuffer(x, kind).reshape(-1, dim), np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64), k))
                if sum(len(a[0]) for a in kept[1:]) > max(1_000_000, 2 * len(kept[0][0])):
                    kept = [_best(*map(np.concatenate, zip(*kept, strict=True)), k)]
                    if len(kept[0][0]) > HELD:
                        yield from rows(kept[0])
                        kept = [none]
        yield from rows(_best(*map(np.concatenate, zip(*kept, strict=True)), k))

    found = pairs.select("q", "qids", "vecs", "ids", "ends").mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _fit_probes(classes: DataFrame, index: CrossPolytope, q: np.ndarray, qids: np.ndarray, k: int, recall: float) -> int:
    """Axes to probe in each table so that ``recall`` of the sample's exact neighbours are met."""
    unit = index.unit(q.astype(np.float64), True)
    place = np.empty((index.tables, len(q), index.buckets), np.int32)
    for t in range(index.tables):
        np.put_along_axis(place[t], index.ranked(unit, t), np.arange(index.buckets, dtype=np.int32)[None], 1)

    def exact(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _matrix(batch.column(0)), batch.column(1)
            out = []
            for lo in range(0, len(x), CHUNK):
                part, ids = x[lo : lo + CHUNK], own.slice(lo, CHUNK)
                ends = np.cumsum(ids.value_lengths().to_numpy()).astype(np.int64)
                flat = ids.flatten().to_numpy()
                qid, vid, score = _block_top(q, np.arange(len(q)) - (1 << 62), part, flat, ends, k + 1)
                keep = vid != qids[qid + (1 << 62)]
                qi, vid, score = qid[keep] + (1 << 62), vid[keep], score[keep]
                owner = np.searchsorted(ends, np.argsort(flat, kind="stable")[np.searchsorted(np.sort(flat, kind="stable"), vid)], side="right")
                u = index.unit(part.astype(np.float64), False)
                met = np.min([place[t][qi, index.axes(u, t)[owner]] for t in range(index.tables)], axis=0)
                out.append((qi, vid, score, met))
            qi, vid, score, met = map(np.concatenate, zip(*out, strict=True))
            yield pa.RecordBatch.from_pydict({"qi": qi, "vid": vid, "score": score, "met": met.astype(np.int64)})

    near = classes.select("v", "ids").mapInArrow(exact, "qi long, vid long, score double, met long")
    order = Window.partitionBy("qi").orderBy(F.desc("score"), "vid")
    counts = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("met").count().orderBy("met").collect()
    total, seen = sum(r["count"] for r in counts), 0
    for r in counts:
        seen += r["count"]
        if seen >= recall * total:
            return int(r["met"]) + 1
    return index.buckets
