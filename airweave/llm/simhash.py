"""Near-duplicates by SimHash fingerprints.

A fingerprint has a bit set where over half of a text's shingle hashes have it.
Two fingerprints that differ in at most ``bits`` = 2 bits share at least 6 of
their 8 positional bytes. The inverted index lists fingerprints under
(positions, byte values). Lists of single bytes would hold 1/256 of everything
and their pairs grow as the square, so an entry has four positions, one of the 14
quadruples of ``QUADS``: any three positions lie in exactly one of them, so of two
fingerprints that share 6 bytes exactly 3 entries agree, of more shared bytes 7 or
all, of fewer at most one. The entries in which a pair meets are tallied, pairs
that reach the guaranteed 3 are kept and verified bit by bit.

A list with more than ``LIST`` fingerprints is not paired: its fingerprints are
listed under every value one bit away instead. Two fingerprints differ in at
most 2 bits exactly if they have such a value in common, no value has more than
65 of them, and all of these link. So hot lists cost 65 rows a fingerprint, and
a pair that has a hot list in common needs no tally.

:func:`one_of_each` also drops texts that are merely similar. At a Jaccard
similarity of 0.8 about 10 of 64 SimHash bits differ, so no byte need be shared
and no minimum is guaranteed; there the same index and tally run over the bytes
of a minwise sketch, each of which is shared with just that probability, and
what they find is judged on the texts' whole shingle sets.

Components come in rounds, each a written table: links are held in as few
partitions as have ``FOREST`` links each, and each partition reduces its own to a
spanning forest. Once one partition holds all that is left, that forest is the
answer; until then large-star and small-star steps bring links together.

Defined cases: null text has no words and fingerprint zero, linked like any
other; texts under three words have one shingle, the whole sequence; repeated
rows share their component; an id of null is carried and never names a
component unless all of it are null (:func:`one_of_each` tells rows apart by id and text); extra columns are ignored by
:func:`components` and kept by :func:`one_of_each`.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airweave.llm.common import digest, discard, mapped, split_join, stored, texts_of

#: Distinct fingerprints of a list that are still paired.
LIST = 32
#: Quadruples of the 8 byte positions, of which any three positions lie in exactly one, and how many agree in 6 shared positions.
QUADS, AGREE = [q for q in combinations(range(8), 4) if not q[0] ^ q[1] ^ q[2] ^ q[3]], 3
#: Members of a block of a longer list of sketches.
BLOCK = 256
#: Positional bytes of a sketch and of one entry of its index, and the factors that order shingles.
SKETCH, RUN = 130, 5
_ODD = np.random.default_rng(1).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: How much less than the similarity asked for two sketches may share: four standard deviations at 0.8.
SLACK = 0.14
#: Members and shingles of a block whose pairs are judged together.
TILE, TILE_SHINGLES = 400, 2_000_000
#: Links that a partition reduces at a time.
FOREST = 500_000


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of a text's shingles of ``width`` words, by XXH64 with seed 42."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(words) - width + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts[:n].tolist(), ends[width - 1 :].tolist())), repeat(42)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, 4080):  # few enough for sums of 16 bits
        part = np.unpackbits(h[lo : lo + 4080].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += part.sum(0, dtype=np.uint16)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch):
        fps = np.array([fingerprint(t, width) for t in texts_of(batch)], np.uint64).view(np.int64)
        yield {"doc_id": batch.column(0), "fp": fps}

    return mapped(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(u, v), u > v: links between distinct fingerprints ``fps`` (fp) that connect all that differ in at most 2 bits."""
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(0xFF)
    keys = [F.struct(F.lit(k).alias("kind"), sum(byte(i) * (1 << 8 * j) for j, i in enumerate(q)).alias("value")) for k, q in enumerate(QUADS)]
    index = fps.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.kind", "x.value")
    sizes = index.groupBy("kind", "value").agg(F.count("*").alias("n")).where("n > 1")
    index = stored(split_join(index, sizes, ["kind", "value"]), "lists")
    small = index.where(F.col("n") <= LIST)
    both = small.alias("a").join(small.alias("b").hint("merge"), (F.col("a.kind") == F.col("b.kind")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.fp") > F.col("b.fp")))
    tally = both.groupBy(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).agg(F.count("*").alias("n")).where(F.col("n") >= AGREE)
    near = tally.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2).select("u", "v")
    ball = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)])
    hot = index.where(F.col("n") > LIST).select("fp").distinct()
    spread = hot.select("fp", F.explode(F.transform(ball, lambda x: x.bitwiseXOR(F.col("fp")))).alias("mid"))
    met = spread.groupBy("mid").agg(F.collect_list("fp").alias("of"), F.array_min(F.collect_list("fp")).alias("v")).where(F.size("of") > 1)
    star = met.select(F.explode("of").alias("u"), "v").where("u > v").distinct()
    return near.unionByName(star)


def _spanning(links: np.ndarray) -> np.ndarray:
    """(vertex, smallest of its component) for each vertex of ``links`` (two columns) but the smallest ones."""
    names, ends = np.unique(links, return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    top = np.arange(len(names))
    while True:
        x, y = top[a], top[b]
        least, then = np.minimum(x, y), top.copy()
        np.minimum.at(then, x, least)
        np.minimum.at(then, y, least)
        while (then[then] != then).any():
            then = then[then]
        if (then == top).all():
            break
        top = then
    below = np.flatnonzero(top != np.arange(len(top)))
    return np.stack((names[below], names[top[below]]), axis=1)


def _forest(df: DataFrame) -> DataFrame:
    """Fewer links with the same components, partition by partition; stars, if a partition has no more than ``FOREST``."""

    def run(batches):
        held, n = [], 0
        out = lambda x: pa.RecordBatch.from_pydict({"u": x[:, 0], "v": x[:, 1]})
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1))
            n += batch.num_rows
            if n > 2 * FOREST:
                held = [_spanning(np.concatenate(held))]
                n = len(held[0])
                if n > FOREST:
                    yield out(held.pop())
                    n = 0
        if n:
            yield out(_spanning(np.concatenate(held)))

    return df.mapInArrow(run, "u long, v long")


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): each vertex u that has a smaller one in its component, with the component's smallest, v."""
    now = stored(_forest(edges.select("u", "v")), "links")
    mark = None
    while True:
        parts = max(1, -(-now.count() // FOREST))
        forest = _forest(now.coalesce(parts))
        if parts == 1:
            then = stored(forest, "links")
            discard(now)
            return then
        both = forest.unionByName(forest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = split_join(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(down, low, ["u"])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        then = stored(small, "links")
        seen = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        discard(now)
        now = then
        if tuple(seen) == mark:
            return now
        mark = tuple(seen)


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of fingerprints."""
    return _components(stored(fingerprints(df, id_col, text_col, width), "fingerprints"))


def _components(fps: DataFrame) -> DataFrame:
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = _named(classes, stars(links(classes.select("fp"))), "fp")
    return split_join(fps, named, ["fp"]).select("doc_id", "fp", "component_id")


def _tops(classes: DataFrame, near: DataFrame, key: str) -> DataFrame:
    """``classes`` (key, least) with the smallest key of each one's component, ``top``, by their stars (u, v)."""
    return classes.join(near.select(F.col("u").alias(key), F.col("v").alias("top")).hint("merge"), key, "left").withColumn("top", F.coalesce("top", key))


def _named(classes: DataFrame, near: DataFrame, key: str) -> DataFrame:
    """(key, component_id) of classes (key, least) and their stars (u, v)."""
    named = _tops(classes, near, key)
    tops = named.groupBy("top").agg(F.min("least").alias("component_id"))
    return split_join(named, tops, ["top"]).select(key, "component_id")


def _firsts(classes: DataFrame, near: DataFrame, key: str) -> DataFrame:
    """The fields of the struct ``least`` that is the smallest in each component of classes (key, least)."""
    return _tops(classes, near, key).groupBy("top").agg(F.min("least").alias("least")).select("least.*")


# Similar texts: the same index over bytes of a minwise sketch


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Hash of each shingle of ``width`` words, in order; one for the whole of a shorter text, none without words."""
    words = text.lower().split()
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(min(1, len(w)), len(w) - width + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(width, len(w))):
        h = (h ^ w[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def sketch(text: bytes, width: int = 5) -> bytes:
    """``SKETCH`` positional bytes; two texts agree in each with the probability of their shingles' Jaccard similarity."""
    return _sketch(shingles(text, width))


def _sketch(h: np.ndarray) -> bytes:
    if not len(h):
        return bytes(SKETCH)
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(h), 2048):
        least = np.minimum(least, (h[None, lo : lo + 2048] * _ODD[:, None]).min(1))
    return ((least * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(56)).astype(np.uint8).tobytes()


def candidates(classes: DataFrame, share: float) -> DataFrame:
    """(u, v), u > v: pairs of sketches (id, sk) that share ``share`` of their bytes.

    Entries of the index are ``SKETCH // RUN`` runs of bytes. All pairs of a list
    are compared: those of at most ``LIST`` as joined rows, longer ones dealt in
    blocks by :func:`_blocks`. A pair of several long lists is kept by the first
    of its runs only.
    """
    runs = SKETCH // RUN
    entries = F.array(*[F.struct(F.lit(i).alias("kind"), F.substring("sk", i * RUN + 1, RUN).alias("value")) for i in range(runs)])
    index = classes.select("id", F.explode(entries).alias("x")).select("id", "x.kind", "x.value")
    sizes = index.groupBy("kind", "value").agg(F.count("*").alias("n")).where("n > 1")
    index = stored(split_join(index, sizes, ["kind", "value"]), "lists")
    small = index.where(F.col("n") <= LIST)
    other = small.withColumnRenamed("id", "v").drop("n")
    pairs = small.withColumnRenamed("id", "u").join(other.hint("merge"), ["kind", "value"]).where("u > v").select("u", "v").distinct()
    both = split_join(pairs, classes.select(F.col("id").alias("u"), F.col("sk").alias("a")), ["u"])
    both = split_join(both, classes.select(F.col("id").alias("v"), F.col("sk").alias("b")), ["v"])
    least = int(np.ceil(share * SKETCH))

    def tally(batch: pa.RecordBatch):
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (2, 3))
        keep = (x == y).sum(1) >= least
        yield batch.select(["u", "v"]).filter(pa.array(keep))

    near = mapped(both.select("u", "v", "a", "b"), tally, "u long, v long")
    return near.unionByName(_blocks(split_join(index.where(F.col("n") > LIST), classes.select("id", "sk"), ["id"]), least))


def _blocks(hot: DataFrame, least: int) -> DataFrame:
    """(u, v), u > v: pairs of long lists ``hot`` (id, sk, kind, value, n) that share ``least`` bytes, and no earlier run.

    A list's members are salted into blocks of about ``BLOCK``; each pair of
    blocks, and each block with itself, is one group.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = hot.withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("id", "sk", "kind", "value", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        kind, i, j = (table[c][0].as_py() for c in ("kind", "i", "j"))
        ids, own = table["id"].to_numpy(), table["own"].to_numpy()
        sk = np.frombuffer(b"".join(table["sk"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        right = np.flatnonzero(own == j)
        for k, at in enumerate(np.flatnonzero(own == i).tolist()):
            rest = right[k + 1 :] if i == j else right
            same = sk[rest] == sk[at]
            near = same.sum(1) >= least
            first = same[near].reshape(-1, SKETCH // RUN, RUN).all(2).argmax(1)
            vs.append(ids[rest[near][first == kind]])
            us.append(np.full(len(vs[-1]), ids[at]))
        u, v = np.concatenate(us), np.concatenate(vs)
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    return dealt.groupBy("kind", "value", "i", "j").applyInArrow(compare, "u long, v long")


def similar_links(classes: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: float = 0.8) -> DataFrame:
    """(u, v), u > v: links of classes (id, sk, size) that connect all candidates whose shingles have a Jaccard similarity of ``similarity`` or more.

    ``texts`` gives (id, text) of a frame of ids, ``size`` is a text's number of shingles. Sketches
    only pick the candidates, with ``SLACK`` less than ``similarity``. These are
    judged on whole shingle sets, in tiles: the members of a group that candidates
    connect are salted into blocks, so that a set travels once for each block of
    its own group, and once in all if the group has one.
    """
    pairs = stored(candidates(classes.select("id", "sk"), similarity - SLACK).distinct(), "candidates")
    tops = stars(pairs)
    tops = stored(tops.unionByName(tops.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("id"), F.col("v").alias("top")), "groups")
    member = tops.join(classes.select("id", "size").hint("merge"), "id")
    blocks = F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / TILE_SHINGLES)).cast("int").alias("n")
    member = split_join(member.drop("size"), member.groupBy("top").agg(blocks), ["top"])
    member = stored(member.withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("n")).cast("int")), "members")
    sets = mapped(
        texts(tops.select("id")),
        lambda batch: [{"id": batch.column(0), "set": [np.unique(shingles(t)).tobytes() for t in texts_of(batch)]}],
        "id long, set binary",
    )
    end = lambda c: member.select(F.col("id").alias(c), F.col("own").alias(f"{c}_own"))
    tiled = split_join(split_join(pairs, member.select(F.col("id").alias("u"), "top", F.col("own").alias("u_own")), ["u"]), end("v"), ["v"])
    tiled = stored(tiled.select("top", F.least("u_own", "v_own").alias("i"), F.greatest("u_own", "v_own").alias("j"), "u", "v"), "tiles")
    needed = tiled.select("top", "i", "j", F.explode(F.array("u", "v")).alias("id")).distinct()
    needed = split_join(needed, sets, ["id"]).select(F.col("top").alias("in_top"), F.col("i").alias("in_i"), F.col("j").alias("in_j"), "id", "set")

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left["id"].to_numpy()
        order = np.argsort(ids)
        sets = [np.frombuffer(x, np.uint64) for x in left["set"].to_pylist()]
        at = lambda c: order[np.searchsorted(ids, right[c].to_numpy(), sorter=order)]
        u, v = at("u"), at("v")
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        both = _shared(sets)[u, v]
        ok = both >= similarity * (sizes[u] + sizes[v] - both) - 1e-9
        return right.select(["u", "v"]).filter(pa.array(ok))

    return needed.groupBy("in_top", "in_i", "in_j").cogroup(tiled.groupBy("top", "i", "j")).applyInArrow(judge, "u long, v long")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of ``sets`` have in common."""
    n = len(sets)
    value, row = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    new = np.r_[True, value[1:] != value[:-1]][: len(value)]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1 if len(column) else np.empty(0, bool)
    row, column = row[often], np.cumsum(new[often]) - 1
    out = np.zeros((n, n), np.float32)
    width = 1 << 13
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + width, width))
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        has = np.zeros((n, width), np.float32)
        has[row[lo:hi], column[lo:hi] - k * width] = 1
        out += has @ has.T
    return out.astype(np.int64)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = 0.8) -> DataFrame:
    """The rows of ``df`` that stay when each group of near copies keeps one document.

    Groups are those of :func:`components`; then, of what these leave, texts
    whose five-word shingles have a Jaccard similarity of ``similarity`` or more,
    found by sketches and judged on whole texts (None: without these).
    A row is known by its id and its whole text's digest: a group keeps the
    smallest id's, ids of null last, and rows equal in both count once.
    """
    text = F.col(text_col).cast("string")
    named = [F.coalesce(F.col(id_col).cast("string"), F.lit("none")).alias("key"), digest(F.coalesce(text, F.lit(""))).alias("digest")]
    first = [F.col("doc_id").isNull().alias("none"), "doc_id", "key", "digest"]

    def run(batch: pa.RecordBatch):
        texts = texts_of(batch)
        out = {"doc_id": batch.column(0), "key": batch.column(2), "digest": batch.column(3)}
        out["fp"] = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        hashes = [shingles(t) if similarity else np.empty(0, np.uint64) for t in texts]
        sets = [np.unique(h) for h in hashes]
        out["id"] = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)
        yield out | {"size": list(map(len, sets)), "sk": list(map(_sketch, hashes))}

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *named)
    seen = stored(mapped(rows, run, "doc_id long, key string, digest binary, fp long, id long, size long, sk binary"), "fingerprints")
    classes = seen.groupBy("fp").agg(F.min(F.struct(*first, "id", "size", "sk")).alias("least"))
    stay = _firsts(classes, stars(links(classes.select("fp"))), "fp")
    if similarity:
        # texts of one shingle set are one class; of sets whose 64-bit ids collide one is compared and the others stay
        classes = stay.repartition("id").groupBy("id", "size", "sk").agg(F.min(F.struct(*first)).alias("least"))
        classes = stored(classes.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("size", "sk"))), "sketches")
        alone, classes = classes.where("nth > 1").select("least.*"), classes.where("nth = 1")

        def texts(ids: DataFrame) -> DataFrame:
            wanted = stored(classes.select("id", "least.key", "least.digest").join(ids, "id"), "wanted")
            return rows.select("text", "key", "digest").join(wanted, ["key", "digest"]).select("id", "text").dropDuplicates(["id"])

        near = similar_links(classes.select("id", "sk", "size"), texts, similarity)
        stay = _firsts(classes.select("id", "least"), stars(near), "id").unionByName(alone)
    kept = df.select(F.struct("*").alias("row"), *named).join(stay.select("key", "digest").hint("merge"), ["key", "digest"], "left_semi")
    return kept.dropDuplicates(["key", "digest"]).select("row.*")  # partitioned by these already
