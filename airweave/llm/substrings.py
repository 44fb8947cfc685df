"""Removal of long passages that occur elsewhere, by super-k-mer partitioning.

A text's words form windows of ``window`` consecutive words. The smallest hash
among a window's runs of ``m`` words is its minimiser; consecutive windows that
share one occurrence of it form a super-k-mer. Two equal windows have equal
minimisers, so only super-k-mers whose minimiser occurs again can matter; those
travel as one packed string to the bucket of their minimiser, where sorting
counts windows exactly. Runs are ordered by their full hash, then by position, so
equal windows have the same minimiser wherever they stand. The bucket of a
minimiser with more than ``HOT`` super-k-mers, or whose windows would take more
than ``HOT_BYTES``, is split: super-k-mers that are the same string are counted as
wholes before the shuffle, as all their windows then occur again, and one of each
kind is dealt out window by window to buckets of the windows' SHA-256, which are
sorted and counted likewise.

Documents are handled per distinct whole text: two equal texts of ``window``
words or more are covered by each other entirely, and one of them stands for
all when compared with the rest.

Defined cases: null text has no words; fewer than ``window`` words are never
removed; repeated rows count as separate documents; extra columns, whatever their
names, are kept by :func:`remove_repeats`; null ids are carried through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airweave.llm.common import digest, mapped, split_join, steps, stored, texts_of

#: Super-k-mers of one minimiser that are sorted together, and bytes of their windows.
HOT, HOT_BYTES = 1000, 16 << 20
#: Bytes of windows from which a task sorts what it holds before it goes on to the next bucket.
SORT_BYTES = 16 << 20


def _mers(words: list[bytes], m: int) -> np.ndarray:
    """Hash of each run of ``m`` words."""
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(w) - m + 1
    h = np.zeros(n, np.uint64)
    odd = 0x9E3779B97F4A7C15
    for j in range(m):
        h += w[j : j + n] * np.uint64(odd)
        odd = odd * 0xD1342543DE82EF95 % (1 << 64) | 1
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def superkmers(words: list[bytes], bounds: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, minimiser) of each super-k-mer; document ``d`` has words ``bounds[d]:bounds[d+1]``."""
    sizes = np.diff(bounds)
    if not (sizes >= window).any():
        none = np.empty(0, np.int64)
        return none, none, none, none
    h = _mers(words, m)
    at = np.arange(len(h))
    span, have = window - m + 1, 1
    while have < span:
        step = min(have, span - have)
        near, far = at[:-step], at[step:]
        at = np.where(h[far] < h[near], far, near)
        have += step
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    start = np.arange(len(at)) - bounds[doc]
    inside = start + window <= sizes[doc]
    idx = np.flatnonzero(inside)
    d, p = doc[idx], at[idx]
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1])])
    return d[first], start[idx[first]], np.diff(np.r_[first, len(idx)]), h[p[first]].view(np.int64)


def _windows(packed: bytes, window: int) -> Iterator[bytes]:
    """Each window of a packed string, as a string."""
    ends = np.cumsum([len(w) + 1 for w in packed.split(b" ")]).tolist()
    begins = [0, *ends]
    return (packed[begins[j] : ends[j + window - 1] - 1] for j in range(len(ends) - window + 1))


def _repeated(packed: list[bytes], window: int) -> list[list[bool]]:
    """For each packed string, whether each of its windows occurs more than once in all of them."""
    cut, owner = [], []
    for i, s in enumerate(packed):
        own = list(_windows(s, window))
        cut += own
        owner += [i] * len(own)
    order = sorted(range(len(cut)), key=cut.__getitem__)
    twice = [False] * len(cut)
    for a, b in zip(order, order[1:], strict=False):
        if cut[a] == cut[b]:
            twice[a] = twice[b] = True
    out: list[list[bool]] = [[] for _ in packed]
    for i, t in zip(owner, twice, strict=True):
        out[i].append(t)
    return out


def _runs(flags: list[bool], start: int):
    """(start, length) of each run of set flags."""
    x = np.flatnonzero(np.diff(np.r_[False, np.array(flags, bool), False].astype(np.int8)))
    return [(start + int(a), int(b - a)) for a, b in zip(x[::2], x[1::2], strict=True)]


def repeated_windows(texts: DataFrame, window: int, m: int) -> DataFrame:
    """(key, runs) of distinct ``texts`` (key, text): runs of windows that occur again."""

    def cut(batch: pa.RecordBatch):
        for part in steps(batch):
            keys = part.column(0).to_pylist()
            docs = [t.split() for t in texts_of(part)]
            bounds = np.r_[0, np.cumsum([len(d) for d in docs])]
            words = [w for x in docs for w in x]
            d, start, n, mini = superkmers(words, bounds, window, m)
            upto = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]
            first = bounds[d] + start
            size = n * (upto[first + n + window - 1] - upto[first])  # more than its windows take
            edges = np.searchsorted(d, np.arange(len(docs) + 1))
            has = [i for i in range(len(docs)) if edges[i] < edges[i + 1]]
            if has:
                yield {"key": [keys[i] for i in has], "mini": [mini[edges[i] : edges[i + 1]] for i in has], "start": [start[edges[i] : edges[i + 1]] for i in has], "n": [n[edges[i] : edges[i + 1]] for i in has], "size": [size[edges[i] : edges[i + 1]] for i in has]}

    cuts = stored(mapped(texts.select("key", "text"), cut, "key binary, mini array<long>, start array<int>, n array<int>, size array<long>"), "superkmers")
    again = cuts.select(F.explode(F.arrays_zip("mini", "size")).alias("x")).groupBy("x.mini").agg(F.count("*").alias("times"), F.sum("x.size").alias("bytes")).where("times > 1")
    again = again.select("mini", ((F.col("times") > HOT) | (F.col("bytes") > HOT_BYTES)).alias("hot"))
    each = cuts.select("key", F.explode(F.arrays_zip("mini", "start", "n")).alias("x")).select("key", "x.*")
    marked = split_join(each, again, ["mini"]).groupBy("key").agg(F.collect_list(F.struct("start", "n", "mini", "hot")).alias("cuts"))

    def pack(batch: pa.RecordBatch):
        for part in steps(batch):
            out: dict[str, list] = {"key": [], "mini": [], "hot": [], "start": [], "n": [], "packed": []}
            for key, text, cuts in zip(part.column(0).to_pylist(), texts_of(part), part.column(2).to_pylist(), strict=True):
                words = text.split()
                for c in cuts:
                    a, n = c["start"], c["n"]
                    row = (key, c["mini"], c["hot"], a, n, b" ".join(words[a : a + n + window - 1]))
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                if len(out["key"]) > 20_000:
                    yield out
                    out = {k: [] for k in out}
            if out["key"]:
                yield out

    packed = stored(mapped(texts.select("key", "text").join(marked, "key"), pack, "key binary, mini long, hot boolean, start int, n int, packed binary"), "packed")

    def count(batches):
        held: dict[str, list] = {"key": [], "mini": [], "start": [], "packed": []}
        size = 0

        def flush():
            keys, starts, lens = [], [], []
            for key, start, flags in zip(held["key"], held["start"], _repeated(held["packed"], window), strict=True):
                for a, n in _runs(flags, start):
                    keys.append(key)
                    starts.append(a)
                    lens.append(n)
            for x in held.values():
                x.clear()
            return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "start": pa.array(starts, pa.int32()), "n": pa.array(lens, pa.int32())})

        for batch in batches:
            for key, mini, start, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SORT_BYTES and mini != held["mini"][-1]:
                    yield flush()
                    size = 0
                for k, v in zip(held, (key, mini, start, s), strict=True):
                    held[k].append(v)
                size += (s.count(b" ") - window + 2) * len(s)
        if held["key"]:
            yield flush()

    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cold = packed.where("not hot").select("key", "mini", "start", "packed").repartition(parts, "mini").sortWithinPartitions("mini").mapInArrow(count, "key binary, start int, n int")
    hot = packed.where("hot").select("key", "start", "n", "packed", digest(F.col("packed")).alias("same"))
    kinds = hot.groupBy("same").agg(F.count("*").alias("times"), F.first("packed").alias("packed"), F.first("key").alias("key"), F.first("start").alias("start"))
    whole = split_join(hot, kinds.where("times > 1").select("same"), ["same"]).select("key", "start", "n")

    def spread(batch: pa.RecordBatch):
        for part in steps(batch, "packed"):
            out: dict[str, list] = {"key": [], "start": [], "once": [], "digest": []}
            for key, start, times, s in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for j, one in enumerate(_windows(s, window)):
                    for k, v in zip(out, (key, start + j, times == 1, hashlib.sha256(one).digest()), strict=True):
                        out[k].append(v)
            yield out

    each = stored(mapped(kinds.select("key", "start", "times", "packed"), spread, "key binary, start int, once boolean, digest binary"), "windows")
    shared = each.groupBy("digest").agg(F.count("*").alias("times")).where("times > 1").select("digest")
    part = split_join(each.where("once"), shared, ["digest"]).select("key", "start", F.lit(1).alias("n"))
    hot = whole.unionByName(part)
    return cold.unionByName(hot).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def without_repeats(df: DataFrame, window: int = 35, m: int = 8, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per distinct text: (key, n_words, n_removed, kept text), and the rows of ``df`` as (row, key)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.select(F.struct("*").alias("row"), digest(text).alias("key"))
    texts = df.select(digest(text).alias("key"), text.alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    found = repeated_windows(texts, window, m)

    def keep(batch: pa.RecordBatch):
        for part in steps(batch):
            out: dict[str, list] = {"key": part.column(0).to_pylist(), "n_words": [], "n_removed": [], "kept": []}
            for text, copies, runs in zip(texts_of(part), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                words = text.split()
                n = len(words)
                if copies > 1 and n >= window:
                    words = []
                elif runs:
                    edge = np.zeros(n + 1, np.int64)
                    a = np.array([r["start"] for r in runs])
                    np.add.at(edge, a, 1)
                    np.add.at(edge, a + np.array([r["n"] for r in runs]) + window - 1, -1)
                    words = [w for w, c in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not c]
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept"].append(b" ".join(words).decode())
            yield out

    done = mapped(texts.select("key", "text", "copies").join(found, "key", "left"), keep, "key binary, n_words long, n_removed long, kept string")
    return done, keyed


def remove_repeats(df: DataFrame, window: int = 35, m: int = 8, text_col: str = "text") -> DataFrame:
    """``df`` with repeated passages cut from its text, words then joined by single spaces.

    Texts that lose nothing keep their own spacing.
    """
    done, keyed = without_repeats(df, window, m, text_col)
    lost = done.where("n_removed > 0").select("key", "n_removed", "kept")
    cut = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row")[text_col])
    return split_join(keyed, lost, ["key"], "left").select(F.col("row").withField(text_col, cut).alias("row")).select("row.*")


def digests(df: DataFrame, window: int = 35, m: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    done, keyed = without_repeats(df, window, m, text_col)
    done = done.select("key", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return split_join(keyed.select(F.col("row")[id_col].alias("doc_id"), "key"), done, ["key"]).drop("key")


def sql(window: int = 35) -> str:
    """DuckDB SQL for :func:`digests` over ``documents``: every window as a string."""
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM docs WHERE len(w) > 0),
windows AS (SELECT r, i, array_to_string(w[i:i + {window - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {window - 2}, 1))) AS i FROM docs)),
again AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
starts AS (SELECT r, i FROM windows JOIN again USING (s)),
covered AS (SELECT words.r, word, j, count(i) OVER (PARTITION BY words.r ORDER BY j ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) > 0 AS gone FROM words LEFT JOIN starts ON starts.r = words.r AND i = j),
done AS (SELECT r, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone), '') AS kept FROM covered GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN done USING (r)"""
