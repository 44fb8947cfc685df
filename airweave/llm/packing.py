"""Packing token sequences by shortest-pack-first over the histogram of lengths.

Texts become token ids with a closing id 0 and are cut into pieces of at most
``size``. Only the histogram of piece lengths (``size`` counts at most) reaches
the driver. Lengths are placed longest first, each into the shortest packs that
still have room, by moving counts between packing patterns. A piece then finds
its place by its rank among the pieces of its length: partition counts summed
along partitions, plus its place in its partition.

Defined cases: null text counts as empty and has the closing id alone; texts of
millions of blanks or without any are cut like all others; repeated rows are packed each; null ids are carried; an empty table has no pieces; extra
columns are ignored by :func:`pack`.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from airweave.llm.common import stored

#: How byte-level vocabularies of this kind split texts before merging, and what counts as white space there.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Length from which a run of white space is cut out: the split's pattern keeps a state for each character of it.
RUN = 100_000
_LONG_RUN = re.compile(f"[{SPACE}]{{{RUN},}}")


class ByteTokenizer:
    """Ids of a byte-level tokenizer file, merged by rank; texts that name a special token take the file's own encoder.

    Raises for files that split or normalise texts otherwise. A very long run of
    white space is cut by the split's own rule: all but its last character, or the
    whole run at a text's end, is one unit of merging.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        split = said.get("pre_tokenizer") or {}
        if said.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path}: only files that split by the byte-level pattern alone are read here")
        self.special = [t["content"] for t in said.get("added_tokens", [])]
        shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(back[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in self.special}
        self.own = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")
        if len(text) < RUN:
            return np.array(self.fast.encode_ordinary(text), "<u4")
        out, at = [], 0
        for run in _LONG_RUN.finditer(text):
            stop = run.end() - (run.end() < len(text))
            out += self.fast.encode_ordinary(text[at : run.start()]) + self.fast._encode_single_piece(text[run.start() : stop])
            at = stop
        return np.array(out + self.fast.encode_ordinary(text[at:]), "<u4")


@lru_cache(2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def pieces(df: DataFrame, path: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece, its partition and its place among that
    partition's pieces of this length; the ids themselves if asked for."""
    schema = StructType.fromDDL("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long" + ", ids array<int>" * with_ids)
    shape = to_arrow_schema(schema)
    def run(batches):
        seen: Counter = Counter()
        part = TaskContext.get().partitionId()
        out: dict[str, list] = {c: [] for c in schema.names}
        t = None
        for batch in batches:
            t = t or tokenizer(path)
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(t.ids(text.as_py() or ""), np.uint32(0)).astype("<u4")
                n, key = len(ids), key.as_py()
                for start in range(0, n, size):
                    one = ids[start : start + size]
                    row = (key, start, len(one), zlib.crc32(one.tobytes()), n, part, seen[len(one)], *([one.astype(np.int32)] if with_ids else []))
                    seen[len(one)] += 1
                    for c, v in zip(out.values(), row, strict=True):
                        c.append(v)
                if len(out["doc_id"]) > 4096:
                    yield pa.RecordBatch.from_pydict(out, schema=shape)
                    out = {c: [] for c in out}
        if out["doc_id"]:
            yield pa.RecordBatch.from_pydict(out, schema=shape)

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each packing pattern, shortest pack first, lengths placed longest first."""
    room: dict[int, list[list]] = defaultdict(list)  # by what is left in a pack: [count, lengths]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = max((r for r, x in room.items() if x and r >= length), default=None)
            if most is None:
                room[size].append([-(-left // (size // length)), ()])
                continue
            pack = room[most][-1]
            n = min(left, pack[0])
            pack[0] -= n
            if not pack[0]:
                room[most].pop()
            room[most - length].append([n, (*pack[1], length)])
            left -= n
    return [(n, lengths) for r in sorted(room) for n, lengths in room[r]]


def slots(found: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, by rank: (first rank, first sequence, offset) of each slot of a pattern."""
    out: dict[int, list] = defaultdict(list)
    taken: Counter = Counter()
    first = 0
    for n, lengths in found:
        offset = 0
        for length in lengths:
            out[length].append((taken[length], first, offset))
            taken[length] += n
            offset += length
        first += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in out.items()}


def pack(df: DataFrame, path: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence_id and offset; ``path`` names the tokenizer file."""
    cut = stored(pieces(df, path, size, id_col, text_col, with_ids), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = slots(patterns(histogram, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    schema = StructType([*ranked.select(*names).schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])
    shape = to_arrow_schema(schema)

    def place(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            seq, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                ranks, firsts, offsets = where[int(k)]
                slot = np.searchsorted(ranks, rank[at], side="right") - 1
                seq[at] = firsts[slot] + rank[at] - ranks[slot]
                offset[at] = offsets[slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(seq), pa.array(offset)], schema=shape)

    return ranked.select(*names, "rank").mapInArrow(place, schema)
