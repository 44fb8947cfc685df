"""Line dedup by a log-template tree of fixed depth.

Each line goes down a tree: the number of its tokens, then its leading tokens
(``lead`` of them, fewer than half of the line), those with a digit generalised
to ``<*>``. At the leaf, lines are merged token by token: a token that less than
one in ``RARE`` of the leaf's lines, or fewer than ``docs`` of them, have at its
position is a variable field, ``<*>`` as well; and once more with a token that
less than half of them have, as a field of few values is still a field. A merged
template counts if at least ``FIXED`` in five of its tokens are fixed. A template that recurs in at least
``docs`` different texts, merged or with only digits generalised, is boilerplate
and its lines are dropped, each everywhere or but for the first document that
has it.

Templates and tokens travel as 64-bit hashes and are counted before and after
the shuffle; a leaf's lines are counted in pieces and it keeps at most ``RARE``
tokens of a position, so neither a large leaf nor a template is ever gathered. Documents with the same whole text count
once. Only lines of leaves that hold different templates are looked at token by
token.

Defined cases: null text has no lines and stays null; blank lines are never
dropped; a line that occurs often in one text only stays; repeated rows and
null ids are carried; extra columns, whatever their names, are kept by
:func:`drop_recurring`; a line may be as long as its text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from airweave.llm.common import digest, mapped, split_join, steps, stored, texts_of

_DIGIT = re.compile(rb"[0-9]")
FIELD = b"<*>"
#: A fixed token is one that at least one in so many lines of the leaf have there; of five tokens at least so many are fixed.
RARE, FIXED = 10, 3
#: Different lines of a piece of a leaf, and counts that a task holds before it passes them on.
PIECE, HELD = 5_000, 200_000


def tokens_of(line: bytes) -> list[bytes]:
    """Tokens of a line, those with a digit generalised; none for a blank line."""
    tokens = line.split()
    return [FIELD if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def leaf_of(tokens: list[bytes], lead: int) -> bytes:
    """The tree's leaf for a line: its number of tokens and its leading ones."""
    n = len(tokens)
    return b"%d|%s" % (n, b" ".join(tokens[: min(lead, (n - 1) // 2)]))


def slots(tokens: list[bytes]) -> list[int]:
    """Hash of each token at its position; 0 for variable ones."""
    return [0 if t == FIELD else _signed(t, i) for i, t in enumerate(tokens)]


def _signed(x: bytes, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(x, seed) - (1 << 63)


def _parsed(rows: DataFrame, lead: int) -> DataFrame:
    """(key, line, whole, leaf) of each distinct text of ``rows`` (key, text): number, template and leaf of each line that has tokens."""

    def run(batch: pa.RecordBatch):
        out: dict[str, list] = {"key": [], "line": [], "whole": [], "leaf": []}
        for key, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            lines, found, seen = [], [], {}
            for i, line in enumerate(text.split(b"\n")):
                got = seen.get(line)
                if got is None:
                    tokens = tokens_of(line)
                    got = seen[line] = (_signed(b" ".join(tokens)), _signed(leaf_of(tokens, lead))) if tokens else ()
                if got:
                    lines.append(i)
                    found.append(got)
            for c, v in zip(out.values(), (key, lines, [w for w, _ in found], [x for _, x in found]), strict=True):
                c.append(v)
            if len(out["key"]) == 512:
                yield out
                out = {k: [] for k in out}
        if out["key"]:
            yield out

    parsed = mapped(rows.select("key", "text"), run, "key binary, line array<int>, whole array<long>, leaf array<long>")
    return stored(parsed.dropDuplicates(["key"]), "templates")


def _fixed(lines: DataFrame, docs: int) -> DataFrame:
    """(leaf, fixed, strong) of each leaf of ``lines`` (whole, leaf, n, total, kinds, slots) that can have a merged template.

    A leaf's lines come together in pieces of about ``PIECE`` lines. Where a leaf
    is one piece, its tokens are counted there and only the fixed ones leave it,
    and none if they are at too few positions. A token that one in ``RARE`` lines
    of a larger leaf have is as frequent in one of its pieces at least: the pieces
    name such tokens, and these alone are counted over the whole leaf.
    """
    pieces = F.ceil(F.col("kinds") / PIECE).cast("int").alias("pieces")
    dealt = lines.select("leaf", F.pmod(F.xxhash64("whole", F.lit(7)), pieces).cast("int").alias("piece"), pieces, "n", "total", "slots")

    def piece(batches):
        at, one, total, weight, held, counts = None, True, 0, 0, 0, []

        def frequent(final: bool):
            """What the lines counted so far give: fixed tokens if they are the whole leaf, else those that may be."""
            nonlocal weight, held, counts
            own = one and final
            least = max(docs, -(-total // RARE)) if own else -(-weight // RARE)
            often = [[(s, n) for s, n in c.items() if n >= least] for c in counts]
            enough = not own or 5 * sum(map(bool, often)) >= FIXED * len(often)
            found = [x for c in often for x in c] if enough else []
            weight, held, counts = 0, 0, [Counter() for _ in counts]
            if found:
                strong = [s for s, n in found if own and 2 * n >= total]
                yield pa.RecordBatch.from_pydict({"leaf": [at[0]], "own": [own], "fixed": [[s for s, _ in found]], "strong": [strong]}, schema=kind)

        for batch in batches:
            for leaf, i, of, n, all_n, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (leaf, i):
                    if at:
                        yield from frequent(True)
                    at, one, total, counts = (leaf, i), of == 1, all_n, []
                weight += n
                counts += [Counter() for _ in row[len(counts) :]]
                for c, s in zip(counts, row, strict=False):
                    if s:
                        c[s] += n
                held += len(row)
                if held > HELD:
                    held = sum(map(len, counts))
                    if held > HELD:
                        one = False
                        yield from frequent(False)
        if at:
            yield from frequent(True)

    shape = "leaf long, own boolean, fixed array<long>, strong array<long>"
    kind = to_arrow_schema(StructType.fromDDL(shape))
    found = stored(dealt.repartition("leaf", "piece").sortWithinPartitions("leaf", "piece").mapInArrow(piece, shape), "fixed")
    whole = found.where("own").select("leaf", "fixed", "strong")
    asked = found.where("NOT own").groupBy("leaf").agg(F.array_distinct(F.flatten(F.collect_list("fixed"))).alias("asked"))

    def count(batches):
        seen: Counter = Counter()

        def out():
            found = {"leaf": [k[0] for k in seen], "total": [k[1] for k in seen], "slot": [k[2] for k in seen], "n": list(seen.values())}
            seen.clear()
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in found.items()})

        for batch in batches:
            for leaf, n, total, row, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for s in set(asked).intersection(row):
                    seen[leaf, total, s] += n
                if len(seen) > HELD:
                    yield out()
        yield out()

    counted = split_join(lines, asked, ["leaf"]).select("leaf", "n", "total", "slots", "asked").mapInArrow(count, "leaf long, total long, slot long, n long")
    fixed = counted.groupBy("leaf", "total", "slot").agg(F.sum("n").alias("n")).where((F.col("n") >= docs) & (F.col("n") * RARE >= F.col("total")))
    large = fixed.groupBy("leaf").agg(F.collect_list("slot").alias("fixed"), F.collect_list(F.when(F.col("n") * 2 >= F.col("total"), F.col("slot"))).alias("strong"))
    return whole.unionByName(large)


def _merged(rows: DataFrame, wholes: DataFrame, docs: int) -> DataFrame:
    """(whole, merged): the one or two merged templates of each template of ``wholes`` (whole, leaf, n, first) that has enough fixed tokens."""
    leaves = wholes.groupBy("leaf").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where((F.col("total") >= docs) & (F.col("kinds") > 1))
    wanted = split_join(wholes, leaves, ["leaf"]).groupBy(F.col("first").alias("key")).agg(F.collect_list(F.struct("whole", "leaf", "n", "total", "kinds")).alias("wanted"))

    def read(batch: pa.RecordBatch):
        for text, wanted in zip(texts_of(batch), batch.column(1).to_pylist(), strict=True):
            out: dict[str, list] = {"whole": [], "leaf": [], "n": [], "total": [], "kinds": [], "slots": []}
            ask = {x["whole"]: x for x in wanted}
            for line in text.split(b"\n"):
                tokens = tokens_of(line)
                if x := ask.pop(_signed(b" ".join(tokens)), None):
                    for c, v in zip(out.values(), (*x.values(), slots(tokens)), strict=True):
                        c.append(v)
                if not ask:
                    break
            yield out

    shape = "whole long, leaf long, n long, total long, kinds long, slots array<long>"
    lines = stored(mapped(split_join(rows, wanted, ["key"]).select("text", "wanted"), read, shape).dropDuplicates(["whole"]), "lines")

    fixed = _fixed(lines, docs)

    def mask(batch: pa.RecordBatch):
        out: dict[str, list] = {"whole": [], "merged": []}
        for whole, leaf, row, *kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for held in {tuple(s if s in kind else 0 for s in row) for kind in map(set, kinds)}:
                if 5 * sum(map(bool, held)) >= FIXED * len(held):
                    out["whole"].append(whole)
                    out["merged"].append(_signed(b"%d|" % leaf + b" ".join(b"%d" % s for s in held)))
        yield out

    return mapped(split_join(lines, fixed, ["leaf"]).select("whole", "leaf", "slots", "fixed", "strong"), mask, "whole long, merged long")


def recurring(rows: DataFrame, docs: int, lead: int) -> DataFrame:
    """(key, lines, first): numbers of the lines of each distinct text of ``rows`` (key, text) that have a
    recurring template, and those of them whose template has this text as its first by key."""
    parsed = _parsed(rows, lead)
    kinds = F.explode(F.array_distinct(F.arrays_zip("whole", "leaf"))).alias("x")
    wholes = stored(parsed.select("key", kinds).groupBy("x.whole", "x.leaf").agg(F.count("*").alias("n"), F.min("key").alias("first")), "counts")
    merged = stored(_merged(rows, wholes, docs), "merged")
    each = parsed.select("key", F.explode(F.arrays_zip("line", "whole")).alias("x")).select("key", "x.*")
    texts = each.join(merged.hint("merge"), "whole").select("merged", "key").distinct()
    often = texts.groupBy("merged").agg(F.count("*").alias("n"), F.min("key").alias("first")).where(F.col("n") >= docs)
    drop = split_join(merged, often.select("merged", "first"), ["merged"]).groupBy("whole").agg(F.min("first").alias("first"))
    same = wholes.where(F.col("n") >= docs).select("whole", F.col("first").alias("own"))
    drop = same.join(drop.hint("merge"), "whole", "full").select("whole", F.coalesce("first", "own").alias("first"))
    hit = split_join(each, drop, ["whole"])
    return hit.groupBy("key").agg(F.collect_set("line").alias("lines"), F.collect_set(F.when(F.col("first") == F.col("key"), F.col("line"))).alias("first"))


def _cut(text: bytes, lines: list[int] | None, first: list[int] | None, keep_first: bool) -> tuple[int, int, bytes]:
    """(lines, dropped lines, what is kept) of a text, of which the numbers ``lines`` recur, ``first`` as their template's first."""
    rows = text.split(b"\n") if text else []
    gone = set(lines or ()) - set((first or ()) if keep_first else ())
    return len(rows), len(gone), b"\n".join([x for i, x in enumerate(rows) if i not in gone]) if gone else text


def _judged(df: DataFrame, docs: int, lead: int, text_col: str) -> DataFrame:
    """(row, text, lines, first) of each row of ``df``."""
    text = F.col(text_col).cast("string")
    key = digest(F.coalesce(text, F.lit(""))).alias("key")
    found = recurring(df.select(key, F.coalesce(text, F.lit("")).alias("text")), docs, lead)
    return split_join(df.select(F.struct("*").alias("row"), text.alias("text"), key), found, ["key"], "left").select("row", "text", "lines", "first")


def drop_recurring(df: DataFrame, docs: int = 5, keep_first: bool = False, lead: int = 2, text_col: str = "text") -> DataFrame:
    """``df`` without the lines that have a recurring template."""
    at = df.columns.index(text_col)
    judged = _judged(df, docs, lead, text_col)

    def run(batch: pa.RecordBatch):
        for part in steps(batch):
            row = part.column(0)
            fields = row.flatten()
            cut = [_cut(t, x, y, keep_first) for t, x, y in zip(texts_of(part), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            kept = pa.array([None if n else t for (_, n, _), t in zip(cut, fields[at], strict=True)], fields[at].type)
            fields[at] = pa.compute.coalesce(kept, pa.array([k.decode() if n else None for _, n, k in cut], fields[at].type))
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(row.type))], ["row"])

    return mapped(judged, run, StructType([judged.schema["row"]])).select("row.*")


def digests(df: DataFrame, docs: int = 5, keep_first: bool = False, lead: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row."""
    judged = _judged(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), docs, lead, "text")

    def run(batch: pa.RecordBatch):
        for part in steps(batch, "text"):
            cut = [_cut(t, x, y, keep_first) for t, x, y in zip(texts_of(part), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield {"doc_id": part.column(0), "n_lines": [n for n, _, _ in cut], "n_dropped": [n for _, n, _ in cut], "kept_sha256": [hashlib.sha256(k).hexdigest() for _, _, k in cut]}

    return mapped(judged.select("row.doc_id", "text", "lines", "first"), run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def sql(docs: int = 5, lead: int = 2) -> str:
    """DuckDB SQL for :func:`digests` (lines dropped everywhere) over ``documents``."""
    return f"""WITH texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
lines AS (SELECT text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM texts WHERE text <> ''),
tokens AS (SELECT text, i, line, list_filter(regexp_split_to_array(regexp_replace(line, '[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*', '<*>', 'g'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS t FROM lines),
cut AS (SELECT text, i, t, array_to_string(t, ' ') AS whole, len(t) || '|' || array_to_string(t[1:least({lead}, (len(t) - 1) // 2)], ' ') AS leaf FROM tokens WHERE len(t) > 0),
wholes AS (SELECT whole, leaf, any_value(t) AS t, count(DISTINCT text) AS n FROM cut GROUP BY whole, leaf),
leaves AS (SELECT leaf, sum(n) AS total FROM wholes GROUP BY leaf HAVING sum(n) >= {docs} AND count(*) > 1),
each AS (SELECT whole, leaf, n, total, len(t) AS size, unnest(t) AS token, generate_subscripts(t, 1) AS j FROM wholes JOIN leaves USING (leaf)),
fixed AS (SELECT leaf, j, token, sum(n) * 2 >= total AS strong FROM each WHERE token <> '<*>' GROUP BY leaf, j, token, total HAVING sum(n) >= {docs} AND sum(n) * {RARE} >= total),
paired AS (SELECT whole, leaf, size, e.j, e.token, f.token IS NOT NULL AS a, coalesce(strong, false) AS b FROM each e LEFT JOIN fixed f USING (leaf, j, token)),
merged AS (SELECT whole, leaf, string_agg(CASE WHEN a THEN token ELSE '<*>' END, ' ' ORDER BY j) AS m FROM paired GROUP BY whole, leaf, size HAVING 5 * count(*) FILTER (WHERE a) >= {FIXED} * size
  UNION SELECT whole, leaf, string_agg(CASE WHEN b THEN token ELSE '<*>' END, ' ' ORDER BY j) AS m FROM paired GROUP BY whole, leaf, size HAVING 5 * count(*) FILTER (WHERE b) >= {FIXED} * size),
often AS (SELECT leaf, m FROM cut JOIN merged USING (whole, leaf) GROUP BY leaf, m HAVING count(DISTINCT text) >= {docs}),
drops AS (SELECT whole FROM wholes WHERE n >= {docs} UNION SELECT whole FROM merged JOIN often USING (leaf, m)),
gone AS (SELECT text, i FROM cut JOIN drops USING (whole)),
kept AS (SELECT l.text, count(*) AS n_lines, count(g.i) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS kept FROM lines l LEFT JOIN gone g ON l.text = g.text AND l.i = g.i GROUP BY l.text)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN kept k ON coalesce(d.text, '') = k.text"""
