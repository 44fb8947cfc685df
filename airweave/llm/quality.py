"""Quality classifier: random Fourier features over document statistics.

Statistics of each whole text are standardised and mapped to random cosines,
which approximate a Gaussian kernel. Ridge scores come from normal equations
summed partition by partition and then row by row, and isotonic regression over
a fixed number of score bins turns scores into probabilities.

What reaches the driver has a fixed size: moments, one matrix of ``width``
squared, and counts of ``BINS`` bins.

Defined cases: null and empty texts have statistics of their own (all zero) and
are scored like any other; without labels of both classes the score is the
share of label 1 (0.5 if there are none); null labels don't count, of repeated
labels of an id the largest does; repeated rows are scored each; null ids are
carried and never train.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airweave.llm.common import mapped, stored, texts_of

#: Tasks that add up rows of the normal equations; score bins of the calibration.
FAN, BINS = 16, 2048
#: Frequent short words of four languages.
STOP = frozenset("the of and to in is that it for was on with as be by at from this are not have or und der die das ist von zu den mit nicht ein im sich auf für le la les de et des un une est dans que qui pour pas du au aux el los las en y es por con para se su lo una".encode().split())
STATS = ["log_bytes", "log_words", "word_length", "upper", "digits", "space", "lines", "punctuation", "marks", "symbols", "pipes", "other_bytes", "distinct", "distinct_pairs", "repeats", "stop", "long_words", "line_words", "distinct_lines", "ends", "capital_words"]
_CLASS = np.zeros((256, 10))
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"#$%&*+<=>@^_~\\/{}[]", b"|", bytes(range(128, 256)), b"'\"()-`")):
    _CLASS[list(_chars), _i] = 1


def stats(text: bytes) -> list[float]:
    """Statistics of a text, as ``STATS`` names them."""
    if not text:
        return [0.0] * len(STATS)
    n = len(text)
    upper, digits, space, lines, stops, marks, symbols, pipes, other, _ = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS).tolist()
    words = text.split()
    w = max(1, len(words))
    chars = n - space - lines
    rows = [x for x in text.split(b"\n") if x]
    kinds = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(n), np.log1p(len(words)), min(chars / w, 40.0), upper / n, digits / n, space / n, lines / w, stops / w, marks / w, symbols / w, pipes / w, other / n,
        kinds / w, pairs / w, same / w, sum(map(STOP.__contains__, words)) / w, sum(x > 15 for x in map(len, words)) / w, np.log1p(w / max(1, len(rows))), len(set(rows)) / max(1, len(rows)),
        sum(x.rstrip()[-1:] in b".!?" for x in rows) / max(1, len(rows)), sum(map(bytes.istitle, words)) / w,
    ]


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) of each row."""

    def run(batch: pa.RecordBatch):
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            yield {"doc_id": part.column(0), "x": [[float(v) for v in stats(t)] for t in texts_of(part)]}

    return mapped(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, x array<double>")


class Model:
    """Mean and scale of statistics, random waves, ridge weights and the calibration's steps."""

    def __init__(self, mean, scale, width: int, length: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.waves = rng.normal(size=(len(mean), width)) / length
        self.phase = rng.uniform(0, 2 * np.pi, width)
        self.weights = np.zeros(width + 1)
        self.at, self.value = np.array([0.0]), np.array([0.5])

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.hstack((np.sqrt(2 / self.waves.shape[1]) * np.cos(z @ self.waves + self.phase), np.ones((len(x), 1))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.value)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted non-decreasing least squares fit: pool adjacent violators."""
    out: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        out.append([v, w, 1])
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            b, a = out.pop(), out.pop()
            out.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([[v] * n for v, _, n in out])


def _array(col) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _sums(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations of (y, x) rows."""
    d = len(model.weights)

    def part(batches):
        a, n = np.zeros((d, d + 1)), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                z = model.lift(_array(batch.column(1).slice(lo, 4096)))
                y = batch.column(0).slice(lo, 4096).to_numpy().astype(float)
                a += z.T @ np.hstack((z, y[:, None]))
                n += len(y)
        if n:
            yield pa.RecordBatch.from_pydict({"i": np.arange(d, dtype=np.int32), "a": [r.tobytes() for r in a]})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(row.as_py())
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(total), pa.int32()), "a": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    total = np.zeros((d, d + 1))
    for r in rows.mapInArrow(part, "i int, a binary").repartition(FAN, "i").mapInArrow(add, "i int, a binary").collect():
        total[r["i"]] += np.frombuffer(r["a"])
    return total[:, :d], total[:, d]


def fit(rows: DataFrame, width: int = 256, length: float = 4.0, ridge: float = 1e-3, seed: int = 11) -> Model | float:
    """Fit to (doc_id, y, x) rows; a share of label 1 instead where there are not both labels.

    One row in five, by hash of its id, calibrates and the others fit the ridge scores.
    """
    k = len(STATS)
    col = [F.col("x")[i] for i in range(k)]
    got = rows.agg(F.count("*"), F.sum("y"), *[F.avg(c) for c in col], *[F.stddev_pop(c) for c in col]).collect()[0]
    n, ones = got[0], got[1] or 0
    if not n or ones in (0, n):
        return ones / n if n else 0.5
    model = Model(np.array(got[2 : 2 + k]), np.maximum(np.array(got[2 + k :]), 1e-3), width, length, seed)
    aside = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(5)) == 0
    a, b = _sums(rows.where(~aside).select("y", "x"), model)
    if not np.any(a):
        return ones / n
    model.weights = np.linalg.solve(a + ridge * np.trace(a) / len(a) * np.eye(len(a)), b)

    def measure(batch: pa.RecordBatch):
        raw = model.raw(_array(batch.column(1)))
        yield {"bin": np.clip(np.floor((raw + 1) / 3 * BINS), 0, BINS - 1).astype(np.int32), "raw": raw, "y": batch.column(0)}

    seen = mapped(rows.where(aside).select("y", "x"), measure, "bin int, raw double, y int").groupBy("bin").agg(F.avg("raw").alias("at"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if seen:
        at, y, w = (np.array([r[c] for r in seen], float) for c in ("at", "y", "n"))
        # one success and one failure at the ends keep scores inside (0, 1)
        at, y, w = np.r_[at[0] - 1e-3, at, at[-1] + 1e-3], np.r_[0.0, y, 1.0], np.r_[1.0, w, 1.0]
        model.at, model.value = at, isotonic(y, w)
    else:
        model.at, model.value = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scored(x: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score) of (doc_id, x) rows."""

    def run(batch: pa.RecordBatch):
        yield {"doc_id": batch.column(0), "score": model.score(_array(batch.column(1))) if isinstance(model, Model) else [float(model)] * batch.num_rows}

    return mapped(x.select("doc_id", "x"), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, held_out, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    x = stored(statistics(docs, id_col, text_col), "statistics")
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("y"))
    train = x.join(known.hint("merge"), F.col("doc_id") == F.col("_id")).where(~held_out(F.col("doc_id"))).select("doc_id", "y", "x")
    out = scored(x, fit(train))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
