"""Toxicity by a learned lexicon, misspellings and context.

From labelled texts a lexicon of words and stems is learned whose presence tells
toxic texts from others. A Levenshtein automaton of one edit, run along the
lexicon's trie, finds misspelt terms. Each hit is weighed by how well its term
tells texts apart. Its context window tells whether it is aimed at a person,
stands among further hits, or is quoted or reported. A logistic fit over the
weighed hits and the shares of them in each such context gives the score; it
starts from ``PRIOR``, so that without evidence quotation counts less and address more.

The fit uses at most ``max_train`` labelled rows of each class; every whole text
is scored. Labels of ids that are held out never reach the fit.

Defined cases: null and empty texts have no hits and the score of such texts;
without labels of both classes the score is the share of label 1 (0 if there
are none); null labels don't count, of repeated labels of an id the largest
does; repeated rows are scored each; null ids are carried.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airweave.llm.common import mapped, stored, texts_of

_TOKEN = re.compile(r"\w(?:[\w*@$]*\w)?")
#: Marks and words of quotation or report, and words that address a person.
QUOTES = frozenset("\"'`«»“”„‘’‹›")
REPORT = frozenset("said says called word term quote quoted quotes phrase slur insult means meaning sagte wort begriff zitat dit mot terme citation dijo palabra cita".split())
ADDRESS = frozenset("you your yours youre u ur du dich dir dein deine sie ihr tu te toi ton ta vous votre tú ti usted vosotros".split())
#: What contexts add to a hit's weight before there is evidence: aimed at a person, among others, quoted, misspelt; and how firmly.
PRIOR, FIRM = (0.5, 0.25, -0.75, -0.3), 1.0
#: Labelled texts of class 1 that a term needs at least, and their least share, as groups of near copies share rare words;
#: its log odds, and the log likelihood ratio that proves it.
LEAST, SHARE, ODDS, EVIDENCE = 4, 0.01, 3, 10
STEMS, WINDOW, MEMO, LONGEST = (4, 5, 6, 7, 8), 6, 200_000, 40


class Lexicon:
    """Words and stems, and which of them are also matched misspelt."""

    def __init__(self, words: list[str], stems: list[str], fuzzy: set[str] | None = None, strength: dict[str, float] | None = None):
        self.strength = strength or {}
        self.words, self.stems = frozenset(words), frozenset(stems)
        self.stem_sizes = sorted({len(s) for s in stems})
        self.trie: dict = {}
        self.halves: list[tuple[int, bool, set, set]] = []
        groups: dict[tuple[int, bool], list[str]] = {}
        for term, stem in [*((w, False) for w in sorted(words)), *((s, True) for s in sorted(stems))]:
            if len(term) < 5 or (fuzzy is not None and term + "*" * stem not in fuzzy):
                continue
            groups.setdefault((len(term), stem), []).append(term)
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node["*" if stem else ""] = term + "*" * stem
        for (n, stem), terms in groups.items():
            h = n // 2
            self.halves.append((n, stem, {t[:h] for t in terms}, {t[h:] for t in terms}))

    def exact(self, word: str) -> str | None:
        if word in self.words:
            return word
        return next((word[:k] + "*" for k in self.stem_sizes if word[:k] in self.stems), None)

    def near(self, word: str) -> str | None:
        """A term one edit away: one half of it is then intact, which is checked first."""
        if 4 <= len(word) <= LONGEST:
            for n, stem, heads, tails in self.halves:
                h = n // 2
                if (len(word) >= n - 1 if stem else -1 <= len(word) - n <= 1) and (word[:h] in heads or any(word[o : o + n - h] in tails for o in (h - 1, h, h + 1))):
                    return self.intersect(word)
        return None

    def intersect(self, word: str) -> str | None:
        """Walk trie and automaton together; a state is (characters read, edits)."""
        n, best = len(word), None
        stack = [(self.trie, frozenset(((0, 0), (1, 1))))]
        while stack:
            node, states = stack.pop()
            if "*" in node and (best is None or node["*"] < best):
                best = node["*"]
            if "" in node and any(i == n for i, _ in states) and (best is None or node[""] < best):
                best = node[""]
            for c, down in node.items():
                if len(c) != 1 or c == "*":
                    continue
                new = set()
                for i, e in states:
                    if i < n and word[i] == c:
                        new.add((i + 1, e))
                        if not e:
                            new.add((i + 2, 1))
                    elif not e:
                        new.add((i, 1))
                        new.add((i + 1, 1))
                    if not e and i < n and word[i] == c:
                        new.add((i, 1))
                new = {s for s in new if s[0] <= n}
                if new:
                    stack.append((down, frozenset(new)))
        return best


class Scorer(dict):
    """Hit of each word: None, or (term, misspelt). Remembers a bounded number of words."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        term = self.lexicon.exact(word)
        got = (term, False) if term else None
        if got is None and (term := self.lexicon.near(word)):
            got = (term, True)
        if len(self) >= MEMO:
            self.clear()
        self[word] = got
        return got

    def hits(self, text: str) -> tuple[int, list[tuple]]:
        """Number of words, and (term, misspelt, weight, aimed, among others, quoted) of each hit; the weight is by ``PRIOR``."""
        text = text.lower()
        words = _TOKEN.findall(text)
        found = list(map(self.__getitem__, words))
        at = [i for i, x in enumerate(found) if x is not None]
        if not at:
            return len(words), []
        spans = [m.span() for m in _TOKEN.finditer(text)]
        out = []
        for i in at:
            lo, hi = max(0, i - WINDOW), i + WINDOW + 1
            around = words[lo:i] + words[i + 1 : hi]
            a, b = spans[i]
            quoted = (text[a - 1 : a] in QUOTES and a > 0) or (text[b : b + 1] in QUOTES and b < len(text)) or not REPORT.isdisjoint(around)
            more = sum(x is not None for x in found[lo:hi]) - 1
            context = (not ADDRESS.isdisjoint(around), min(more, 2) > 0, quoted)
            weight = 1 + sum(p * c for p, c in zip(PRIOR, context, strict=False))
            out.append((*found[i], weight * self.strength(found[i][0]), *context))
        return len(words), out

    def strength(self, term: str) -> float:
        return self.lexicon.strength.get(term, 1.0)


def features(n: int, hits: list[tuple], strength) -> list[float]:
    """Constant, any hit, sum and density of the hits' strengths, and the sum times their shares in each context."""
    own = [strength(h[0]) for h in hits]
    total = sum(own)
    size = float(np.log1p(total))
    share = [sum(w for w, h in zip(own, hits, strict=True) if h[i]) / total if total else 0.0 for i in (3, 4, 5, 1)]
    return [1.0, float(total > 0), size, float(np.log1p(1000 * total / (n + 20))), *(size * x for x in share)]


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights by Newton steps; rows count ``n`` times, contexts are held near ``PRIOR``."""
    k = x.shape[1]
    start = np.r_[np.zeros(k - len(PRIOR)), PRIOR]
    hold = np.r_[0.0, np.full(k - 1 - len(PRIOR), ridge), np.full(len(PRIOR), FIRM)]
    w = np.zeros(k)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + hold * (w - start)
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(np.maximum(hold, ridge))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, lexicon: Lexicon | None, weights: np.ndarray | None, share: float):
        self.lexicon, self.weights, self.share = lexicon, weights, share

    def score(self, n: int, hits: list) -> float:
        if self.weights is None:
            return self.share
        strength = self.lexicon.strength
        return float(1 / (1 + np.exp(-np.clip(features(n, hits, lambda t: strength.get(t, 1.0)) @ self.weights, -30, 30))))


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out, max_train: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """((y, text) rows to learn from, labelled rows of class 1, of class 0).

    Of each class the ``max_train`` ids of smallest hash are taken. These are few
    enough, by that bound, to be broadcast to the documents; a text counts once.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_train) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 max_train rows
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(ids, "_id")
    return stored(rows.select("y", "text").distinct(), "sample"), sizes.get(1, 0), sizes.get(0, 0)


def fit(docs: DataFrame, labels: DataFrame, label: str, held_out, max_train: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the labelled documents that are not ``held_out`` (a condition on the id), at most ``max_train`` of each class.

    The lexicon has every term that the evidence proves, without a limit.
    """
    some, n1, n0 = sample(docs, labels, label, held_out, max_train, id_col, text_col)
    if not n1 or not n0:
        return Model(None, None, 1.0 if n1 else 0.0)

    def count(batches):
        n: Counter = Counter()
        one: Counter = Counter()

        def out():
            keys = list(n)
            for lo in range(0, len(keys), 1 << 16):
                part = keys[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"term": pa.array(part, pa.string()), "n": pa.array([n[k] for k in part], pa.int64()), "pos": pa.array([one[k] for k in part], pa.int64())})
            n.clear()
            one.clear()

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = set(_TOKEN.findall((text.as_py() or "").lower()))
                found = words | {w[:k] + "*" for k in STEMS for w in words if len(w) > k}
                n.update(found)
                if y:
                    one.update(found)
                if len(n) > 400_000:
                    yield from out()
        yield from out()

    found = {r["y"]: r["n"] for r in some.groupBy("y").agg(F.count("*").alias("n")).collect()}
    m1, m0 = found.get(1, 0), found.get(0, 0)
    if not m1 or not m0:  # labels without documents
        return Model(None, None, n1 / (n1 + n0))
    seen = some.mapInArrow(count, "term string, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    odds = F.log((F.col("pos") + 0.5) / (m1 + 1)) - F.log((F.col("n") - F.col("pos") + 0.5) / (m0 + 1))
    # log likelihood of a term's texts under their own shares of the classes over that under the sample's: few texts prove little
    p, neg, share = F.col("pos"), F.col("n") - F.col("pos"), m1 / (m1 + m0)
    evidence = p * F.log(p / (F.col("n") * share)) + F.when(neg > 0, neg * F.log(neg / (F.col("n") * (1 - share)))).otherwise(0.0)
    good = seen.withColumn("odds", odds).where((p >= max(LEAST, SHARE * m1)) & (F.col("odds") >= ODDS) & (evidence >= EVIDENCE)).orderBy(F.desc("pos"), "term").collect()
    pos = {r["term"]: r["pos"] for r in good}
    strength = {r["term"]: min(1.0, max(0.2, (r["odds"] - 2) / 4)) for r in good}
    words = {t: p for t, p in pos.items() if t[-1] != "*"}
    stems: list[str] = []
    for t in sorted((t for t in pos if t[-1] == "*"), key=len):
        s = t[:-1]
        if not any(s.startswith(x) for x in stems) and max((p for w, p in words.items() if w.startswith(s)), default=0) < 0.8 * pos[t]:
            stems.append(s)
    words = [w for w in words if not any(w.startswith(s) for s in stems)]
    first = Lexicon(words, stems, None, strength)

    def search(batch: pa.RecordBatch):
        scorer = first.__dict__.setdefault("scorer", Scorer(first))  # of this task: words stay known between batches
        out: dict[str, list] = {"y": batch.column(0).to_pylist(), "n": [], "hits": []}
        for text in texts_of(batch):
            n, hits = scorer.hits(text.decode())
            out["n"].append(n)
            out["hits"].append([dict(zip(("term", "near", "w", "aimed", "more", "quoted"), h, strict=True)) for h in hits])
        yield out

    found = stored(mapped(some, search, "y int, n long, hits array<struct<term: string, near: boolean, w: double, aimed: boolean, more: boolean, quoted: boolean>>"), "hits")
    each = found.select("y", F.explode(F.array_distinct(F.transform(F.filter("hits", lambda h: h.near), lambda h: h.term))).alias("term"))
    fuzzy = {t + "*" * (t in first.stems) for t in first.words | first.stems}
    for r in each.groupBy("term").agg(F.sum(1 - F.col("y")).alias("neg"), F.sum("y").alias("pos")).collect():
        if r["neg"] * m1 > 0.2 * r["pos"] * m0:
            fuzzy.discard(r["term"])
    lexicon = Lexicon(words, stems, fuzzy, strength)

    def measure(batch: pa.RecordBatch):
        hits = [[tuple(h.values()) for h in hs if not h["near"] or h["term"] in fuzzy] for hs in batch.column(2).to_pylist()]
        yield {"y": batch.column(0), "x": [features(n, h, lambda t: strength.get(t, 1.0)) for n, h in zip(batch.column(1).to_pylist(), hits, strict=True)]}

    sample_rows = mapped(found, measure, "y int, x array<double>").groupBy("y", "x").agg(F.count("*").alias("n")).collect()
    x, y, n = np.array([r["x"] for r in sample_rows]), np.array([r["y"] for r in sample_rows], float), np.array([r["n"] for r in sample_rows])
    w = _logistic(x, y, n)
    w[0] += np.log((n1 / min(n1, max_train)) / (n0 / min(n0, max_train)))  # the classes' shares, if one was drawn more sparsely
    return Model(lexicon, w, n1 / (n1 + n0))


def _scores(model: Model, texts) -> tuple[list, list, list]:
    scorer = _scorer(model)
    found = [scorer.hits(t.as_py() or "") if scorer is not None else (0, []) for t in texts]
    return [model.score(n, h) for n, h in found], [len(h) for _, h in found], [sorted({x[0] for x in h}) for _, h in found]


def _scorer(model: Model) -> Scorer | None:
    """One scorer for a worker's copy of a model, so that words stay known between batches."""
    if model.lexicon is not None and not hasattr(model, "scorer"):
        model.scorer = Scorer(model.lexicon)
    return getattr(model, "scorer", None)


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_hits, terms of each row."""

    def run(batch: pa.RecordBatch):
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            score, n, terms = _scores(model, part.column(1))
            yield {"doc_id": part.column(0), "score": score, "n_hits": n, "terms": terms}

    return mapped(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, score double, n_hits long, terms array<string>")


def without_toxic(df: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that score under ``limit``, in one pass and without a shuffle."""
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield part.filter(pa.array([s < limit for s in _scores(model, part.column(at))[0]], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def remainder(n: int):
    """crc32 of an id's decimal text, modulo n."""
    return lambda c: F.crc32(c.cast("string").cast("binary")) % n
