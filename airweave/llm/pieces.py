"""SentencePiece (merge type) encoding by backtracking, and decoding.

Pieces never continue past a word mark, so a text is cut before each word mark
and each such word is encoded once and remembered. Within a word an Aho-Corasick
automaton gives the longest piece at each position; the encoder takes it, checks
that it is compatible with the piece before it, and else falls to the next
shorter piece, or steps back. Positions from which no way leads on are marked in
a bitfield. Two neighbours are compatible when merging their joint text anew
gives just these two pieces.

Defined cases: null counts as empty; an empty text has no ids and decodes to an
empty text; characters outside the vocabulary become byte pieces; runs of word
marks, whose merges all tie, are merged directly.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airweave.llm.common import mapped

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words that a worker remembers in each of two generations, and pairs whose compatibility it remembers.
WORDS, PAIRS = 600_000, 500_000


class PieceModel:
    """The pieces of a model file and the encoder over them. One per worker and path."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = [0] * 256
        self.ids, self.rank, self.byte_of = {}, {}, {}
        for i, piece in enumerate(self.text):
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.rank[piece] = -sp.get_score(i)
        self.special = {i: " \u2047 " if sp.is_unknown(i) else "" for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.number = [str(i) for i in range(n)]
        self.alone = {p for p in self.ids if len(p) == 1}
        if any(MARK in p.lstrip(MARK) or (p[:2] == MARK * 2 and p.strip(MARK)) for p in self.ids) or any(c not in self.alone for p in self.ids for c in p):
            raise ValueError("this model joins words or lacks single characters; words cannot be encoded apart")
        self.automaton = ahocorasick.Automaton()
        self.size, self.shorter = {}, {}
        whole = {p: i for p, i in self.ids.items() if p.strip(MARK) or len(p) == 1}
        whole = {p: i for p, i in whole.items() if len(p) == 1 or self.merge(p) == [i]}  # the rest is never reached by merges
        self.split, self.ordered = {}, {}
        for p, i in whole.items():
            trace: list = []
            self.merge(p, trace)
            if trace:
                self.split[p] = trace[-1][1:]
            ranks = [x[0] for x in trace]
            self.ordered[i] = all(x < y for x, y in zip(ranks, ranks[1:], strict=False)) or all(self.rank[p] > self.rank[h] for h in self.split[p] if len(h) > 1)
        for p in sorted(self.split, key=len):
            self.ordered[whole[p]] &= all(self.ordered.get(whole.get(h), False) for h in self.split[p])
        for p, i in whole.items():
            self.automaton.add_word(p, (i, len(p)))
            self.size[i] = len(p)
        for p, i in whole.items():
            self.shorter[i] = next((whole[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in whole), None)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.plain = {str(i): p.replace(MARK, " ") for p, i in self.ids.items()} | {str(i): chr(b) for i, b in self.byte_of.items() if b < 128}
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def merge(self, text: str, trace: list | None = None) -> list[int]:
        """Merge from single characters: always the best-scored pair, leftmost on ties.

        ``trace`` gets each merge as (rank, left text, right text)."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(i, j):
            if i >= 0 and j >= 0 and (joint := parts[i] + parts[j]) in self.ids:
                heapq.heappush(heap, (self.rank[joint], i, joint))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, joint = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else -1
            if j < 0 or parts[i] + parts[j] != joint:
                continue
            if trace is not None:
                trace.append((self.rank[joint], parts[i], parts[j]))
            parts[i], parts[j], right[i] = joint, None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [self.ids[p] for p in parts if p is not None]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            got = self.fits[key] = self.remerged(a, b)
        return got

    def remerged(self, a: int, b: int) -> bool:
        """Whether merging the joint text of two pieces gives these two.

        Their merges are undone latest first. At each state of the border the two
        pieces there must not join before the merge that was just undone; a tie
        goes to the left. Pieces whose own merges don't come in order of rank are
        merged from characters instead.
        """
        if not (self.ordered[a] and self.ordered[b]):
            return self.merge(self.text[a] + self.text[b]) == [a, b]
        rank, split = self.rank, self.split
        x, y = self.text[a], self.text[b]
        limit = float("inf")
        while True:
            joint = rank.get(x + y)
            if joint is not None and joint < limit:
                return False
            p, q = rank[x] if len(x) > 1 else -1, rank[y] if len(y) > 1 else -1
            if p < 0 and q < 0:
                return True
            if p > q:
                limit, x = p, split[x][1]
            else:
                limit, y = q + 0.5, split[y][0]

    def backtrack(self, word: str) -> list[int]:
        """Ids of ``word``, all of whose characters are pieces."""
        longest: list[int] = [0] * len(word)
        for end, (i, n) in self.automaton.iter(word):
            longest[end - n + 1] = i
        size, shorter, fits, text_end = self.size, self.shorter, self.fits, len(word)
        failed = 0  # bit p: no encoding goes on from p
        out: list[int] = []
        at, piece = 0, longest[0]
        while True:
            end = at + size[piece]
            good = not failed >> end & 1
            if good and out:
                good = fits.get(out[-1] << 20 | piece)
                if good is None:
                    good = self.compatible(out[-1], piece)
            if good:
                out.append(piece)
                at = end
                if at == text_end:
                    return out
                piece = longest[at]
                continue
            nxt = shorter[piece]
            while nxt is None:
                failed |= 1 << at
                last = out.pop()
                at -= size[last]
                nxt = shorter[last]
            piece = nxt

    def encode_word(self, word: str) -> list[int]:
        """Ids of a run of word marks and what follows up to the next one."""
        body = word.lstrip(MARK)
        marks = len(word) - len(body)
        out: list[int] = []
        if body and marks:
            body, marks = MARK + body, marks - 1
        for part in self._split(body):
            if part[0] in self.alone:
                out += self.backtrack(part)
            else:
                out += [self.bytes[x] for x in part.encode("utf-8", "surrogatepass")]
        if marks:
            if out and out[0] == self.ids[MARK]:
                marks, out = marks + 1, out[1:]
            out = self.merge(MARK * marks) + out
        return out

    def _split(self, body: str):
        if self.alone.issuperset(body):
            return [body] if body else []
        out, start = [], 0
        for i, c in enumerate(body):
            if c not in self.alone:
                if start < i:
                    out.append(body[start:i])
                out.append(c)
                start = i + 1
        return out + ([body[start:]] if start < len(body) else [])

    def known(self, word: str) -> str:
        """Comma-joined ids of a word, remembered."""
        got = self.new.get(word)
        if got is not None:
            return got
        got = self.old.get(word)
        if got is None:
            number = self.number
            got = ",".join([number[i] for i in self.encode_word(word)])
        if len(word) < 64:
            if len(self.new) >= WORDS:
                self.old, self.new = self.new, {}
            self.new[word] = got
        return got

    def encode_joined(self, text: str) -> str:
        """Comma-joined ids of a text."""
        seen, known = self.new.get, self.known
        return ",".join([seen(w) or known(w) for w in self.words(text)])

    def decode_joined(self, ids: str) -> str:
        """What comma-joined ids decode to. Lone bytes beyond ASCII take the general way."""
        if not ids:
            return ""
        try:
            text = "".join(map(self.plain.__getitem__, ids.split(",")))
        except KeyError:
            return self.decode([int(i) for i in ids.split(",")])
        return text[1:] if text[0] == " " else text

    def words(self, text: str) -> list[str]:
        return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in self.encode_word(w)]

    def decode_pieces(self, ids: list[int]) -> str:
        """Text of ids, with the leading space still there."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_from_bytes(bytes(held)))
                held.clear()
            out.append(self.special[i] if i in self.special else self.text[i].replace(MARK, " "))
        if held:
            out.append(_from_bytes(bytes(held)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_pieces(ids)
        return text[1:] if text[:1] == " " and ids[0] != 0 else text


def _from_bytes(held: bytes) -> str:
    """UTF-8, with one replacement character for each byte that is part of no character."""
    out = []
    while held:
        try:
            return "".join(out) + held.decode()
        except UnicodeDecodeError as e:
            out.append(held[: e.start].decode() + "�")
            held = held[e.start + 1 :]
    return "".join(out)


@lru_cache(4)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids as comma-joined text, n_tokens, decoded text) of each row."""
    return _run(df, path, id_col, text_col, False)


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_decode`, with SHA-256 in place of ids and decoded text."""
    return _run(df, path, id_col, text_col, True)


def _run(df, path, id_col, text_col, digest):
    def run(batch: pa.RecordBatch):
        m = model(path)
        ids, ns, shas, texts = [], [], [], []
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            joined = m.encode_joined(text.as_py() or "")
            decoded = m.decode_joined(joined)
            ids.append(key.as_py())
            ns.append(joined.count(",") + 1 if joined else 0)
            shas.append(hashlib.sha256(joined.encode()).hexdigest() if digest else joined)
            texts.append(hashlib.sha256(decoded.encode()).hexdigest() if digest else decoded)
            if len(ids) == 512:
                yield {"doc_id": ids, "n_tokens": ns, a: shas, b: texts}
                ids, ns, shas, texts = [], [], [], []
        if ids:
            yield {"doc_id": ids, "n_tokens": ns, a: shas, b: texts}

    a, b = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    return mapped(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, f"doc_id long, n_tokens long, {a} string, {b} string")
