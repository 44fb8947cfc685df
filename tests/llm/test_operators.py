"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from airweave.llm import ann, licenses, media, packing, pieces, quality, simhash, substrings, templates, toxicity

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, key string, source string, fp long"
RNG = np.random.default_rng(5)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB, n))


LONG = prose(6000)
PASSAGE = prose(50)
DOCS = [
    (1, prose(120), "x", "a", 0),
    (2, None, None, None, None),
    (3, "", "x", "a", 0),
    (4, LONG, "x", "a", 0),
    (5, prose(40) + "\n" + PASSAGE + " " + prose(30), "x", "a", 0),
    (6, prose(10) + " " + PASSAGE + "\n" + prose(70), "x", None, 0),
    (7, "copy of a short text", "x", "a", 0),
    (8, "copy of a short text", "x", "a", 0),
    (8, "copy of a short text", "x", "a", 0),
    (None, "no id here, but words éü日本 ▁ \U0001f600\x00 end", "x", "a", 0),
    (9, " \n\t ", "x", "a", 0),
    (10, LONG[: len(LONG) // 2], "x", "a", 0),
    (11, ("again and " * 60).strip(), "x", "a", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return Counter(tuple(r) for r in df.collect())


def sha(b):
    return hashlib.sha256(b).hexdigest()


# Substrings


def brute_substrings(docs, w=35):
    words = [(t or "").encode().split() for _, t, *_ in docs]
    seen = Counter(tuple(x[j : j + w]) for x in words for j in range(len(x) - w + 1))
    out = Counter()
    for (i, *_), x in zip(docs, words, strict=True):
        gone = np.zeros(len(x), bool)
        for j in range(len(x) - w + 1):
            if seen[tuple(x[j : j + w])] > 1:
                gone[j : j + w] = True
        out[(i, len(x), int(gone.sum()), sha(b" ".join(a for a, g in zip(x, gone, strict=True) if not g)))] += 1
    return out


@pytest.mark.parametrize("hot", [1000, 0])
def test_substrings(docs, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    assert by_id(substrings.digests(docs)) == brute_substrings(DOCS)


def test_substrings_random(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["a", "b"], rng.integers(0, 90))), None, None, None) for i in range(60)]
    for w, m in ((6, 3), (35, 8)):
        assert by_id(substrings.digests(spark.createDataFrame(rows, SCHEMA), w, m)) == brute_substrings(rows, w)


def test_substrings_empty_table_and_columns(docs, none):
    assert substrings.digests(none).count() == 0
    kept = substrings.remove_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(DOCS)
    assert kept.where("doc_id = 1").collect()[0]["text"] == DOCS[0][1] and kept.where("doc_id = 2").collect()[0]["text"] is None


# SimHash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 3]), 42) for j in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return Counter((i, f - (1 << 64) * (f >> 63), least.get(root(k))) for k, (i, f) in enumerate(fps))


def test_simhash(docs, none):
    assert by_id(simhash.components(docs)) == brute_components(DOCS)
    assert simhash.components(none).count() == 0
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns
    ids = [r["doc_id"] for r in one.collect()]
    assert ids.count(7) == 1 and 8 not in ids and sorted(i for i in ids if i in (2, 3, 9)) == [2]


@pytest.mark.parametrize("most", [32, 1])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "LIST", most)
    rng = np.random.default_rng(1)
    fps = {0, (1 << 64) - 1}
    for _ in range(15):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        fps.add(x)
        for _ in range(12):
            x ^= 1 << int(rng.integers(0, 64))
            if rng.random() < 0.7:
                x ^= 1 << int(rng.integers(0, 64))
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    got = {r["u"]: r["v"] for r in simhash.stars(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    up = {f: f for f in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = root(signed[i]), root(b - (1 << 64) * (b >> 63))
                up[max(x, y)] = min(x, y)
    assert got == {f: root(f) for f in signed if root(f) != f}


def test_components_of_more_links_than_one_partition_holds(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FOREST", 20)
    rng = np.random.default_rng(4)
    pairs = [tuple(sorted(map(int, p), reverse=True)) for p in rng.integers(-200, 200, (260, 2)) if p[0] != p[1]] + [(1000 + i, 999 + i) for i in range(120)]
    got = {r["u"]: r["v"] for r in simhash.stars(spark.createDataFrame(pairs, "u long, v long").repartition(7)).collect()}
    up = {v: v for p in pairs for v in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in pairs:
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
    assert got == {v: root(v) for v in up if root(v) != v}


def test_entries_tell_shared_bytes():
    """Of positions that agree, 6 hold exactly 3 entries, more hold more, fewer hold one at most."""
    from itertools import combinations

    held = {n: {sum(set(q) <= set(c) for q in simhash.QUADS) for c in combinations(range(8), n)} for n in range(9)}
    assert len(simhash.QUADS) == 14 and held[8] == {14} and held[7] == {7} and held[6] == {simhash.AGREE} and max(held[5]) == 1


def test_long_chain_is_one_component(spark):
    chain = [(1 << k) - 1 for k in range(60)]
    got = simhash.stars(simhash.links(spark.createDataFrame([(f,) for f in chain], "fp long"))).collect()
    assert {r["u"]: r["v"] for r in got} == {f: 0 for f in chain[1:]}


def jaccard(a, b):
    x, y = ({tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("most", [32, 3])
def test_similar_texts_leave_one(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "LIST", most)
    rng = np.random.default_rng(12)
    rows, base = [], []
    for g in range(30):
        words = rng.choice(VOCAB, 300).tolist()
        base.append(g * 100)
        for k in range(1 + g % 12):
            w = list(words)
            for at in rng.integers(0, 300, 3 * (k > 0)):
                w[at] = "changed"
            rows.append((g * 100 + k, " ".join(w), None, None, None))
        half = words[:150] + rng.choice(VOCAB, 150).tolist()
        rows.append((g * 100 + 50, " ".join(half), None, None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    text = {r[0]: r[1] for r in rows}
    assert min(jaccard(text[g * 100], text[g * 100 + k]) for g in range(30) for k in range(1, 1 + g % 12)) > 0.85
    assert max(jaccard(text[g * 100], text[g * 100 + 50]) for g in range(30)) < 0.5
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).collect()) == sorted(base + [b + 50 for b in base])
    assert len(simhash.one_of_each(df, similarity=None).collect()) > 60


def test_rows_of_null_or_repeated_ids_stay(spark):
    rng = np.random.default_rng(15)
    a, b, c, d, e = (prose(80, rng) for _ in range(5))
    near = a.split()
    near[40] = "changed"
    rows = [(None, a), (None, b), (None, c), (5, " ".join(near)), (6, d), (6, e), (7, e), (None, b), (6, d), (8, None), (None, "")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    want = [(None, b), (None, c), (5, " ".join(near)), (6, d), (6, e), (8, None)]
    assert Counter((r["doc_id"], r["text"]) for r in simhash.one_of_each(df).collect()) == Counter(want)


def edited_copies(n, rng):
    """(texts, their sketches, pairs i < j of a Jaccard similarity of 0.8 or more) of one text's copies with 3 to 8 words changed."""
    words = rng.choice(VOCAB, 300).tolist()
    texts = []
    for i in range(n):
        w = list(words)
        for k, at in enumerate(rng.choice(300, rng.integers(3, 9), replace=False)):
            w[at] = f"n{i}x{k}"
        texts.append(" ".join(w))
    ids = {}
    rows = [sorted({ids.setdefault(tuple(s), len(ids)) for s in zip(*(t.split()[k:] for k in range(5)))}) for t in texts]
    has = np.zeros((n, max(map(len, map(set, rows))) + 400), np.float32)
    for i, r in enumerate(rows):
        has[i, [x for x in r if x < has.shape[1]]] = 1  # those of one copy alone are shared by none
    both, sizes = has @ has.T, np.array([len(r) for r in rows])
    return texts, np.argwhere(np.triu(both / (sizes[:, None] + sizes - both) >= 0.8, 1))


def test_long_lists_are_compared_in_full(spark):
    texts, true = edited_copies(2500, np.random.default_rng(14))
    sketches = [simhash.sketch(t.encode()) for t in texts]
    df = spark.createDataFrame(list(enumerate(sketches)), "id long, sk binary")
    got = simhash.candidates(df, 0.8).select("u", "v").collect()
    x = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, simhash.SKETCH)
    runs = x.reshape(len(x), -1, simhash.RUN)
    want = set()
    for i in range(len(x)):
        hit = ((x[:i] == x[i]).sum(1) >= 104) & (runs[:i] == runs[i]).all(2).any(1)
        want |= {(i, j) for j in np.flatnonzero(hit).tolist()}
    assert len(true) > 50_000 and set(map(tuple, got)) == want


def test_similar_texts_are_judged_exactly(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 100)
    texts, true = edited_copies(600, np.random.default_rng(16))
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    rng, far = np.random.default_rng(17), []
    for g in range(60):  # pairs just over and just under 0.8
        words = rng.choice(VOCAB, 300).tolist()
        for k in range(2):
            w = list(words)
            w[20 : 20 + 29 * k] = [f"n{g}x{i}" for i in range((28 + g % 2) * k)] + ["z"] * (k * (1 - g % 2))
            rows.append((1000 + 2 * g + k, " ".join(w), None, None, None))
        far.append(jaccard(rows[-2][1], rows[-1][1]))
    assert min(far) < 0.81 and max(far) > 0.79
    up = list(range(600))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in true.tolist():
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    want = {root(i) for i in range(600)} | {1000 + 2 * g for g in range(60)} | {1001 + 2 * g for g in range(60) if far[g] < 0.8}
    fps = {r[0]: simhash.fingerprint(r[1].encode()) for r in rows}
    df = spark.createDataFrame([r for r in rows], SCHEMA)
    classes = [(r[0], simhash.sketch(r[1].encode()), len(r[1].split())) for r in rows]
    frame = spark.createDataFrame(classes, "id long, sk binary, size long")
    texts_of = lambda ids: df.select(F.col("doc_id").alias("id"), "text").join(ids, "id")
    near = {r["u"] for r in simhash.stars(simhash.similar_links(frame, texts_of)).collect()}
    assert {r[0] for r in rows} - near == want


def test_sketch_agrees_as_often_as_texts_do():
    rng = np.random.default_rng(13)
    w = rng.choice(VOCAB, 4000).tolist()
    v = list(w)
    for at in range(0, 4000, 100):
        v[at] = "x"
    share = np.mean(np.frombuffer(simhash.sketch(" ".join(w).encode()), np.uint8) == np.frombuffer(simhash.sketch(" ".join(v).encode()), np.uint8))
    assert abs(share - jaccard(" ".join(w), " ".join(v))) < 0.1
    assert simhash.sketch(b"") == simhash.sketch(b" \n") and simhash.sketch(b"a b") != simhash.sketch(b"a c")


# Pieces


def test_pieces(docs, none):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter()
    for i, t, *_ in DOCS:
        ids = sp.encode(t or "")
        want[(i, len(ids), sha(",".join(map(str, ids)).encode()), sha(sp.decode(ids).encode()))] += 1
    assert by_id(pieces.digests(docs, path)) == want
    assert pieces.digests(none, path).count() == 0
    r = pieces.encode_decode(docs.where("doc_id = 7"), path).collect()[0]
    assert r["decoded"] == "copy of a short text" and r["ids"] == ",".join(map(str, sp.encode(r["decoded"])))


def test_pieces_on_odd_texts():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), pieces.model(path)
    rng = np.random.default_rng(2)
    odd = [" ", "   a  b ", "\n\n x", "▁▁x ▁", " " * 40 + "b", " " * 17 + "\n", "a" * 50, "<s> </s>", "́é", "ＡＢ", "İ ﬁ"]
    alphabet = list("abcdefghiABCÄöüßéñ0123456789 .,!?-_\n\t ▁中文字한ʒΩ")
    odd += ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(1500)]
    for x in odd:
        ids = sp.encode(x)
        assert m.encode(x) == ids and m.decode(ids) == sp.decode(ids) == m.decode_joined(",".join(map(str, ids))), x
    for ids in ([3 + 0xE3], [3 + 0xF0, 3 + 0x9F, 264], [1, 264, 2], [0, 264]):
        assert m.decode(ids) == sp.decode(ids)


def test_compatibility_is_remerging():
    m = pieces.model(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(3)
    short = [i for i in m.ordered if len(m.text[i]) <= 3]
    for a, b in rng.choice(short, (4000, 2)).tolist():
        assert m.remerged(a, b) == (m.merge(m.text[a] + m.text[b]) == [a, b])


# Packing


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path, size = P.path("byte_bpe_50k.json"), 256
    t = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, size).toPandas()
    want = Counter()
    for i, text, *_ in DOCS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for start in range(0, len(ids), size):
            one = ids[start : start + size]
            want[(i if i is not None else -1, start, len(one), zlib.crc32(one.tobytes()), len(ids))] += 1
    got = rows.fillna({"doc_id": -1})
    assert Counter(map(tuple, got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].astype(int).values.tolist())) == want
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.r_[0, np.cumsum(s.length)[:-1]]).all() and s.length.sum() <= size
    assert packing.pack(none, path).count() == 0


def test_long_runs():
    """Millions of blanks, and texts without any, as the library cuts them."""
    t = packing.tokenizer(P.path("byte_bpe_50k.json"))
    for x in (" " * 2_000_000 + "a", "\n" * 1_000_000 + "a", "x" + " " * 1_200_000, "b " + "\t" * 200_000 + " c\n" + " " * 120_000 + "é!", "ab" * 2_500_000, "\x85" * 150_000 + "\x1c" * 150_000 + " z"):
        assert t.ids(x).tolist() == t.own.encode(x, add_special_tokens=False).ids


def test_other_ways_of_splitting_are_refused():
    with pytest.raises(ValueError):
        packing.ByteTokenizer(P.path("word_bpe_49k.json"))


def test_special_strings_follow_the_file():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    for x in ("a <|endoftext|> b", "plain", "don't 123 \n\n  x "):
        assert packing.tokenizer(path).ids(x).tolist() == Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids


def test_patterns_hold_every_piece():
    rng = np.random.default_rng(0)
    h = {int(k): int(v) for k, v in zip(*np.unique(np.r_[rng.integers(1, 1025, 5000), np.full(900, 1024)], return_counts=True), strict=True)}
    found = packing.patterns(h, 1024)
    held = Counter()
    for n, lengths in found:
        assert sum(lengths) <= 1024
        for k in lengths:
            held[k] += n
    assert held == h
    used, packs = sum(k * v for k, v in h.items()), sum(n for n, _ in found)
    assert used / (packs * 1024) > 0.97


# Media


def test_media(docs, none):
    rows = media.media_of_documents(docs).collect()
    want = Counter()
    for i, t, *_ in DOCS:
        b = (t or "").encode()
        p = b + b"\0" * (-len(b) % 64 if b else 64)
        want[(i, len(b), len(p), sha(p), zlib.crc32(p[-64:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    assert media.media_of_documents(none).count() == 0


def test_stored_forms(docs):
    """The stored form's digest, size and feature by plain recomputation; equal texts, equal values."""
    for r in media.media_of_documents(docs).collect():
        text = next((t or "").encode() for i, t, *_ in DOCS if i == r["doc_id"])
        samples = np.frombuffer(text + b"\0" * (-len(text) % 64 if text else 64), np.uint8).reshape(-1, 64)
        png = media.to_png(samples.tobytes())
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), sha(png))
        size, span, total, bins = r["feature"].split(";")
        assert size == f"64x{len(samples)}" and span == f"{samples.min()}..{samples.max()}" and total == f"sum={samples.sum(dtype=np.int64)}"
        assert bins == "hist=" + ",".join(str(int(((samples >= 16 * k) & (samples < 16 * k + 16)).sum())) for k in range(16))


def test_captions_of_pages(spark):
    html = """<p>a</p><figure><figcaption>first</figcaption><img src="media:x1"><img src="media:x2" alt="no"></figure><p>b</p>
    <figure><img src="media:x3" alt="own"></figure><img src="media:x4" alt="out"><figure><video src="media:x5"></video><figcaption>last</figcaption></figure>
    <figure><img src="media:x6"><figcaption>open</figcaption>"""
    df = spark.createDataFrame([(1, html, "t", "c"), (1, html, "t", "c"), (None, None, "t", "c")], "page_id long, html string, digest string, caption string")
    seqs = media.sequences(df)
    facts = spark.createDataFrame([(f"x{i}", i, "other") for i in (1, 1, 3, 5)], "digest string, payload_bytes long, feature string")
    got = Counter((r["page_id"], r["digest"], r["caption"], r["payload_bytes"]) for r in media.resolve(seqs, facts, "page_id").collect())
    assert got == Counter({(1, "x1", "first", 1): 2, (1, "x2", "first", None): 2, (1, "x3", "own", 3): 2, (1, "x4", "out", None): 2, (1, "x5", "last", 5): 2, (1, "x6", "open", None): 2})
    kinds = [x["kind"][0] for x in next(r["sequence"] for r in seqs.collect() if r["page_id"] == 1)]
    assert "".join(kinds) == "tmmtmmmm"


def test_png_round_trip():
    for n in (64, 640, 64 * 1000):
        x = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
        assert media.from_png(media.to_png(x)).tobytes() == x
    bad = bytearray(media.to_png(b"\1" * 64))
    bad[50] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(bad))


def test_sequences_keep_order_and_captions(spark):
    html = '<html><head><title>t</title></head><body><p>One <b>two</b></p><img src="media:aa" alt="first"><p>three</p><figure><img src="media:bb"><figcaption>the <i>second</i></figcaption></figure>tail<script>no</script></body></html>'
    df = spark.createDataFrame([(1, html, "x"), (2, None, "x"), (3, "", "x"), (4, "plain", "x")], "page_id long, html string, ref string")
    got = {r["page_id"]: [(x["position"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in r["sequence"]] for r in media.sequences(df).collect()}
    assert got[1] == [(0, "text", "One two", None), (1, "media", "aa", "first"), (2, "text", "three", None), (3, "media", "bb", "the second"), (4, "text", "tail", None)]
    assert got[2] == got[3] == [] and got[4] == [(0, "text", "plain", None)]
    facts = spark.createDataFrame([("bb", 7), ("bb", 7)], "digest string, payload_bytes long")
    rows = sorted(tuple(r) for r in media.resolve(media.sequences(df), facts, "page_id").select("page_id", "position", "caption", "payload_bytes").collect())
    assert rows == [(1, 1, "first", None), (1, 3, "the second", 7)]


# Licences


def test_licenses(spark, docs, none):
    changed = "Copyright (c) 2020 Someone\n\n" + licenses.MIT.split("\n", 2)[2].upper().replace('"', "“").replace("SUBLICENSE", "sub-licence")
    rows = [(1, licenses.MIT, None, None, None), (2, changed, None, None, None), (3, licenses.MIT + " And more.", None, None, None), (4, licenses.BSD3.replace("\n", "\r\n "), None, None, None), (5, "x\nLicenced under the Apache Licence, version 2.0\ny\nReleased under the MIT License.", None, None, None)]
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: ("BSD-3-Clause", ""), 5: (None, "Apache-2.0,MIT")}
    assert licenses.scan(docs).where("license_id IS NOT NULL").count() == 0 and licenses.scan(docs).count() == len(DOCS)
    assert licenses.scan(none).count() == 0
    for text in (*licenses.LICENSES.values(), changed):
        assert spark.createDataFrame([(text,)], "t string").select(licenses.canonical(F.col("t"))).collect()[0][0] == licenses._plain_canonical(text)


def test_known_texts(spark):
    """Every built-in text is found under its own id, in upper case and other line breaks; a table of one's own replaces them."""
    texts = licenses.known_texts()
    assert len({k for k, _ in texts}) >= 20
    rows = [(i, f"Copyright Jane Doe 2020\n{t}".upper().replace("\n", "\r\n"), None, None, None) for i, (_, t) in enumerate(texts)]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: k for i, (k, _) in enumerate(texts)}
    lines = ["Copyright Jane Doe 2020", "Copyright OpenJS Foundation and other contributors", "(c) 2019 X", "Copyright (c) A, Inc."]
    own = spark.createDataFrame([("Own", "Do as you like.", 1), ("Other", "Do as you like", 2), ("Void", None, 3)], "license_id string, text string, notices int")
    rows = [(i, f"{x}\n\nDo as you LIKE.", None, None, None) for i, x in enumerate(lines)] + [(8, licenses.MIT, None, None, None), (9, "copyright holders do as you like", None, None, None), (9, "Do as you like " * 100_000, None, None, None)]
    got = Counter((r["doc_id"], r["license_id"]) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA), own).collect())
    assert got == Counter({(0, "Other"): 1, (1, "Other"): 1, (2, "Other"): 1, (3, "Other"): 1, (8, None): 1, (9, None): 2})


# Line templates


def test_templates(spark, none):
    common = ["Posted by Anna on Monday 12", "Read more"]
    rows = [(i, f"own line {chr(97 + i)} of text here\n{common[0].replace('12', str(i))}\n\n{common[1]}\nuser{i} said something long enough to be kept as tail words {chr(110 + i)}", None, None, None) for i in range(5)]
    rows += [(9, "Read more", None, None, None), (None, None, None, None, None), (10, "twice\ntwice\ntwice\ntwice\ntwice\ntwice", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in templates.digests(df, docs=5).collect()}
    # "own line a of text here" to "own line e of text here" differ in one field: a template as well
    assert got == {**{i: (5, 4) for i in range(5)}, 9: (1, 1), None: (0, 0), 10: (6, 0)}
    kept = templates.drop_recurring(df, docs=5, keep_first=True)
    assert kept.columns == df.columns
    text = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert sum("Read more" in (t or "") for t in text.values()) == 1 and text[None] is None
    copies = spark.createDataFrame([(i, "same text\nin all", None, None, None) for i in range(9)], SCHEMA)
    assert templates.digests(copies, docs=2).where("n_dropped > 0").count() == 0
    assert templates.digests(none).count() == 0


def brute_lines(texts, docs=5, lead=2):
    """Text -> numbers of its lines that go, with templates as lists of tokens."""
    cut = {}
    for t in texts:
        for i, line in enumerate(t.split("\n") if t else []):
            w = tuple("<*>" if any(c in "0123456789" for c in x) else x for x in line.encode().decode("latin-1").split(" ") if x)
            if w:
                cut[t, i] = w
    leaf = {w: (len(w), w[: min(lead, (len(w) - 1) // 2)]) for w in cut.values()}
    having = {w: len({t for (t, _), x in cut.items() if x == w}) for w in leaf}
    total = Counter()
    kinds = Counter(leaf.values())
    for w in leaf:
        total[leaf[w]] += having[w]
    at = Counter()
    for w in leaf:
        x, n = leaf[w], having[w]
        at.update({(x, i, a): n for i, a in enumerate(w)})
    merged = {}
    for w, x in leaf.items():
        merged[w] = set()
        for rare in (10, 2):
            if total[x] >= docs and kinds[x] > 1:
                m = tuple(a if a != "<*>" and at[x, i, a] >= docs and at[x, i, a] * rare >= total[x] else None for i, a in enumerate(w))
                if 5 * sum(a is not None for a in m) >= 3 * len(m):
                    merged[w].add((x, m))
    often = Counter(m for _, m in {(t, m) for (t, _), w in cut.items() for m in merged[w]})
    out = {t: set() for t in texts}
    for (t, i), w in cut.items():
        if having[w] >= docs or any(often[m] >= docs for m in merged[w]):
            out[t].add(i)
    return out


@pytest.mark.parametrize("piece, held", [(templates.PIECE, templates.HELD), (20, templates.HELD), (templates.PIECE, 100)])
def test_template_tree(spark, monkeypatch, piece, held):
    monkeypatch.setattr(templates, "PIECE", piece)
    monkeypatch.setattr(templates, "HELD", held)
    assert templates.tokens_of(b"  ") == [] and templates.tokens_of(b"a b1 c") == [b"a", b"<*>", b"c"]
    assert templates.leaf_of([b"a", b"b", b"c", b"d", b"e"], 2) == b"5|a b" and templates.leaf_of([b"a", b"b", b"c", b"d"], 2) == b"4|a"
    rng = np.random.default_rng(21)
    names = ["Anna", "Bob", "Cleo", "Dan", "Eve", "Finn", "Gus", "Hal", "Ida", "Jo", "Kim", "Lea"]
    rows = []
    for i in range(200):
        plain = lambda n: prose(n, rng).translate(str.maketrans("0123456789", "abcdefghij"))
        lines = [plain(int(rng.integers(3, 30))) for _ in range(3)] + [f"opening words {plain(8)}"]
        if i % 3 == 0:
            lines.insert(1, f"Posted by {rng.choice(names)} in {rng.choice(['Travel', 'Sport', 'Art', 'Law'])}")
            lines.insert(0, f"User {rng.choice(names)} logged in")
        if i % 4 == 0:
            lines.append(f"Written by {rng.choice(names)} {rng.choice(names)} for the Daily on {rng.choice(['Monday', 'Friday'])}")
        if i % 50 == 0:
            lines.append(f"{plain(40)} only {i}")
        rows.append((i, "\n".join(lines), None, None, None))
    rows += [(900 + i, rows[i % 5][1], None, None, None) for i in range(20)] + [(None, None, "x", None, None), (None, "", None, None, None), (990, " ".join(["long"] * 50_000), None, None, None)]
    want = brute_lines({r[1] or "" for r in rows})
    got = templates.digests(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in got) == Counter((r[0], len(r[1].split("\n")) if r[1] else 0, len(want[r[1] or ""])) for r in rows)
    gone = [t.split("\n")[i] for t, x in want.items() for i in x]
    assert sum(x.startswith("Posted") for x in gone) == sum(x.startswith("User") for x in gone) == 67 and sum(x.startswith("Written") for x in gone) == 50
    assert not any(x.startswith("opening") or len(x.split()) > 12 for x in gone)  # prose with a common opening stays


def test_names_that_clash(spark):
    """Columns called like the operators' own keep their values."""
    names = ["key", "kept", "_mark", "n_removed", "lines", "first", "digest", "row", "runs", "whole", "merged", "doc_id", "text"]
    rows = [tuple(f"{n}{i}" for n in names[:-2]) + (i, f"{PASSAGE}\nRead more\n{prose(20)}") for i in range(6)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names[:-2]) + ", doc_id long, text string")
    for out in (substrings.remove_repeats(df), templates.drop_recurring(df), simhash.one_of_each(df)):
        got = out.collect()
        assert out.columns == names and len(got) == 6
        assert {tuple(r)[:-1] for r in got} == {r[:-1] for r in rows}


# Toxicity


def test_lexicon_matches_brute_force():
    rng = np.random.default_rng(4)
    words = ["stupid", "moron", "clown", "worthless", "abcde"]
    lex = toxicity.Lexicon(words, ["lowei"])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for _ in range(3000):
        w = list(str(rng.choice(words + ["loweixyz"])))
        for _ in range(rng.integers(0, 3)):
            k = int(rng.integers(0, len(w)))
            w[k : k + int(rng.integers(0, 2))] = list(str(rng.choice(list("abcdexyz"))))
        w = "".join(w)
        near = {t for t in words if distance(w, t) <= 1} | ({"lowei*"} if any(distance(w[:k], "lowei") <= 1 for k in range(4, 7)) else set())
        if 4 <= len(w) <= 40:
            got = lex.near(w)
            assert (got in near) if near else got is None, w


def test_quotation_weighs_less():
    s = toxicity.Scorer(toxicity.Lexicon(["moron"], []))
    plain, quoted, aimed = (s.hits(x)[1][0][2] for x in ("what a moron indeed", 'he used the word "moron" once', "you are a moron"))
    assert quoted < plain < aimed
    assert s.hits("a morron here")[1][0][:2] == ("moron", True)


def labelled(spark):
    rng = np.random.default_rng(6)
    bad = ["stupid", "moron", "worthless"]
    rows = []
    for i in range(300):
        w = list(rng.choice(VOCAB, 40))
        if i % 4 == 0:
            w[3], w[20] = rng.choice(bad), rng.choice(bad)
        rows.append((i, " ".join(w), None, None, None))
    rows += [(900, "some morron w1 and stupidd w2", None, None, None), (901, "", None, None, None), (902, None, None, None, None), (None, "moron moron", None, None, None), (903, LONG, None, None, None)]
    labels = [(i, int(i % 7 > 0), int(i % 4 == 0)) for i in range(300)] + [(5, None, None), (8, 1, 1), (8, 1, 1), (None, 1, 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, none):
    df, labels = labelled(spark)
    fifth = toxicity.remainder(5)
    model = toxicity.fit(df, labels, "toxic", lambda c: fifth(c) == 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(df, model).collect()}
    wrong = sum((got[i] >= 0.5) != (i % 4 == 0) for i in range(300))
    assert wrong <= 3 and got[900] >= 0.5 and got[None] >= 0.5 and max(got[901], got[902], got[903]) < 0.5 and got[901] == got[902]
    clean = toxicity.without_toxic(df, model)
    assert clean.columns == df.columns and clean.count() == sum(v < 0.5 for v in got.values())
    assert toxicity.scored(none, model).count() == 0
    for lab, share in ((labels.where("toxic = 1"), 1.0), (labels.limit(0), 0.0)):
        m = toxicity.fit(df, lab, "toxic", lambda c: F.lit(False))
        assert {r["score"] for r in toxicity.scored(df, m).collect()} == {share}
    assert zlib.crc32(b"7") % 5 == spark.range(7, 8).select(fifth(F.col("id"))).collect()[0][0]


# Quality


def test_quality(spark, none):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(400):
        if i % 5 == 0:
            w = str(rng.choice(VOCAB)).upper()
            text = " ".join([w + "!!"] * int(rng.integers(20, 80)))
        else:
            text = prose(int(rng.integers(30, 120)), rng)
        rows.append((i, text, None, None, None))
        labels.append((i, int(i % 5 > 0), 0))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (None, "x", None, None, None), (902, LONG, None, None, None), (902, LONG, None, None, None)]
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(3, None, 0)], "doc_id long, quality int, toxic int")
    third = toxicity.remainder(3)
    got = quality.classify(df, lab, lambda c: third(c) == 1).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out & (got.doc_id < 400)]
    assert len(held) > 80 and ((held.doc_id % 5 > 0) == (held.predicted == 1)).mean() > 0.97
    assert got[got.doc_id == 900].score.iloc[0] == got[got.doc_id == 901].score.iloc[0]
    assert quality.classify(none, lab, lambda c: third(c) == 1).count() == 0
    assert set(quality.classify(df, lab.limit(0), lambda c: third(c) == 1).toPandas().score) == {0.5}


def test_isotonic():
    y, w = np.array([0.0, 1.0, 0.5, 0.5, 0.2, 1.0]), np.ones(6)
    got = quality.isotonic(y, w)
    assert (np.diff(got) >= 0).all() and abs(got.sum() - y.sum()) < 1e-12 and np.allclose(got[1:5], 0.55)


def test_statistics_names():
    assert len(quality.stats(b"A b, c!\nD")) == len(quality.stats(b"")) == len(quality.STATS)


# Nearest neighbours


def vectors(spark, n=600, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    rows = [(i, [float(v) for v in r], i % 3, 1.0) for i, r in enumerate(x)]
    same = [float(v) for v in x[0]]
    rows += [(1000 + i, same, 0, 1.0) for i in range(60)] + [(20, rows[20][1], 0, 1.0)]
    rows += [(2000, None, 0, 1.0), (2020, [0.0] * dim, 0, 1.0), (2040, [float("nan")] + same[1:], 0, 1.0), (2060, [None] + same[1:], 0, 1.0), (2080, same[:3], 0, 1.0), (2100, [float("inf")] + same[1:], 0, 1.0), (None, same, 0, 1.0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")


@pytest.mark.parametrize("unit", [False, True])
def test_neighbours(spark, unit):
    df = vectors(spark)
    if unit:
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        df = df.withColumn("embedding", F.transform("embedding", lambda x: F.when(norm == 0, x).otherwise((x / norm).cast("float"))))
    got = ann.nearest(df, lambda i: i % 20 == 0, 20).toPandas()
    ok = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in df.collect() if r["vec_id"] is not None and (r["vec_id"] < 2000)}
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    hit = total = 0
    for q, g in got.groupby("query_id"):
        s = (x * ok[q]).sum(1)
        s[ids == q] = -np.inf
        top = ids[np.lexsort((ids, -s))[:20]]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and q not in set(g.vec_id) and len(set(g.vec_id)) == len(g)
        assert np.allclose(g.score, [ok[v] @ ok[q] for v in g.vec_id], rtol=0, atol=1e-12)
        order = np.lexsort((g.vec_id, -g.score))
        assert (order == np.arange(len(g))).all()
        hit, total = hit + len(set(top) & set(g.vec_id)), total + 20
    assert set(got.query_id) == {int(i) for i in ids if i % 20 == 0} and hit / total >= 0.9
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist()[:20] == list(range(1000, 1020))


def test_ties_and_double_vectors(spark):
    """Equal scores from different vectors go to the smaller ids; scores are those of the doubles given."""
    rng = np.random.default_rng(3)
    q = [1.0] + [0.0] * 7
    rows = [(0, q)] + [(100 + i, [0.5, *map(float, rng.normal(size=7))]) for i in range(300)]
    rows += [(1000, [0.1, 0.2] + [0.0] * 6), (1020, [0.3, 0.7] + [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    got = ann.nearest(df, lambda i: i % 20 == 0, 20, recall=1.0).toPandas()
    for i in (0, 1000, 1020):
        s = (x * x[ids == i]).sum(1)
        top = [k for k in np.lexsort((ids, -s)) if ids[k] != i][:20]
        mine = got[got.query_id == i].sort_values("rank")
        assert mine.vec_id.tolist() == ids[top].tolist() and np.abs(mine.score.to_numpy() - s[top]).max() < 1e-15


@pytest.mark.parametrize("hashes", [1, 2])
def test_recall_by_rotations(spark, hashes):
    rng = np.random.default_rng(hashes)
    x = rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, lambda i: i % 20 == 0, 20, hashes=hashes).groupBy("query_id").agg(F.collect_list("vec_id").alias("v")).collect()
    hit = sum(len(set(r["v"]) & set(np.argsort(-np.where(np.arange(3000) == r["query_id"], -np.inf, x @ x[r["query_id"]]))[:20].tolist())) for r in got)
    assert len(got) == 150 and hit / 3000 >= 0.9


def test_few_and_no_vectors(spark):
    df = vectors(spark)
    few = ann.nearest(df.where("vec_id IN (0, 1, 2)"), lambda i: i % 20 == 0, 20)
    assert [r["vec_id"] for r in few.orderBy("rank").collect()] in ([1, 2], [2, 1])
    assert ann.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 1"), lambda i: i % 20 == 0).count() == 0


def test_hadamard_keeps_norms():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    two = ann.CrossPolytope(16, 2, 2, 1)
    u = two.unit(x[:, :16], True)
    assert (two.ranked(u, 0)[:, 0] == two.axes(u, 0)).all()
