"""The pipeline's stages on a small corpus, against what brute force keeps."""

import numpy as np
import pytest

import corpus_pipeline
from airweave.llm import simhash

pytest.importorskip("public_tokenizers")


def corpus(spark, path):
    rng = np.random.default_rng(3)
    vocab = [f"v{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    text = lambda n: "\n".join(" ".join(rng.choice(vocab, 12)) for _ in range(n))
    passage = " ".join(rng.choice(vocab, 60))
    rows = []
    for i in range(120):
        t = text(6)
        if i % 6 == 0:
            t = t.replace(" ", " stupid ", 1) + " moron"
        if i % 10 == 1:
            t += "\n" + passage
        if i % 3 == 1:
            t += "\nShare this page now"
        rows.append((i, t, "en", "s", len(t)))
    rows += [(200 + i, rows[2][1], "en", "s", 1) for i in range(4)] + [(300, None, "en", "s", 0), (301, "", None, None, None)]
    near = rows[4][1].split(" ")
    near[1] = "changed"
    rows.append((400, " ".join(near), "en", "s", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        out = f"{tmp_path}/{name}"
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        seen.append(docs)
        assert name == "packing" or docs.columns == columns
    toxic, lines, near, cut, packed = seen
    assert {r["doc_id"] for r in toxic.select("doc_id").collect()} == {r[0] for r in rows if not (r[0] < 120 and r[0] % 6 == 0)}
    assert lines.count() == toxic.count() and lines.where("text LIKE '%Share this page now%'").count() == 1
    text = {r["doc_id"]: r["text"] for r in near.collect()}
    left = {i: t for i, t in ((r["doc_id"], r["text"]) for r in lines.collect())}
    fps = {i: simhash.fingerprint((t or "").encode()) for i, t in left.items()}
    kept = {i for i in left if not any(j < i and (fps[i] ^ fps[j]).bit_count() <= 2 for j in left)}
    assert set(text) == kept - {400} and 2 in kept and not {200, 201, 202, 203} & kept
    assert cut.count() == near.count()
    words = {r["doc_id"]: (r["text"] or "").split() for r in cut.collect()}
    assert all(words[i] == (text[i] or "").split() for i in text if i % 10 != 1 or i > 120)
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).collect()[0][0] <= 1024
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(text)
    run = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, run.select(key).collect())) == sorted(map(tuple, packed.select(key).collect()))


def test_no_labels_or_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
