"""The pipeline's stages one after the other, each judged on its own input."""
import collections

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from cartwalk.llm import decontaminate, quality, simhash

SF = "/root/testdata/sf0.001"


def _removed(texts, size=35):
    w = {k: t.split() for k, t in texts.items()}
    n = collections.Counter(tuple(x[i:i + size]) for x in w.values() for i in range(len(x) - size + 1))
    out = {}
    for k, x in w.items():
        gone = {i + j for i in range(len(x) - size + 1) if n[tuple(x[i:i + size])] > 1 for j in range(size)}
        out[k] = [v for i, v in enumerate(x) if i not in gone], len(gone)
    return out


def test_stages(spark):
    from tokenizers import Tokenizer
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "BPE encoding and decoding"]
    base = spark.conf.get("spark.checkpoint.dir")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, outs = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{base}/stage-{k}"
        stage(spark, outs[-1], SF).write.mode("overwrite").parquet(path)
        outs.append(spark.read.parquet(path))
    assert all(o.columns == columns for o in outs[:-1])

    rows = [{r["doc_id"]: r for r in o.collect()} for o in outs]
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality_digest(docs).collect()}
    assert rows[1] == {k: r for k, r in rows[0].items() if verdict[k]}
    first = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(outs[1]).collect()}
    assert rows[2] == {k: r for k, r in rows[1].items() if first[k] == k} and len(rows[2]) < len(rows[1])
    for k, (left, gone) in _removed({k: r["text"] for k, r in rows[2].items()}).items():
        text = rows[3][k]["text"]
        assert text == (" ".join(left) if gone else rows[2][k]["text"]) and rows[3][k]["n_chars"] == len(text)
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(r):
        flat = " ".join(r["text"].split())
        return any(i in flat for i in items)
    assert set(rows[4]) <= {k for k, r in rows[3].items() if not leaks(r)} and set(rows[3]) - set(rows[4])
    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    assert set(rows[5]) == set(rows[4])
    for k, r in rows[5].items():
        assert r["ids"] == tok.encode(rows[4][k]["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_rows_that_share_an_id_or_have_none(spark):
    text = {k: " ".join(f"{k}{i * i % 97}x{i}" for i in range(60)) for k in "abcd"}
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, "b"), (2, "c"), (None, "c"), (None, "d"), (None, "d")]
    df = spark.createDataFrame([(i, text[k]) for i, k in rows], "doc_id long, text string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"] or 0, r["text"][0]) for r in kept.collect())
    assert got == [(0, "d"), (1, "a"), (2, "b"), (2, "c")]
    bench = spark.createDataFrame([(1, "so " + text["d"][:200])], "item_id long, text string")
    clean = decontaminate.keep_clean(df, bench, match_null_ids=True)
    assert clean.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in clean.collect()) == [
        (0, "a"), (0, "c"), (1, "a"), (1, "a"), (2, "b"), (2, "c")]


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
