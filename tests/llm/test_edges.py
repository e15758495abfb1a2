"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing column names through every operator."""
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cartwalk.llm import bpe, decontaminate, html, licenses, lm, quality, shards, simhash, substrings, tokenfiles

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, n_words long, part int, shard int, slot int, "
          "ids array<int>, src int, row long, `a.b` string, _quality int, tokens int, key long")
LONG = " ".join(f"w{i % 977}x{i % 1009}" for i in range(450_000))  # over one piece


def _row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None, 7, 7, 7, 7, 7, [7], 7, 7, "z", 7, 7, 7)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [_row(1, "One two three four."), _row(2, None), _row(3, ""), _row(3, ""), _row(None, "One two three four."),
            _row(5, LONG), _row(6, "One two three four.", None, None), _row(7, " \t\n\x0b\x0c\r "), _row(8, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    path = spark.conf.get("spark.checkpoint.dir") + "/edges"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "One two three four."), (None, "one two three four"), (2, None), (3, "")], "item_id long, text string")


def _ids(rows):
    return sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in rows)


ALL = [-1, 1, 2, 3, 3, 5, 6, 7, 8]


def test_substrings(docs):
    out = substrings.remove_repeats(docs, min_words=4)
    assert set(docs.columns) | {"n_removed"} == set(out.columns)
    got = {r["doc_id"]: r for r in out.collect()}
    assert _ids(got.values()) == sorted(set(ALL))
    assert got[1]["n_removed"] == 4 and got[1]["text"] == "" and got[2]["text"] is None and got[2]["n_words"] == 0
    assert got[5]["n_words"] == 450_000 and got[5]["n_removed"] == 0 and got[5]["text"] == LONG
    assert got[7]["text"] == " \t\n\x0b\x0c\r " and got[8]["n_words"] == 1
    assert substrings.remove_repeats(docs.limit(0)).collect() == []


def test_simhash(docs):
    out = simhash.near_duplicates(docs).collect()
    assert _ids(out) == ALL
    by = {(r["doc_id"], r["component_id"], r["fingerprint"] == 0) for r in out}
    assert {(1, 1, False), (None, 1, False), (6, 1, False), (2, 2, True), (3, 2, True), (7, 2, True)} <= by
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and _ids(kept.collect()) == [1, 2, 5, 8]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_quality(docs):
    out = quality.judge(docs)
    col = out.columns[-1]
    assert out.columns[:-1] == docs.columns and col == "__quality"
    rows = out.collect()
    assert _ids(rows) == ALL
    for r in rows:
        assert r[col]["base_failed"] == (r["doc_id"] != 5) and r[col]["kept"] == (r["doc_id"] == 5)
    assert _ids(quality.keep_good(docs).collect()) == [5]
    assert quality.quality_digest(docs.limit(0)).collect() == []


def test_decontaminate(docs, bench):
    out = decontaminate.hits(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_items"]) for r in out) == [(1, 1, 2), (6, 1, 2)]
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and _ids(kept.collect()) == [-1, 2, 3, 3, 5, 7, 8]
    assert decontaminate.hits(docs.limit(0), bench).collect() == []
    assert decontaminate.hits(docs, bench.limit(0)).collect() == []


def test_bpe(docs):
    out = bpe.encode(docs, PATH)
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(out.columns) == set(docs.columns)
    assert got[2]["ids"] == got[3]["ids"] == got[7]["ids"] == [] and len(got[1]["ids"]) == 5
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(out, PATH).collect()}
    assert back[1] == "one</w> two</w> three</w> four</w> .</w>" and back[2] == ""
    assert bpe.encode(docs.limit(0), PATH).collect() == []


def test_tokenfiles(docs, spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(PATH)
    out = tokenfiles.files_digest(docs, PATH).collect()
    assert _ids(out) == ALL
    texts = {1: "One two three four.", None: "One two three four.", 6: "One two three four.", 5: LONG, 8: "x"}
    start = 0
    for r in sorted(out, key=lambda r: r["start"]):
        ids = tok.encode(texts.get(r["doc_id"], ""), add_special_tokens=False).ids + [2]
        assert r["start"] == start and r["n_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        start += len(ids)
    assert start > tokenfiles.CHUNK  # the long text is cut by a chunk's end
    assert tokenfiles.files_digest(docs.limit(0), PATH).collect() == []


def test_shards(docs):
    out = shards.shuffle_into_shards(docs, 4)
    rows = out.collect()
    assert set(out.columns) == set(docs.columns) and _ids(rows) == ALL
    assert sorted(sum(r["shard"] == s for r in rows) for s in range(4)) == [2, 2, 2, 3]
    assert shards.shuffle_into_shards(docs.limit(0), 4).collect() == []


def test_lm(docs):
    out = lm.scores_digest(docs).collect()
    assert _ids(out) == ALL
    by = {r["doc_id"]: r for r in out}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == 1 and by[5]["n_tokens"] == 450_001
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in out)
    assert lm.scores_digest(docs.limit(0)).collect() == []


def test_licenses(docs):
    assert licenses.scan(docs).collect() == []
    more = docs.withColumn("text", F.when(F.col("doc_id") == 8, "Released under the MIT License.").otherwise(F.col("text")))
    assert [(r["doc_id"], r["license"], r["dice"]) for r in licenses.scan(more).collect()] == [(8, "MIT", 1.0)]
    assert licenses.scan(docs.limit(0)).collect() == []


def test_html(spark):
    rows = [(1, None, "t", "x"), (2, "", "t", "x"), (3, "<p>a<p>b", "t", "x"), (3, "<p>a<p>b", "t", "x"), (4, "<div>" * 5000 + "deep", "t", "x"),
            (5, "<table><td>" * 2000 + "y", "t", "x"), (6, "<p>" + "word " * 200_000, "t", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, title string, `a.b` string")
    out = html.extract_text(pages)
    got = {r["page_id"]: (r["title"], r["text"]) for r in out.collect()}
    assert set(out.columns) == {"page_id", "html", "title", "a.b", "text"}
    assert got[1] == (None, None) and got[2] == (None, "") and got[3] == (None, "a\n\nb") and got[4][1] == "deep" and got[5][1] == "y"
    assert len(got[6][1]) == 999_999
    assert html.extract_text(pages.limit(0)).collect() == []
