"""Nulls, empty and very long texts, repeated rows, empty tables and extra columns with clashing names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidepool.llm import langid, licences, maintext, merkle, mixing, packing, privacy, quality, simhash, topk
from tidepool.llm.base import saved

TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Names that the operators use inside.
CLASHING = ("id", "fp", "t", "b", "p", "row", "rate", "score", "label", "y", "x", "tile", "part", "bucket", "next", "leaf", "guest", "own", "k", "rank", "salt", "base", "context", "w", "h", "count", "count(1)", "__x")

ROWS = [
    (1, "A plain text of some words. It has two sentences.", "en", "s", 49), (2, None, "en", "s", None), (3, "", None, None, 0), (4, "   \n ", "fr", "s", 4),
    (5, "word " * 30_000, "en", "s", 150_000), (6, "x" * 150_000, "de", "s", 150_000), (7, "A plain text of some words. It has two sentences.", "en", "s", 49), (None, "null id text, a@b.example.com", "en", "s", 29),
    (None, None, None, None, None), (8, "repeated row cc by all rights reserved 10.0.0.1", "en", "s", 47), (8, "repeated row cc by all rights reserved 10.0.0.1", "en", "s", 47), (8, "same id, other text", "en", "s", 19),
    (9, "日本語 \U0001f600 İstanbul K \x00 \x85", "xx", "s", 20), (10, "...!!! ??? 123", "en", "s", 14),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _frames(spark):
    full = spark.createDataFrame(ROWS, SCHEMA)
    yield "nulls", full
    yield "empty", full.limit(0)
    yield "one", full.limit(1)
    yield "clashing", full.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    yield "all null", full.where("doc_id is null and text is null")


LABELS = "doc_id long, quality int, toxic int"


def _labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 0, 1), (7, 1, None), (None, 1, 1), (5, None, None), (6, 0, 0), (6, 0, 0)], LABELS)


OPERATORS = {
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "langid": lambda s, d: langid.language_id(d),
    "quality": lambda s, d: quality.quality_scores(d, _labels(s)),
    "merkle": lambda s, d: merkle.merkle_fingerprints(d),
    "privacy": lambda s, d: privacy.personal_data(d),
    "sanitised": lambda s, d: privacy.sanitised(d),
    "mixing": lambda s, d: mixing.mixed_rates(d, corpus_pipeline.domains(_labels(s)), corpus_pipeline.TARGETS),
    "licences": lambda s, d: licences.license_scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    for kind, docs in _frames(spark):
        out = OPERATORS[name](spark, docs).toPandas()
        assert len(out) == docs.count(), (name, kind)


def test_defined_answers(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    prints = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert prints[2, "0" * 16] == prints[3, "0" * 16] == prints[4, "0" * 16] == 2
    said = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_id(docs).where("doc_id is not null").collect()}
    assert said[2] == said[3] == said[10] == ("und", 0.0)
    whole = [r for r in merkle.merkle_fingerprints(docs).collect() if r.doc_id in (2, 3)]
    assert len({r.fingerprint for r in whole}) == 1 and all(r.n_chars == 0 and r.near_edited == 1.0 for r in whole)
    scan = [r for r in licences.license_scan(docs).collect() if r.doc_id == 8]
    assert len(scan) == 3 and sorted(r.n_base for r in scan) == [0, 2, 2]
    null = [r for r in licences.license_scan(docs).collect() if r.doc_id == 2][0]
    assert (null.n_words, null.n_base, null.first_word, null.base_labels, null.labels, null.score) == (0, 0, None, "", "", 0.0)


def test_packing(spark):
    for kind, docs in _frames(spark):
        out = packing.pack(docs, TOKENIZER, RANKS).toPandas()
        starts = out[out.start == 0]
        assert len(starts) == docs.count(), kind
        assert out.length.sum() == starts.doc_tokens.sum()
        assert not out.duplicated(["sequence_id", "offset"]).any()


def test_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [2.0, 1.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (5, []), (100, []), (6, [1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df).collect())
    one = 256 * 256
    assert got == [(0, 1, 7, 5 * one), (0, 2, 8, 5 * one), (0, 3, 50, 4 * one), (50, 1, 0, 4 * one), (50, 2, 7, 4 * one), (50, 3, 8, 4 * one), (100, 1, 5, 0)]
    assert topk.top_k(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e7, 1e7]), (1, [1e7, -3.0])], "vec_id long, embedding array<double>")
    assert [r.score for r in topk.top_k(huge).collect()] == [int(1e7 * 256) ** 2 - 3 * 256 * int(1e7 * 256)]


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>A text of words.</p>"), (3, "u", "<p>A text of words.</p>"), (3, "u", "<p>A text of words.</p>"), (4, "u", "<div>" * 3000 + "deep"), (5, "u", "<p>long " + "word " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = maintext.main_text(df).collect()
    assert len(got) == len(rows) and [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert len({r.text for r in got if r.page_id in (3, None)}) == 1 and all(r.n_chars == len(r.text) for r in got)
    assert maintext.main_text(df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    sf = str(tmp_path)
    _labels(spark).write.parquet(f"{sf}/labels.parquet")
    for kind, docs in _frames(spark):
        at = docs
        for name, stage in corpus_pipeline.STAGES:
            out = saved(stage(spark, at, sf))
            if name != "packing":
                assert out.columns == docs.columns, (kind, name)
            at = out


def test_pipeline_keeps_what_is_clean(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, saved(stage(spark, at, sf))
        seen[name] = (before, at)
    clean = labels.where("quality = 1 and toxic = 0").select("doc_id")
    for name in ("quality", "mixing"):
        before, after = (f.join(clean, "doc_id", "left_semi").select("doc_id").distinct().count() for f in seen[name])
        assert after > 0.97 * before, name
    before, after = ({r.doc_id: r.text for r in f.collect()} for f in seen["near_duplicates"])
    sets = {i: set(simhash.shingle_set(simhash.words_of(t)).tolist()) for i, t in before.items()}
    shared = {}
    for i in sorted(before):
        for x in sets[i]:
            shared.setdefault(x, []).append(i)
    near = {i: {j for x in sets[i] for j in shared[x]} - {i} for i in before}
    like = {i: [j for j in near[i] if len(sets[i] & sets[j]) ** 2 >= 0.64 * len(sets[i]) * len(sets[j])] for i in before}
    assert all(any(j < i and j in after for j in like[i]) for i in before if i not in after)  # what goes is like one that stays
    assert sum(any(j < i and j in after for j in like[i]) for i in after) <= 2  # missed by the fingerprints' links
    before, after = seen["personal_data"]
    found = privacy.personal_data(after).where(F.size("base") > 0)
    assert found.isEmpty() and before.count() == after.count()
    bad = labels.where("toxic = 1").select("doc_id")
    before, after = (f.join(bad, "doc_id", "left_semi").count() for f in seen["mixing"])
    assert after < 0.7 * before
