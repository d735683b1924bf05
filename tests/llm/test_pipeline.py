import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from hyperloom.llm import bpe, mixing


def test_stages_one_by_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS, name
        if k < 3:
            assert docs.count() == docs.select("doc_id").distinct().count() <= before.count()
        if name == "mixing":
            mixed = docs.collect()
            times = {r.key: r.times for r in mixing.mix(before).collect()}
            assert len(mixed) == sum(times.values())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(None, public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((r.doc_id, len(enc.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed)
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in docs.collect()) == want
    assert sizes[0] > sizes[1] > 0
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(str, again)) == sorted(map(str, docs.collect()))


def test_odd_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    words = "the river runs to the sea and an old town on a hill was built for those who came with first boats in spring under clear skies of blue"
    many = " ".join(f"{w}{i}" for i in range(8) for w in words.split())
    rows = [(1, many, "en", "a", 5), (1, many[::-1], "en", "a", 5), (None, many.replace("the", "some"), None, None, None), (2, None, None, None, None), (3, "", "en", "a", 0), (1, many, "en", "a", 5), (4, many + " é", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("x") for c in ("fp", "kept", "size", "times", "base", "added", "n_tokens", "_text", "_key", "_n", "block")})
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "").cache()
        assert docs.count() > 0, name
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS


def test_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0
