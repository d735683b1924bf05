"""Columns that aren't an operator's own stay as they are, whatever their names and types; keys may be text or null."""

import math

import pytest
from pyspark.sql import functions as F

from hyperloom.llm import bpe, html_text, interpolated, mixing, pii, quality, simhash, spans, suffix

A = "The old town on the hill was built for those who came with the first boats in spring, and most of its houses are still there today. "
B = "In the years that followed the nets were mended each night by the light of small lamps, and every name was written in a book. "
TEXTS = [A + B, A + B, B + A + "password=hunter2xyz and more of it.", None, "", "short one", A * 3]
EXTRA = "_k int, _s string, _own int, _text string, _all string, _same int, _nth int, fp string, h int, key string, order int, times string, m map<string,int>"
MORE = (7, "s", 8, "t", "a", 9, 10, "f", 11, "k", 12, "x", {"a": 1})


def frame(spark, kind, n=len(TEXTS)):
    ids = {"long": list(range(n)), "string": [f"d{i}" for i in range(n)], "null": [None] * n, "repeated": [i // 2 for i in range(n)]}[kind]
    rows = [(i, t, f"src{k % 2}" if k else None, *MORE) for k, (i, t) in enumerate(zip(ids, TEXTS))]
    return spark.createDataFrame(rows[:n], f"doc_id {'string' if kind == 'string' else 'long'}, text string, source string, {EXTRA}")


def bpe_rows(df):
    import public_tokenizers

    return bpe.round_trip(df, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


OPERATORS = {
    "op1": bpe_rows, "op2": suffix.dedup, "op3": simhash.near_duplicates, "op3 first": simhash.first_of_each,
    "op4": lambda df: html_text.extract(df.withColumnRenamed("text", "html")), "op6": quality.verdicts, "op6 clean": quality.clean,
    "op7": spans.dedup, "op8 rows": mixing.taken_rows, "op9": interpolated.score,
}
NAMES = [x.split()[0] for x in EXTRA.split(", ")]


def checked(df, out, whole):
    rows = out.select("doc_id", *NAMES).collect()
    assert all(tuple(r)[1:] == MORE for r in rows) and len(rows) <= df.count() * 3
    assert not whole or len(rows) == df.count()
    ids = {r.doc_id for r in df.select("doc_id").collect()}
    assert {r.doc_id for r in rows} <= ids


@pytest.mark.parametrize("kind", ["long", "string", "null", "repeated"])
@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_stay(spark, name, kind):
    df = frame(spark, kind)
    checked(df, OPERATORS[name](df), name not in ("op3 first", "op6 clean", "op8 rows"))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    df = frame(spark, "long").limit(0)
    out = OPERATORS[name](df)
    assert out.count() == 0 and set(NAMES) <= set(out.columns)


def test_personal_data(spark):
    model = pii.trained()
    for kind in ("long", "string"):
        df = frame(spark, kind)
        for act in (pii.detect, pii.report, pii.redact):
            checked(df, act(df, model=model), True)
    assert "[SECRET]" in pii.redact(frame(spark, "long"), model=model).filter("doc_id = 2").first().text


def test_component_ids_of_text_keys(spark):
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, "string").select("doc_id", "text")).collect()}
    assert rows["d1"] == rows["d0"] == "d0" and rows["d5"] == "d5"


def test_a_repeated_key_takes_what_the_mix_takes(spark):
    """Rows of one key and size with unlike texts: each comes as often as the mix says of its own text."""
    rows = [(k % 5, " ".join(f"w{k}x{i}" for i in range(10)), "a" if k < 60 else "b") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    want = {(r.key, r.order): r.times for r in mixed.collect()}
    own = df.select("doc_id", mixing.hashed("doc_id", "text", 42).alias("order"), "text").collect()
    got = {r.text: r["count"] for r in mixing.taken_rows(df).groupBy("text").count().collect()}
    assert {r.text: got.get(r.text, 0) for r in own} == {r.text: want[r.doc_id, r.order] for r in own}
    assert not math.isclose(sum(got.values()), 0)
