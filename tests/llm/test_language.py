import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hyperloom.llm import language, queries
from hyperloom.llm.common import table

SCHEMA = "doc_id long, text string, lang string, score int, _l map<string,int>"


def hashed(gram):
    h = np.array([ord(gram[0])], dtype=np.uint32) * language.MIX[0]
    for c in gram[1:]:
        h = (h ^ (h >> np.uint32(15))) * language.MIX[1] + np.array([ord(c)], dtype=np.uint32) * language.MIX[2]
    return int(((h ^ (h >> np.uint32(13))) * language.MIX[0] >> np.uint32(32 - language.BITS))[0])


def brute(text):
    """Places and counts by the definition."""
    text = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    if not text.strip():
        return {}
    text = " " + " ".join(text.split(" ")).strip() + " "
    while "  " in text:
        text = text.replace("  ", " ")
    out = {}
    for n in range(1, language.ORDERS + 1):
        for i in range(len(text) - n + 1):
            out[hashed(text[i : i + n])] = out.get(hashed(text[i : i + n]), 0) + 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcÄß é\n1.-\U00010428東", max_size=60), st.integers(1, 7), st.sampled_from([8, 1 << 15]))
def test_counts_of_pieces_equal_the_definition(text, piece, few):
    before = language.PIECE, language.PLACES
    try:
        language.PIECE = piece
        at, n = language.counted(text)
    finally:
        language.PIECE = before[0]
    assert dict(zip(at.tolist(), n.tolist())) == brute(text) and (np.diff(at) > 0).all()


def test_long_texts_are_read_whole():
    text = "word " * 500_000 + "zyx"
    at, n = language.counted(text)
    found = dict(zip(at.tolist(), n.tolist()))
    assert found[hashed("zyx")] >= 1 and found[hashed("wor")] >= 500_000


def test_held_out_accuracy_and_calibration(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r[0]: (r[1], r[2]) for r in table(spark, sf, "documents").select("doc_id", "lang", "text").collect()}
    rows = queries.op12_language_id(spark, sf).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = [r["lang_pred"] == truth[r["doc_id"]][0] for r in held]
    assert sum(right) / len(held) > 0.98
    scores = np.array([r["score"] for r in held])
    assert abs(scores.mean() - np.mean(right)) < 0.03 and scores.min() >= 0 and scores.max() <= 1
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op12_language_id(spark, sf).collect()}
    assert {r["doc_id"]: r["lang_pred"] for r in rows} == {k: v[0] for k, v in again.items()}
    assert max(abs(again[r["doc_id"]][1] - r["score"]) for r in rows) < 1e-6


def test_language_isnt_an_input_of_predictions(spark):
    rows = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    model = language.fit(rows)
    plain = sorted(map(tuple, language.identify(rows, model).collect()))
    assert plain == sorted(map(tuple, language.identify(rows.selectExpr("doc_id", "text", "'xx' AS lang"), model).collect()))


def written(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 5, {"a": 1}) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op12_language_id(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("rows", [[], [(1, "some text", None)], [(i, None, "en") for i in range(9)], [(i, "one language", "en") for i in range(9)]])
def test_small_tables(spark, tmp_path, rows):
    found = written(spark, tmp_path, rows)
    assert len(found) == len(rows)
    known = any(zlib.crc32(str(r[0]).encode()) % 5 and r[2] and r[1] for r in rows)
    assert all(r["lang_pred"] == ("en" if known else "und") for r in found)


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, no letters, repeated rows and texts, a text of a megabyte, a text of both languages' labels."""
    rows = [(i, f"the cat and the dog number {'abcdefgh'[i % 8]}", "en") for i in range(40)] + [(100 + i, f"der hund und die katze {'abcdefgh'[i % 8]}", "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "12 + 3 = 15\n\t!", "en"), (202, "", None), (None, "the dog", "en"), (None, "die katze und der hund", None)] + [(300, "the dog and the cat", "en")] * 20
    rows += [(400, "und die katze ist der hund " * 40_000, None), (401, "the cat", "de"), (402, "the cat", "en")]
    found = written(spark, tmp_path, rows)
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["held_out"], r["score"]))
    assert all(by[i] == [("und", zlib.crc32(str(i).encode()) % 5 == 0, 0.0)] for i in (200, 201, 202))
    assert by[400][0][0] == "de" and {x[0] for x in by[300]} == {"en"} and len(by[300]) == 20
    assert sorted(x[0] for x in by[None]) == ["de", "en"] and all(x[1] for x in by[None])
