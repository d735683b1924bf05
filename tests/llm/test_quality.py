import random
import re

import pytest
from pyspark.sql import functions as F

from hyperloom.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again), "base_failed": n < 50 or 100 * len(again) > 50 * n,
    }


def texts():
    rng = random.Random(4)
    made = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\r\ny\x0bz", "é|<> # \x85 one nbsp", "l\nl\nl \nl", "-\n-\n"]
    made += [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    made += ["\n".join(" ".join(rng.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(9)) for _ in range(20)]
    return made


def test_counts_equal_brute_force(spark):
    rows = [(i, t, "s", 9) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string, Kept int")).collect()}
    for i, t, *_ in rows:
        for k, v in brute(t).items():
            assert got[i][k] == v, (t, k)


def test_long_lists_take_the_plain_form(spark, monkeypatch):
    monkeypatch.setattr(quality, "PLACE", 3)  # windows beyond 8 places
    rows = [(i, t, "s") for i, t in enumerate(texts())]
    got = {r.doc_id: r.n_repeat_words for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: brute(t)["n_repeat_words"] for i, t, _ in rows}


def prose(rng, lines):
    return "\n".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(10)) for _ in range(lines))


@pytest.mark.parametrize("host", ["h", None])
def test_frequent_lines(spark, host):
    rng = random.Random(1)
    menu = ["Home 12 | About us, and more of these words", "Log-In here NOW for news and all that"] + [f"{x} {x} menu entry {x}y of the same site" for x in "stuvw"]
    rows = [(i, "\n".join(menu) + f"\n{prose(rng, 12)}\n" + menu[1].lower(), host) for i in range(40)]
    thin = (100, "\n".join([*menu, prose(rng, 2)]), host)
    copies = [(200 + i, prose(random.Random(9), 7), host) for i in range(30)] + [(200, prose(random.Random(9), 7), host)]
    df = spark.createDataFrame([*rows, thin, *copies, (300, None, host)], "doc_id long, text string, source string").withColumn("raw", F.lit(1))
    got = {r.doc_id: r for r in quality.verdicts(df).collect()}
    assert all(got[r[0]].kept for r in rows) and not got[100].kept and not got[100].base_failed
    assert all(got[r[0]].kept and got[r[0]].n_removed_words == 0 for r in copies) and not got[300].kept
    kept = {r.doc_id: r for r in quality.clean(df).collect()}
    assert quality.clean(df).columns == df.columns
    assert menu[0] in kept[0].text and menu[0] not in kept[1].text and kept[1].text == "\n".join(rows[1][1].split("\n")[7:-1])
    assert quality.clean(df.limit(0)).count() == 0


def test_documents_without_a_key_keep_their_lines(spark):
    rng = random.Random(2)
    line = "the same words at the foot of every page"
    rows = [(i if i < 14 else None, f"{prose(rng, 9)}\n{line}", "h") for i in range(16)] + [(i, f"{prose(rng, 9)}\n{line}", "few") for i in range(50, 60)]
    got = quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and all(r.kept for r in got)
    assert {r.doc_id for r in got if r.n_removed_words} == set(range(1, 14))  # ten documents of a host aren't above the limit
