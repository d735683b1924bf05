import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from hyperloom.llm import pii

# the contract's patterns, plainly
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (name, p) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in p.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if name == "ip" and max(map(int, m[0].split("."))) > 255 or name == "card" and not (12 <= len(d) <= 19 and luhn(d)) or name == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


TEXTS = [
    None, "", "x", "🙂 é a.b+c@d-e.co.uk, a@b.c.@d.e a@b @c.d a@@b.c %@x.y", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 000255.1.01.0 1.1.1 .1.2.3.4. 1..2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 4111  1111 1111 1111 12 3", "+1 (342) 555-8390 +49 30 1234567. +1 ++12 345 6789 0 +123456789012345678 +1-2",
    "1 " * 6000, "a" * 30000 + "@", "9" * 30000, "call +1 342 555 8390 or 342-555-8391 me@x.org 10.0.0.1", "a@b.c" * 50, "5 5" * 700 + " 4111111111111111 " + "7.7.7.7 " * 300,
    "+4111111111111111", "4111111111111111@x.com", "1.1.1.1@x.com 1.1.1.1-2 +1.1.1.1.11.11",
]


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark)


def test_the_file_is_what_training_makes(model):
    held = pii.trained()
    assert (held.depth, held.trees, held.feature) == (model.depth, model.trees, model.feature) and held.thresholds == model.thresholds
    assert held.limit == pytest.approx(model.limit) and held.value == pytest.approx(model.value)


def check(spark, model, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, Spans int, other string")
    got = {r.doc_id: r for r in pii.report(df, model=model).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t or "")[:80]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(x.startswith(k) for x in want) for k in ("email", "ip", "card", "phone")]
        assert set(want) <= set(got[i].spans.split(",")) if want else True
    return got


def test_base_spans(spark, model):
    check(spark, model, [(i, t, 0, "o") for i, t in enumerate(TEXTS)])


def test_tables(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    check(spark, model, [(r.doc_id, r.text, 0, None) for r in docs])


# forms that no template of the trees has
UNSEEN = {
    "number": (["Ring me: ###-###-####", "my SSN: ###-##-####", "Tel. ### ####", "call (0##) #### ####", "Kontonummer ##########"], ["chapter #.## to #.##.#", "## ## ####, ##:##", "#,### and ##,###", "ISBN ## #### #### #", "on ##.##.20## ##:##"]),
    "token": (["&^#&^#&^#&^#&^#&^#", "AKIA^^^#^^^^^^^#^^^^"], ["****#", "%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%"]),
    "secret": (["passwort: geheim####", "PASSWORD=*#&&", "clave: ^&&&#&&&", 'secret: "&&&#&&&&&&&"'], ["secret: none", "key: value", "token: word", "Pin: oak"]),
    "hex": (["#%:%%:#%:%%:%%:%#", "%%%%:%#%%:%%%%:%%%%:%%%%:%%%%:#%%%:%%%%"], ["11-22-33-44", "dad-bad-ace-fad"]),
    "contact": (["*.* (at) * (dot) com", "* at example dot com", "* [at] * [dot] net", "*AT*DOTcom"], ["* at *. ^*", "meet at * point *", "* at * dot ^*"]),
}


def test_added_spans_of_unseen_forms_in_documents(spark, model):
    """Recall and precision by kind on lines of unseen forms, put inside given documents."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if r.text and len(r.text) > 200][:40]
    forms = [(form, k, good) for k, both in UNSEEN.items() for own, good in zip(both, (True, False)) for form in own]
    lines = pii.examples(spark, 40 * len(forms), 977, [(form, good) for form, _, good in forms]).collect()
    rows = [(r.id, texts[r.id % len(texts)][:100] + "\n" + r.text + "\n" + texts[r.id % len(texts)][-100:], r.template) for r in lines]
    at = {r.id: (100 + 1, 100 + 1 + len(r.text)) for r in lines}
    caught, n = {}, {}
    for r in pii.report(spark.createDataFrame(rows, "id long, text string, template int"), model=model).collect():
        _, kind, good = forms[r.template]
        spans = [x.split(":") for x in r.spans.split(",") if x]
        hit = any(int(a) < at[r.id][1] and int(b) > at[r.id][0] for _, a, b in spans)
        n[kind, good] = n.get((kind, good), 0) + 1
        caught[kind, good] = caught.get((kind, good), 0) + hit
    recall = {k: caught[k, True] / n[k, True] for k in UNSEEN}
    precision = {k: caught[k, True] / max(1, caught[k, True] + caught[k, False]) for k in UNSEEN}
    print("recall", recall, "precision", precision)
    assert min(recall.values()) >= 0.5 and sum(recall.values()) >= 4, recall
    assert min(precision.values()) >= 0.8, precision
    assert any(abs(x) > 0.01 for x in model.thresholds.values()), model.thresholds  # set by the lines, not by the trees' own zero


def test_spans_over_base_spans_stay(spark, model):
    texts = {1: "password=hunter2a@mail.example.com!tailsecret", 2: "my ssn is 219-09-9999", 3: "john at example dot com", 4: "passwort: geheim1234", 5: "aa:bb:cc:11:22:33", 6: "token=" + "aB3x" * 101}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df, model=model).collect()}
    assert got == {1: "[SECRET]", 2: "my ssn is [NUMBER]", 3: "[CONTACT]", 4: "[SECRET]", 5: "[HEX]", 6: "[SECRET]"}
    spans = {r.doc_id: r.spans for r in pii.report(df, model=model).collect()}
    assert spans[1] == "secret:0:45,email:9:34"


def test_prefixes_and_long_names_belong_to_the_span(spark, model):
    texts = {1: "DE89 3704 0044 0532 0130 00", 2: "ghp_16C7e42F292c6912E7710c838347Ae178B4a", 3: "fe80::1ff:fe23:4567:890a", 4: "a" * 70 + " at example dot com", 5: "jane at mail dot example dot com"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df, model=model).collect()}
    assert got == {1: "[NUMBER]", 2: "[TOKEN]", 3: "[HEX]", 4: "[CONTACT]", 5: "[CONTACT]"}


def test_added_spans_in_given_documents(spark, model):
    """The added spans of all documents of sf0.01 are secrets that they spell out, each of them whole; nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    planted = re.compile(r"token = \"[0-9a-f]{40}\"")
    for r in pii.report(docs, model=model).collect():
        added = [(int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k in pii.GENERATORS]
        want = [m.span() for m in planted.finditer(texts[r.doc_id] or "")]
        assert len(added) == len(want) and all(a <= c and d <= b for (a, b), (c, d) in zip(added, want)), r.doc_id


def test_merged_spans_and_places(spark):
    rng = random.Random(6)
    for n in (0, 1, 130, 700):
        values = [rng.randrange(1000) for _ in range(n)]
        df = spark.createDataFrame([(values,)], "v array<long>")
        row = df.select(pii.highest(F.col("v")).alias("h"), pii.running(F.col("v")).alias("s")).first()
        assert row.h == [max(values[: i + 1]) for i in range(n)] and row.s == [sum(values[:i]) for i in range(n)]
    ordered = sorted(rng.randrange(500) for _ in range(300))
    got = spark.createDataFrame([(ordered, x) for x in range(-2, 503)], "v array<long>, x long").select("x", pii.at_most("v", F.col("x")).alias("n")).collect()
    assert all(r.n == sum(v <= r.x for v in ordered) for r in got)
    text = "".join(rng.choice("ab🙂é\n") for _ in range(1500))
    pairs = [(a, b) for a, b in ((rng.randrange(1501), rng.randrange(1501)) for _ in range(200)) if a <= b] + [(0, 0), (1500, 1500), (0, 1500), (256, 512), (255, 257)]
    df = spark.createDataFrame([(text, a, b) for a, b in pairs], "text string, a long, b long").withColumn("p", pii.pieces_of("text"))
    assert all(r.c == text[r.a : r.b] for r in df.select("a", "b", pii.cut("p", F.col("a"), F.col("b")).alias("c")).collect())


def test_many_spans_in_one_text(spark, model):
    """A megabyte with a number and an address in every 80 characters: work grows with the text."""
    import time

    line = ("call +1 342 555 8390 or write to someone@mail.example.org about the boats" + " " * 80)[:80]
    took = []
    for n in (2_000, 12_500):
        df = spark.createDataFrame([(1, line * n)], "doc_id long, text string")
        began = time.time()
        text = pii.redact(df, model=model).first().text
        took.append(time.time() - began)
        assert text.count("[PHONE]") == text.count("[EMAIL]") == n
    assert took[1] < 6 * took[0] + 10


def test_redact(spark, model):
    df = spark.createDataFrame([(1, "🙂 mail a@b.org or +1 (342) 555-8390 now", 5), (2, None, 5), (3, "plain words only", 5)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r.text for r in pii.redact(df, model=model).collect()}
    assert got == {1: "🙂 mail [EMAIL] or [PHONE] now", 2: None, 3: "plain words only"}
    assert pii.redact(df.limit(0), model=model).columns == df.columns


def test_long_values_go_whole(spark, model):
    rng = random.Random(21)
    mixed = lambda n, more="": "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + more) for _ in range(n))
    values = {
        1: "token=" + ".".join(mixed(n, "-_") for n in (80, 500, 90)), 2: mixed(200), 3: "".join(rng.choice("ABCDEFabcdef") for _ in range(80)).upper() + mixed(60) + "7",
        4: ":".join(f"{rng.randrange(1 << 16):04x}" for _ in range(24)), 5: "ab:cd:ef:fa:ce:bd", 6: " ".join(["415-555-2671"] * 6),
    }
    df = spark.createDataFrame([(i, f"plain words {v} and more") for i, v in values.items()], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df, model=model).collect()}
    for i, t in got.items():
        assert re.fullmatch(r"plain words (\[[A-Z]+\])+ and more", t), (i, t)


@pytest.mark.parametrize("text", ["ab-" * 200_000 + "zz", "aa:bb:cc:" * 70_000 + "ffff0", "1 " * 300_000, "aB3" * 200_000, "key=" + "x" * 500_000])
def test_long_runs_are_read_once(spark, model, text):
    assert pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string"), model=model).select("spans").count() == 1
