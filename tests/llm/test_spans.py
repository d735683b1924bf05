import random

import zlib

from hyperloom.llm import spans


def own_sentences(text):
    """The docstring's sentences, character by character."""
    out, piece = [], ""
    for i, c in enumerate(text):
        rest = text[i + 1 :]
        blank = rest[: len(rest) - len(rest.lstrip())]
        piece += c
        if c == "\n" or c in ".!?" and blank and "\n" not in blank:
            out.append(piece)
            piece = ""
    out += [piece] if piece else []
    return [y for x in out for y in (own_cuts(x) if len(x.split()) > 30 else [x])]


def own_cuts(piece):
    words = piece.split()
    h = [zlib.crc32(f"{a} {b}".lower().encode()) for a, b in zip(words, words[1:])]
    places = [i + 1 for i in range(len(h)) if all((h[i], i) <= (h[j], j) for j in range(max(0, i - 15), min(len(h), i + 16)))]
    ends = []
    for a, b in zip([0, *places], [*places, len(words)]):
        ends += ([*range(a + 30, b - 30, 30)] if b - a > 120 else []) + [b]
    out, n = [""], 0
    for i, c in enumerate(piece):
        ended = not c.isspace() and (i + 1 == len(piece) or piece[i + 1].isspace())
        out[-1] += c
        n += ended
        if ended and n in ends[:-1]:
            out.append("")
    return out


def own_runs(pieces):
    """First and last + 1 sentence of every shortest run from, and up to, each sentence with words."""
    size = [len(x.split()) for x in pieces]
    filled = [i for i, n in enumerate(size) if n]
    if len(filled) < 2:
        return {(filled[0], filled[0] + 1)} if filled and size[filled[0]] >= 20 else set()
    out = set()
    for a in range(len(filled)):
        for way in (1, -1):
            run = []
            for i in filled[a:] if way > 0 else filled[a::-1]:
                run.append(i)
                if len(run) >= 2 and sum(size[j] for j in run) >= 20:
                    out.add((min(run), max(run) + 1))
                    break
    return out


def brute(rows):
    first, out = {}, {}
    order = sorted((k, t) for k, t in rows if t is not None)
    for k, t in order:
        pieces = own_sentences(t)
        for x, y in sorted(own_runs(pieces)):
            words = "\n".join(" ".join(p.split()).lower() for p in pieces[x:y] if p.split())
            if first.setdefault(words, (k, x, y)) != (k, x, y):
                out.setdefault(k, set()).update(range(x, y))
    return out


def sentence(rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(1, 14))) + rng.choice([".", "!", "?"])


def test_repeated_passages(spark):
    rng = random.Random(6)
    passages = [" ".join(sentence(rng) for _ in range(8)) for _ in range(3)]
    rows = [(i, " ".join([sentence(rng) for _ in range(5)] + [rng.choice(passages)] + [sentence(rng) for _ in range(5)])) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1].upper()), (102, ""), (103, None), (104, "\n\n"), (105, "one. two.\nthree"), (106, "w " * 500), (107, "  w " + "w " * 300), (108, passages[0].replace(" ", "\n"))]
    bare = " ".join(sentence(rng)[:-1] for _ in range(60))  # no marks: a passage at other places
    rows += [(200, "some words before " + bare), (201, bare.replace(" ", "\t") + " after it"), (202, "one\u00a0" + bare[300:]), (203, "a single sentence of twenty words and more " * 3), (204, "a single sentence of twenty words and more " * 3)]
    df = spark.createDataFrame([(k, t, "n") for k, t in rows], "doc_id long, text string, n_removed string")
    got = {r.doc_id: r for r in spans.dedup(df).collect()}
    want = brute(rows)
    texts = dict(rows)
    for k, t in texts.items():
        assert set(got[k].removed) == want.get(k, set()), k
        pieces = spans.sentences(t or "")
        assert "".join(pieces) == (t or "") and got[k].n_sentences == len(pieces)
        assert got[k].text == (None if t is None else "".join(p for i, p in enumerate(pieces) if i not in want.get(k, set())))
    assert got[100].text == "" and got[0].text and got[204].text == "" and got[203].text
    assert len(got[201].text) < 0.2 * len(bare) and len(got[202].text) < 0.3 * len(bare)
    for p in passages:
        assert sum(p in (r.text or "") for r in got.values()) <= 1
    assert spans.dedup(df.limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    rng = random.Random(8)
    text = " ".join(sentence(rng) for _ in range(9))
    got = spans.dedup(spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.n_removed > 0) for r in got) == [(0, True), (1, False), (1, False), (2, True)]
