import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from hyperloom.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "a   b\n\n c", "\n \n x", "it's we'll IT'S", "x" * 5000, "ab " * 4000, "1234 5678,  90",
    "naïve café — “quotes” … 日本語のテキスト 🙂🙂 é   x   y​z", "tab\tsep\t\tdouble \t mix\r\nline\x0b\x0c", "🙂" * 50, "a　b 　 c", "\x1c \x85 x", "same", "same",
]


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.read_ranks(None, PATH)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_equals_tiktoken(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, N_Tokens string")
    got = {r.doc_id: r for r in bpe.round_trip(df, ranks_path=PATH, pattern=PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = np.asarray(reference.encode_ordinary(t or ""), dtype="<u4")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_tables_ids_and_text(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    coded = bpe.ids_array(bpe.decode(bpe.encode(docs, ranks_path=PATH, pattern=PATTERN), ranks_path=PATH, text=True))
    for r in coded.limit(60).collect():
        assert r.token_ids == reference.encode_ordinary(r.text) and r.decoded_text == r.text


def test_offsets_cover_split_characters(spark):
    df = spark.createDataFrame([("a 🙂 naïve  日本",), (None,)], "text string")
    first, empty = bpe.encode(df, ranks_path=PATH, pattern=PATTERN, offsets=True).collect()
    covered = set()
    for s, e in zip(first.starts, first.ends, strict=True):
        covered |= set(range(s, e))
    assert covered == set(range(len("a 🙂 naïve  日本"))) and empty.starts == [] and empty.n_tokens == 0


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), ranks_path=PATH, pattern=PATTERN).count() == 0


def test_round_trip_takes_one_python_process(spark):
    """Encoding and decoding in a process each had a task hold two: an executor's memory is shared by half as many now."""
    df = bpe.round_trip(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), ranks_path=PATH, pattern=PATTERN)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


class Alone:
    """Stands for the session where a task's work runs in the test's own process."""

    class sparkContext:
        @staticmethod
        def broadcast(value):
            return type("Sent", (), {"value": value})


def test_cuts_change_no_ids(reference):
    """Random texts of white space of all kinds, marks, contractions and characters of 1 to 4 bytes."""
    rng = np.random.default_rng(1)
    alphabet = [*"  \n\n\t\r\x0b\x1c\x00\x7f'''.,$abstz019", *"\x85\xa0   ​   　᠎", *"éàÅ’“—日🙂́½", "'s", "'ll", "'S", " a", "  ", ". "]
    texts = [None, "", *("".join(rng.choice(alphabet, n)) for n in rng.integers(1, 40, 4000)), "", None]
    there, back = bpe.encoder(Alone, PATH, PATTERN, "text"), bpe.decoder(Alone, PATH, "ids", text=True)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["left out", *texts])}).slice(1)
    (got,) = back(there(iter([batch])))
    for t, n, ids, made in zip(texts, *(got.column(x).to_pylist() for x in ("n_tokens", "ids", "decoded_text")), strict=True):
        want = reference.encode_ordinary(t or "")
        assert (n, np.frombuffer(ids, "<u4").tolist(), made) == (len(want), want, t or ""), t


class Counted:
    def __init__(self):
        self.seen = Counter()

    def encode_batch_fast(self, pieces, add_special_tokens):
        self.seen.update(pieces)
        return [type("Coded", (), {"ids": [len(x)]}) for x in pieces]


def test_pieces_that_keep_coming_are_encoded_once():
    """All was forgotten when the memory was full, so frequent pieces were encoded again and again."""
    tokenizer = Counted()
    ids_of = bpe.remembering(tokenizer, 1 << 20)
    for k in range(100):  # ten times the memory
        assert ids_of(["of", *(f" rare{k}x{i}" for i in range(600))])[0] == (2).to_bytes(4, "little")
    assert set(tokenizer.seen.values()) == {1} and len(tokenizer.seen) == 60001


def test_words_before_marks_are_the_same_pieces():
    cut, first = bpe.pieces(pa.array(["a word, a word. A word$$$", None, " word　 a"]), True)
    assert cut.to_pylist() == ["a", " word", ",", " a", " word", ".", " A", " word", "$$$", " word　 a"] and first.tolist() == [0, 9, 9, 10]


def test_unknown_ids():
    for wrong in (np.asarray([60000], "<u4").tobytes(), b"\xff\xff\xff\xff"):
        with pytest.raises(KeyError):
            list(bpe.decoder(Alone, PATH, "ids")(iter([pa.RecordBatch.from_pydict({"ids": pa.array([b"", wrong], pa.binary())})])))
