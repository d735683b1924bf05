"""Byte-level BPE: the tokenizers library over Arrow batches, and decoding by the reversed byte table.

The merges are derived once on the driver from a file of ranks and sent to the executors in a broadcast (some MB, fixed by
the vocabulary). In a task each batch's texts are cut before blanks that follow a visible character: no match of the
splitting pattern can span such a place, so every piece is encoded by the library on its own, once per distinct piece of
those that the task remembers. Pieces are places in Arrow's buffer of the texts; Arrow finds the distinct ones and puts
their ids, and the bytes of ids, in order, so Python sees a piece once for each slice and a token never.

Defined results: a null text counts as empty (no tokens); tables may be empty; repeated rows are encoded alike; columns
of the input stay, one that clashes with an output column is replaced. Texts of any length are handled in pieces, so
memory follows the longest piece between blanks rather than the text.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from itertools import chain
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.llm.common import without

#: Bytes of pieces and their ids, about, that a task remembers (a slice of a batch more at most).
REMEMBERED = 64 << 20
#: Bytes of text in a slice of a batch.
SLICE = 1 << 20
#: A pattern by which letters and digits share no match with a mark after them, so texts are also cut there.
APART = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Of each byte: 1 an ASCII letter or digit, 2 another visible ASCII character, 0 the rest.
KINDS = np.array([0 if not 32 < b < 127 else 1 if chr(b).isalnum() else 2 for b in range(256)], dtype=np.uint8)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in printable else next(rest)) for b in range(256)}


CHARACTERS = byte_characters()


def shown(token: bytes) -> str:
    """The characters that stand for a token's bytes in the vocabulary."""
    return "".join(map(CHARACTERS.__getitem__, token))


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file of lines ``base64 rank``; a local path or one that only Spark reads."""
    lines = (r.value for r in spark.read.text(path).toLocalIterator()) if "://" in path else open(path)
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair each longer token is merged from, by rank: what its bytes become under the lower ranks."""
    found = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            k = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[k] + parts[k + 1], rank) >= rank:
                raise ValueError(f"token {token!r} can't be merged from two tokens of lower rank")
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 2:
            found.append((parts[0], parts[1]))
    return found


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizer of the tokenizers library, as JSON, that splits by the pattern and merges by the ranks."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.BPE(vocab={shown(k): v for k, v in ranks.items()}, merges=[(shown(a), shown(b)) for a, b in merges_of(ranks)]))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made.to_str()


def pieces_of(text: str) -> list[str]:
    """The text cut before each blank that follows a visible character."""
    first, *rest = text.split(" ")
    pieces = [first] if first else []
    pieces += [" " + x for x in rest]
    if re.search(r"^ |\s ", text):  # runs of white space stay whole: they are matched together
        joined: list[str] = []
        for x in pieces:
            if joined and joined[-1][-1].isspace():
                joined[-1] += x
            else:
                joined.append(x)
        return joined
    return pieces


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts or bytes stay within the size, one row at least."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    for name, values in columns.items():
        batch = batch.append_column(name, values)
    return batch


def offsets_of(column: pa.Array) -> np.ndarray:
    """Where each of the texts or bytes starts in the column's buffer, and where the last one ends."""
    return np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)


def joined(values: pa.Array, first: np.ndarray) -> pa.Array:
    """The bytes of successive values as one, from each given place to the next."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offsets_of(values)[first]), values.buffers()[2] or pa.py_buffer(b"")])


def after_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bytes before each place, where a character of several bytes ends, are white space beyond ASCII."""
    a, b, c = data[at - 1], data[at - 2], data[at - 3]
    general = (b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF)) | (b == 0x81) & (a == 0x9F)
    return (b == 0xC2) & ((a == 0x85) | (a == 0xA0)) | (c == 0xE1) & (b == 0x9A) & (a == 0x80) | (c == 0xE2) & general | (c == 0xE3) & (b == 0x80) & (a == 0x80)


def pieces(texts: pa.Array, apart: bool) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts in order, and the place among them of each text's first and of the end: cut as in
    :func:`pieces_of`, with apart also between an ASCII letter or digit and a mark."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.string()), "")
    at = offsets_of(texts)
    data, at = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]
    cut, kinds = np.zeros(len(data) + 1, dtype=bool), KINDS[data]
    blanks = np.flatnonzero(data[1:] == 32) + 1
    cut[blanks[kinds[blanks - 1] > 0]] = True
    wide = blanks[data[blanks - 1] > 127]
    cut[wide[~after_white(data, wide)]] = True
    if apart:
        cut[1:-1] |= (kinds[:-1] == 1) & (kinds[1:] == 2)
    cut[at] = True
    starts = np.flatnonzero(cut).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]), np.searchsorted(starts, at)


def remembering(tokenizer, most: int = REMEMBERED):
    """A function from different pieces to their ids as bytes. It remembers the pieces met in this turn and in the last;
    a turn ends at half of the size, so pieces that keep coming stay."""
    last, now, held = {}, {}, 0

    def ids_of(pieces: list[str]) -> list[bytes]:
        nonlocal last, now, held
        if held > most // 2:
            last, now, held = now, {}, 0
        new = []
        for x in pieces:
            if x not in now:
                if x in last:
                    now[x] = last[x]
                    held += getsizeof(x) + 100
                else:
                    new.append(x)
        for i in range(0, len(new), 8192):
            part = [e.ids for e in tokenizer.encode_batch_fast(new[i : i + 8192], add_special_tokens=False)]
            data, start = np.fromiter(chain.from_iterable(part), "<u4").tobytes(), 0
            held += len(data)
            for x, e in zip(new[i : i + 8192], part, strict=True):
                now[x] = data[start : (start := start + 4 * len(e))]
                held += getsizeof(x) + 100
        return [now[x] for x in pieces]

    return ids_of


def encoder(spark: SparkSession, ranks_path: str, pattern: str, text: str, offsets: bool = False):
    """What a task of :func:`encode` does with its batches."""
    model = spark.sparkContext.broadcast(tokenizer_json(read_ranks(spark, ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model.value)
        ids_of = remembering(tokenizer)
        for whole in batches:
            for a, b in slices(whole.column(text)):
                batch = whole.slice(a, b - a)
                if offsets:
                    yield with_columns(batch, **placed(tokenizer, [pieces_of(x or "") for x in batch.column(text).to_pylist()]))
                    continue
                cut, first = pieces(batch.column(text), pattern == APART)
                coded = cut.dictionary_encode()
                ids = joined(pa.array(ids_of(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices), first)
                yield with_columns(batch, n_tokens=pa.array(np.diff(offsets_of(ids)) // 4, pa.int64()), ids=ids)

    return run


def encode(df: DataFrame, *, ranks_path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Adds n_tokens (long) and ids (binary: little-endian unsigned 32-bit integers, see :func:`ids_array`).

    With offsets also starts and ends (arrays of int): the code points of the text that each token touches, so that the
    tokens of a character split over several of them share its place.
    """
    df, run = without(df, "n_tokens", "ids", "starts", "ends"), encoder(df.sparkSession, ranks_path, pattern, text, offsets)
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    if offsets:
        added += [T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("starts", "ends")]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def placed(tokenizer, cut: list[list[str]]) -> dict[str, pa.Array]:
    """Ids and the code points that they cover, of texts cut in pieces."""
    out: dict[str, list] = {"n_tokens": [], "ids": [], "starts": [], "ends": []}
    for pieces in cut:
        ids, starts, ends, at = [], [], [], 0
        for x, e in zip(pieces, tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True):
            ids += e.ids
            starts += [at + s for s, _ in e.offsets]
            ends += [at + s for _, s in e.offsets]
            at += len(x)
        for name, x in (("n_tokens", len(ids)), ("ids", np.asarray(ids, dtype="<u4").tobytes()), ("starts", starts), ("ends", ends)):
            out[name].append(x)
    kinds = {"n_tokens": pa.int64(), "ids": pa.binary(), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32())}
    return {k: pa.array(v, kinds[k]) for k, v in out.items()}


def decoder(spark: SparkSession, ranks_path: str, ids: str, text: bool = False):
    """What a task of :func:`decode` does with its batches."""
    byte_of = {c: b for b, c in byte_characters().items()}
    vocabulary = ((shown(token), i) for token, i in read_ranks(spark, ranks_path).items())
    table = spark.sparkContext.broadcast({i: bytes(map(byte_of.__getitem__, characters)) for characters, i in vocabulary})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        token = pa.array([table.value.get(i) for i in range(max(table.value, default=-1) + 1)], pa.binary())
        for whole in batches:
            for a, b in slices(whole.column(ids)):
                batch = whole.slice(a, b - a)
                column = pc.fill_null(batch.column(ids).cast(pa.binary()), b"")
                at = offsets_of(column)
                if (np.diff(at) % 4).any():
                    raise ValueError("ids have 4 bytes each")
                numbers = np.frombuffer((column.buffers()[2] or b"")[at[0] : at[-1]], "<u4").astype(np.int64)
                if (unknown := numbers[numbers >= len(token)]).size:
                    raise KeyError(int(unknown[0]))
                found = token.take(pa.array(numbers))
                if found.null_count:
                    raise KeyError(int(numbers[np.asarray(found.is_null()).argmax()]))
                made = joined(found, (at - at[0]) // 4)
                columns = {"decoded": made}
                if text:
                    columns["decoded_text"] = pa.array([x.decode("utf-8", "replace") for x in made.to_pylist()], pa.string())
                yield with_columns(batch, **columns)

    return run


def decode(df: DataFrame, *, ranks_path: str, ids: str = "ids", text: bool = False) -> DataFrame:
    """Adds decoded (binary): the characters of the ids in the vocabulary, turned back into bytes by the reversed table; null ids give no bytes, an unknown id raises KeyError.

    With text also decoded_text: the bytes as UTF-8 once all are joined, so that characters split between tokens come
    out whole; what is no UTF-8 becomes U+FFFD.
    """
    df, run = without(df, "decoded", "decoded_text"), decoder(df.sparkSession, ranks_path, ids, text)
    added = [T.StructField("decoded", T.BinaryType())] + ([T.StructField("decoded_text", T.StringType())] if text else [])
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def ids_array(df: DataFrame, ids: str = "ids", to: str = "token_ids") -> DataFrame:
    """Adds the ids as an array of int."""
    value = lambda i: sum((F.conv(F.hex(F.substring(ids, 4 * i + k + 1, 1)), 16, 10).cast("int") * (1 << 8 * k) for k in range(4)), F.lit(0))
    n = F.coalesce(F.length(ids), F.lit(0)) / 4
    return df.withColumn(to, F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), value)).otherwise(F.array().cast("array<int>")))


def round_trip(df: DataFrame, *, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256: digests of the ids and of the bytes that they decode to. Both directions
    run in one Python process of a task, slice by slice, so half as many processes share an executor's memory."""
    df = without(df, "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")
    there, back = encoder(df.sparkSession, ranks_path, pattern, text), decoder(df.sparkSession, ranks_path, "ids")
    kept = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from back(x.drop_columns([text]) for x in there(batches))

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    both = df.mapInArrow(run, T.StructType([*kept, *added]))
    return both.withColumns({"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}).drop("ids", "decoded")
