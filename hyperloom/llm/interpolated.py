"""Language-model scores by deleted interpolation of maximum-likelihood estimates.

A token's probability mixes its bigram and unigram estimates and a uniform one. The weights depend on how often the context
occurs, by powers of two, and are learned by expectation-maximisation on counts of documents that were held out from the
counts whose estimates they mix (one of the PARTS of the training documents; the final estimates use them all).

Documents lie in blocks of about CHARS characters by a hash of their key, text and other columns but maps (only rows that are equal
in all of them always share a block). (1) A block counts its distinct words and
bigrams, as 64-bit keys in order, and sends one run of keys to each range of keys. (2) A range adds the runs up and
answers every block with the counts of its keys, in the same order. (3) A block's documents meet its answers again: first
those of the held-out part, for a table of (context, bigram, unigram) estimates rounded to quarter powers of two, which is
all that the driver sees and whose size doesn't depend on the corpus, then all documents, for the scores. A frequent word or
bigram is one key of each block, so none is hot; ranges and blocks are many and small, whatever the input's size. Keys are
hashes of 63 bits that aren't compared by content: of n distinct words and bigrams about n^2 / 2^64 pairs share one (one
pair in 4 billion keys).

Defined results: null texts are empty (an end token only); a null key counts as the empty string in the split; repeated
rows count and are scored each; extra columns stay, clashing ones are replaced; without training documents the estimates
are uniform; an empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.llm.common import stored, without

#: Characters in a block and for each range of keys.
CHARS, RANGE = 5_000_000, 8_000_000
#: Training documents are split by the same remainder; this one is held out to learn the weights.
PARTS, SCORED, WEIGHTS = 5, 1, 0
#: Steps of a power of two by which estimates are rounded for the weights, and rounds of learning.
STEPS, ROUNDS = 4, 60

END, BEGIN = np.uint64(0x51ED270B35D2A5C8), np.uint64(0x1B873593CC9E2D50)  # keys of the end token and of the place before a text
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class Tokens:
    """Keys of all tokens of some texts, an end after each, and of their bigrams; words have even keys, bigrams odd."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array):
        from xxhash import xxh3_64_intdigest

        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat, owner = lists.flatten(), pc.list_parent_indices(lists)
        real = pc.not_equal(flat, "")
        coded = flat.filter(real).dictionary_encode()
        names = np.fromiter((xxh3_64_intdigest(x.as_buffer()) & ~1 for x in coded.dictionary), np.uint64, len(coded.dictionary))
        words = np.bincount(owner.filter(real).to_numpy(), minlength=len(texts)).astype(np.int64)
        self.sizes = words + 1
        self.last = np.cumsum(self.sizes) - 1
        self.first = self.last - words
        keys = np.empty(int(self.sizes.sum()), dtype=np.uint64)
        inside = np.ones(len(keys), dtype=bool)
        inside[self.last] = False
        keys[~inside] = END
        if len(names):
            keys[inside] = names[coded.indices.to_numpy()]
        before = np.roll(keys, 1)
        before[self.first] = BEGIN
        pairs = before * M1 + (keys ^ (keys >> np.uint64(31))) * M2
        pairs = (pairs ^ (pairs >> np.uint64(32))) * M3
        self.n = len(keys)
        self.keys = np.concatenate([keys, (pairs ^ (pairs >> np.uint64(29))) | np.uint64(1)])

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, the place of each token and bigram among them, and how often each occurs."""
        return np.unique(self.keys, return_inverse=True, return_counts=True)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first) if len(self.first) else np.empty(0)


def numbers(values: np.ndarray, kind: str) -> bytes:
    """Numbers as planes of bytes: the high bytes of ordered keys and of small counts compress well then."""
    values = np.ascontiguousarray(values, dtype=kind)
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def read_back(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


RUNS = "range int, block int, part int, keys binary, counts binary, tokens long, docs long"
ANSWERS = "block int, part int, range int, every binary, kept binary, tokens long, docs long, words long"


def runs(docs: DataFrame, ranges: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        tokens = Tokens(table.column("text"))
        keys, _, counts = tokens.counted()
        edges = np.array([i * (1 << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)
        cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        block, part = table.column("block")[0].as_py(), table.column("part")[0].as_py()
        rows = [(i, block, part, numbers(keys[a:b], "<u8"), numbers(counts[a:b], "<u4"), tokens.n if i == 0 else 0, table.num_rows if i == 0 else 0) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=RUNS.replace(",", "").split()[::2])

    return docs.groupBy("block").applyInArrow(run, RUNS)


def answers(sent: DataFrame) -> DataFrame:
    """For every run the counts of its keys over all training documents, and over those not held out for the weights
    (only for blocks that are); tokens, documents and distinct words of the range on its first row."""

    def run(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_numpy()
        keys = [read_back(x.as_py(), "<u8") for x in table.column("keys")]
        counts = [read_back(x.as_py(), "<u4") for x in table.column("counts")]
        sizes = [len(x) for x in keys]
        part = np.repeat(parts, sizes)
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate(counts).astype(np.float64)
        every = np.bincount(place, n * (part != SCORED), len(known)).astype(np.int64)
        kept = np.bincount(place, n * ((part != SCORED) & (part != WEIGHTS)), len(known)).astype(np.int64)
        words = int(((known & np.uint64(1)) == 0)[every > 0].sum())
        at = np.cumsum([0, *sizes])
        own = [place[a:b] for a, b in zip(at, at[1:])]
        arrays = [
            table.column("block"), table.column("part"), table.column("range"), pa.array([numbers(every[x], "<i8") for x in own], pa.binary()),
            pa.array([numbers(kept[x], "<i8") if p == WEIGHTS else b"" for x, p in zip(own, parts.tolist())], pa.binary()),
            table.column("tokens"), table.column("docs"), pa.array([words] + [0] * (len(own) - 1), pa.int64()),
        ]
        return pa.Table.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in arrays], names=ANSWERS.replace(",", "").split()[::2])

    return sent.groupBy("range").applyInArrow(run, ANSWERS)


def looked_up(docs: pa.Table, told: pa.Table, which: str, begun: int) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token of a block the counts of itself, of its context and of both; ``begun``: counted texts."""
    order = np.argsort(told.column("range").to_numpy())
    counts = np.concatenate([read_back(told.column(which)[int(i)].as_py(), "<i8") for i in order])
    tokens = Tokens(docs.column("text"))
    _, place, _ = tokens.counted()
    found = counts[place]
    own, both = found[: tokens.n], found[tokens.n :]
    context = np.roll(own, 1)
    context[tokens.first] = begun
    return tokens, own, context, both


def level(context: np.ndarray) -> np.ndarray:
    """0 for a context not seen, else 1 and the whole part of its count's binary logarithm."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def learned(docs: DataFrame, told: DataFrame, tokens: int, begun: int, words: int) -> dict[int, np.ndarray]:
    """Weights (bigram, unigram, uniform) for every level of contexts; -1: for levels not held out."""
    zero = -(1 << 20)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("level", "two", "one", "n")})
        _, own, context, both = looked_up(left, right, "kept", begun)
        rounded = lambda x, y: np.where(x > 0, np.round(STEPS * (np.log2(np.maximum(x, 1)) - np.log2(np.maximum(y, 1)))), zero).astype(np.int64)
        rows, n = np.unique(np.stack([level(context), rounded(both, context), rounded(own, np.full_like(own, max(tokens, 1)))], 1), axis=0, return_counts=True)
        return pa.table({k: pa.array(x) for k, x in zip(("level", "two", "one", "n"), (*rows.T, n))})

    met = docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, "level long, two long, one long, n long")
    rows = np.array([tuple(r) for r in stored(met.groupBy("level", "two", "one").agg(F.sum("n").alias("n")), "weights").collect()], dtype=np.int64).reshape(-1, 4)
    value = lambda x: np.where(x == zero, 0.0, np.exp2(x / STEPS))
    estimates = np.stack([value(rows[:, 1]), value(rows[:, 2]), np.full(len(rows), 1 / (words + 1))], 1)
    weights = {-1: fitted(estimates, rows[:, 3])}
    for x in np.unique(rows[:, 0]).tolist():
        own = rows[:, 0] == x
        weights[x] = fitted(estimates[own], rows[own, 3])
    return weights


def fitted(estimates: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights by expectation-maximisation: each round shares the counts out by the mixture's parts."""
    weights = np.full(3, 1 / 3)
    for _ in range(rounds if len(n) else 0):
        parts = estimates * weights
        shares = (parts / parts.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0)
        weights = shares / shares.sum()
    return (weights + 1e-6) / (1 + 3e-6)


def score(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without their text, with held_out, n_tokens, n_known, train_tokens, base_score and score."""
    names = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    df = without(df, *names)
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    blocks, ranges = max(1, -(-chars // CHARS)), max(1, -(-chars // RANGE))
    part = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(PARTS)).cast("int")
    rest = [c for c in df.columns if c != text]
    docs = df.select(F.col(text).alias("text"), part.alias("part"), F.xxhash64(F.col(key), F.col(text), *[F.col(f.name) for f in df.schema.fields if f.name in rest and f.name != key and "map<" not in f.dataType.simpleString()], F.lit(3)).alias("h"), *[F.col(c).alias(f"r_{c}") for c in rest])
    # blocks are of one kind: scored only, held out for the weights, and the rest, which has most of the documents
    kind = F.when(F.col("part") == SCORED, 0).when(F.col("part") == WEIGHTS, 1).otherwise(2)
    of_kind = F.when(kind < 2, F.lit(max(1, -(-blocks // PARTS)))).otherwise(F.lit(max(1, -(-blocks * 3 // PARTS))))
    docs = docs.withColumn("block", (F.pmod("h", of_kind) * 3 + kind).cast("int")).drop("h")
    told = stored(answers(runs(docs.select("block", F.when(F.col("part").isin(SCORED, WEIGHTS), F.col("part")).otherwise(2).cast("int").alias("part"), "text"), ranges)), "counts")
    totals = {r.part: r for r in told.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).collect()}
    of = lambda what, *parts: sum(totals[k][what] for k in parts if k in totals)
    tokens, begun = of("tokens", WEIGHTS, 2), of("docs", WEIGHTS, 2)
    words = told.agg(F.sum("words")).first()[0] or 0
    is_held = F.col("part") == WEIGHTS
    weights = learned(docs.filter(is_held).select("block", "text"), told.filter(is_held).select("block", "range", "kept"), of("tokens", 2), of("docs", 2), words)
    table = np.stack([weights.get(x, weights[-1]) for x in range(64)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, own, context, both = looked_up(left, right, "every", begun)
        w = table[level(context)]
        p = w[:, 0] * np.where(context > 0, both / np.maximum(context, 1), 0) + w[:, 1] * (own / max(tokens, 1)) + w[:, 2] / (words + 1)
        base = np.log10((own + 0.5) / (tokens + 0.5 * (words + 1)))
        columns = {f"r_{c}": left.column(f"r_{c}") for c in rest}
        columns |= {
            "held_out": pa.array(left.column("part").to_numpy() == SCORED), "n_tokens": pa.array(found.sizes), "n_known": pa.array(found.sums((own > 0).astype(np.int64)).astype(np.int64)),
            "train_tokens": pa.array(np.full(left.num_rows, tokens, dtype=np.int64)), "base_score": pa.array(found.sums(base)), "score": pa.array(found.sums(np.log10(p))),
        }
        return pa.table(columns)

    kinds = (T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*[T.StructField(f"r_{f.name}", f.dataType) for f in df.schema.fields if f.name != text], *[T.StructField(n, k) for n, k in zip(names, kinds)]])
    met = docs.groupBy("block").cogroup(told.select("block", "range", "every").groupBy("block")).applyInArrow(run, schema)
    return met.select(*[F.col(f"r_{c}").alias(c) for c in rest], *names)
