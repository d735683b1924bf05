"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained with follow-the-regularised-leader
and elastic-net penalties, followed by temperature calibration.

A text is its letters in lower case, every run of other characters one blank; features are its n-grams of 1 to ORDERS such
characters, hashed to 2 ** BITS places, weighed by (1 + log tf) * idf and brought to length 1. Document frequencies are counted
over all learning documents. The weights are learned from a bounded sample: about SAMPLE different texts of each of the
LANGUAGES most frequent languages, chosen by a hash of the text (all of them, if there are no more). A fifth of these is set
apart; the others lie in shards of about SHARD texts, on each of which one task learns with per-coordinate steps, several
passes over the texts in the order of their hashes, and the shards' weights are averaged. The temperature is that with the
least loss on the fifth that was set apart. Language, source and key are read for learning only, never for a prediction.

Learning reads the texts twice (in the JVM for the sample, then for frequencies and the sample's features), prediction once; no
text is shuffled. What is sent is of fixed size: a weight for each place and language. The driver sees sums over the sample and
the corpus, no documents.

Defined results: a null text or one without a letter is `und` with score 0, as is every text if nothing can be learned; a null
key counts as the empty string in the split; repeated rows count in the frequencies, equal texts of a language are learned from
once; equal scores go to the first language in order; an empty table gives no rows. Other columns aren't carried. Texts are
read whole, in pieces of PIECE characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.llm.common import stored

ORDERS, BITS = 3, 15
PLACES = 1 << BITS
#: Bounds of the sample: languages, different texts of each, texts in a shard.
LANGUAGES, SAMPLE, SHARD = 256, 1500, 2048
PIECE = 1 << 20
#: Documents whose crc32(key) leaves this remainder aren't learned from.
PARTS, HELD_OUT = 5, 0
#: Step size, its smoothing, penalties by absolute value and by square, passes over a shard.
ALPHA, BETA, L1, L2, PASSES = 2.0, 0.1, 0.002, 0.01, 3
TEMPERATURES = np.geomspace(0.05, 20, 81)
MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)

UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once in a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """A text's characters (lower-case letters, a blank for every run of others, one at either end) in runs that overlap by
    an n-gram less one, each with the characters known from before; nothing for a text without letters."""
    known, rest, before = letters(), np.full(1, 32, dtype=np.uint32), 0
    for i in range(0, len(text), PIECE):
        points = np.frombuffer(text[i : i + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        real = known[points]
        after = np.empty_like(real)
        after[0], after[1:] = rest[-1] != 32, real[:-1]
        own = np.where(real, points, 32)[real | after].astype(np.uint32)
        if len(own):
            run = np.concatenate([rest, own])
            yield run, before
            rest = run[-(ORDERS - 1) :]
            before = len(rest)
    if rest[-1] != 32:
        yield np.append(rest, np.uint32(32)), before


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text's n-grams, in order, and how often each occurs."""
    found: list[np.ndarray] = []
    total: np.ndarray | None = None
    for run, before in pieces(text or ""):
        hashed = run * MIX[0]
        for n in range(1, ORDERS + 1):
            if n > 1:
                hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint32(15))) * MIX[1] + run[n - 1 :] * MIX[2]
            new = hashed[max(0, before - n + 1) :]
            found.append((new ^ (new >> np.uint32(13))) * MIX[0] >> np.uint32(32 - BITS))
        if len(run) > PLACES // 8:
            own = sum(np.bincount(x, minlength=PLACES) for x in found)
            total, found = own if total is None else total + own, []
    if total is None:
        return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, dtype=np.int64),) * 2
    total = sum((np.bincount(x, minlength=PLACES) for x in found), total)
    at = np.flatnonzero(total)
    return at, total[at]


class Model:
    """Languages, weights (place or bias, language), inverse document frequencies and a temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float = 1.0):
        self.languages, self.weights, self.idf, self.temperature = languages, weights, idf, temperature

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return weighed(at, n, self.idf) @ self.weights[at] + self.weights[PLACES]

    def guess(self, text: str | None) -> tuple[str, float]:
        at, n = counted(text)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(at, n) / self.temperature)
        return self.languages[int(np.argmax(p))], float(p.max())


def weighed(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    length = np.sqrt((x * x).sum())
    return x / length if length > 0 else x


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def led(examples: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> np.ndarray:
    """Weights by follow-the-regularised-leader: examples are (class, places, values), a bias comes last."""
    z, n = np.zeros((PLACES + 1, classes)), np.zeros((PLACES + 1, classes))

    def current(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(PASSES):
        for own, at, x in examples:
            at, x = np.append(at, PLACES), np.append(x, 0.1)[:, None]
            w, before = current(z[at], n[at]), n[at]
            p = softmax((x * w).sum(axis=0))
            p[own] -= 1
            g = x * p
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
            n[at] = after
    w = current(z, n)
    w[PLACES] *= 0.1
    return w


def remainder(key: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % PARTS


def fit(df: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model learned from the rows with a language that aren't held out."""
    spark = df.sparkSession
    rows = df.filter(F.col(lang).isNotNull() & (remainder(key) != HELD_OUT)).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    texts = rows.groupBy("lang", "h").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    top = texts.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in top)
    if not languages:
        return Model([], np.zeros((PLACES + 1, 0)), np.ones(PLACES))
    shares = spark.createDataFrame([(r["lang"], languages.index(r["lang"]), min(1.0, SAMPLE / r["texts"])) for r in top], "lang string, class int, share double")
    chance = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.join(F.broadcast(shares), "lang", "left").select("text", "class", "h", F.coalesce(chance < F.col("share"), F.lit(False)).alias("drawn"))  # a row for each of LANGUAGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, total, seen = np.zeros(PLACES, dtype=np.int64), 0, set()
        for batch in batches:
            out = []
            for x, c, h, d in zip(*(batch.column(name) for name in ("text", "class", "h", "drawn"))):
                at, n = counted(x.as_py())
                documents[at] += 1
                total += 1
                c, h = c.as_py(), h.as_py()
                if d.as_py() and len(at) and (c, h) not in seen:
                    seen.add((c, h))
                    out.append((c, h, at.astype("<i4").tobytes(), np.minimum(n, (1 << 31) - 1).astype("<i4").tobytes()))
            if out:
                c, h, at, n = zip(*out)
                none = pa.nulls(len(out), pa.int32())
                yield pa.RecordBatch.from_arrays([none, none.cast(pa.int64()), pa.array(c, pa.int32()), pa.array(h, pa.int64()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=names)
        at = np.flatnonzero(documents)
        place, n = pa.array(np.append(at, PLACES), pa.int32()), pa.array(np.append(documents[at], total), pa.int64())
        yield pa.RecordBatch.from_arrays([place, n, *(pa.nulls(len(place), t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=names)

    schema = "place int, n long, class int, h long, at binary, tf binary"
    names = [x.split()[0] for x in schema.split(", ")]
    read = stored(drawn.mapInArrow(run, schema), "language")
    held = read.filter("place IS NOT NULL").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # PLACES + 1 rows at most
    documents = np.zeros(PLACES + 1)
    documents[held["place"]] = held["n"]
    idf = np.log((1 + documents[PLACES]) / (1 + documents[:PLACES])) + 1
    sample = read.filter("at IS NOT NULL").dropDuplicates(["class", "h"]).withColumn("aside", F.pmod(F.xxhash64("h"), F.lit(5)) == 0)
    sample = stored(sample.select("class", "h", "at", "tf", "aside"), "sample")
    many = sample.filter("NOT aside").count()
    shards = max(1, -(-many // SHARD))
    sent, classes = spark.sparkContext.broadcast(idf), len(languages)

    def read_back(at: pa.Scalar, n: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(at.as_py(), "<i4"), np.frombuffer(n.as_py(), "<i4")

    def learn(table: pa.Table) -> pa.Table:
        table, examples = table.sort_by([("h", "ascending"), ("class", "ascending")]), []
        for c, at, n in zip(table.column("class"), table.column("at"), table.column("tf")):
            at, n = read_back(at, n)
            examples.append((c.as_py(), at, weighed(at, n, sent.value)))
        w = led(examples, classes)
        place, c = np.nonzero(w)
        return pa.table({"place": pa.array(place, pa.int32()), "class": pa.array(c, pa.int32()), "w": pa.array(w[place, c])})

    learned = sample.filter("NOT aside").withColumn("shard", F.pmod(F.xxhash64("h", F.lit(3)), F.lit(shards))).groupBy("shard").applyInArrow(learn, "place int, class int, w double")
    found = learned.groupBy("place", "class").agg(F.sum("w").alias("w")).toPandas()  # a row for each place and language at most
    model = Model(languages, np.zeros((PLACES + 1, classes)), idf)
    model.weights[found["place"], found["class"]] = found["w"] / shards
    return calibrated(model, sample.filter("aside"), read_back)


def calibrated(model: Model, aside: DataFrame, read_back) -> Model:
    """The model with the temperature of the least loss on texts that weren't learned from."""
    sent = aside.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = np.zeros(len(TEMPERATURES))
        for batch in batches:
            for c, at, n in zip(batch.column("class"), batch.column("at"), batch.column("tf")):
                x = sent.value.logits(*read_back(at, n))
                scaled = (x - x.max())[None, :] / TEMPERATURES[:, None]
                loss += np.log(np.exp(scaled).sum(axis=1)) - scaled[:, c.as_py()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(loss), dtype=np.int32)), pa.array(loss)], names=["i", "loss"])

    losses = aside.select("class", "at", "tf").mapInArrow(run, "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).orderBy("loss", "i").first()
    if losses and losses["loss"] > 0:
        model.temperature = float(TEMPERATURES[losses["i"]])
    return model


def identify(df: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its key, whether it was held out, the language its text is in, and how sure that is."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(key).alias("key"), (remainder(key) == HELD_OUT).alias("held_out"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            guesses = [sent.value.guess(x.as_py()) for x in batch.column("text")]
            names, scores = zip(*guesses) if guesses else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["key", "held_out", "lang_pred", "score"])

    schema = T.StructType([rows.schema["key"], rows.schema["held_out"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
