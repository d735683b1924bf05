"""Quality rules on documents: repetition inside a text, and frequent lines across the documents of a host.

Everything is DataFrame functions. A line is normalised (letters only, lower case) and hashed. Within a host its distinct
documents are counted, documents of equal text once. A line above both limits, an absolute one and a share of the host's
distinct documents, is removed from every document but the first (smallest key) that has it. A document of which too
little is left is depleted and rejected. Frequent lines are joined to the lines of distinct texts, salted by the text, and come back
as one list for each text that has some, which is no longer than the text's own lines. Counts are combined before they are
shuffled; copies of one text are left to Spark's splitting of skewed joins. Texts are told apart by 64-bit hashes.

Defined results: null text is empty (no words, base_failed); a null host is a host of its own; repeated rows are judged
alike and count once; extra columns stay in :func:`clean`, and ones that clash with added columns are replaced; lines
without letters are never frequent; an empty table gives no rows. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.common import WHITE_SPACE, set_apart, stored, text_or_empty, without, words_of

#: A line is frequent in more distinct documents of its host than this,
DOCUMENTS = 10
#: and in more than this share of them.
SHARE = 0.005
#: A document of which less than this share of the words, or fewer than so many words, are left is depleted.
LEFT_SHARE, LEFT_WORDS = 0.4, 25
#: Bits for a place in a list of windows; longer lists take the plain form of the same step.
PLACE = 21
#: Parts that the texts having one frequent line are joined in.
SALTS = 16

ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


def covered(places: Column) -> Column:
    """Words under windows of three that start at the sorted places."""
    n = F.size(places)
    steps = F.zip_with(F.slice(places, 2, F.greatest(n - 1, F.lit(0))), F.slice(places, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: F.least(a - b, F.lit(3).cast("long")))
    return F.when(n > 0, F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x) + 3).otherwise(F.lit(0).cast("long"))


def raw_lines(body: Column) -> Column:
    """The lines that have a word, as they are."""
    return F.filter(F.split(body, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WHITE_SPACE))) > 0)


def measured(df: DataFrame, *, text: str = "text") -> DataFrame:
    """The base counts of every row and its lines: raw, hash of the normalised line (null without letters), words."""
    body = text_or_empty(text)
    out = df.withColumns({"_text": body, "_words": words_of(body)})
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    n = F.size("_words")
    no_longs = F.array().cast("array<bigint>")
    out = out.withColumns({"_raw": raw_lines(F.col("_text")), "_windows": F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(no_longs)})
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long"),
        }
    ).drop("_text", "_words")
    short = F.size("_windows") <= 1 << PLACE
    # hash and place in one number, sorted as plain numbers; equal neighbours are compared by their whole hashes
    out = out.withColumn("_packed", F.when(short, F.sort_array(F.transform("_windows", lambda x, i: F.shiftleft(x, PLACE).bitwiseOR(i.cast("long"))))).otherwise(no_longs))
    at = lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1))
    alike = lambda x, y: F.coalesce((F.shiftright(x, PLACE) == F.shiftright(y, PLACE)) & (F.get("_windows", at(x).cast("int")) == F.get("_windows", at(y).cast("int"))), F.lit(False))
    places = F.transform(F.filter("_packed", lambda x, i: alike(x, F.get("_packed", i - 1)) | alike(x, F.get("_packed", i + 1))), at)
    pairs = F.when(short, F.lit(None)).otherwise(F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i")))))
    out = out.withColumns({"_places": places, "_pairs": pairs})
    same = lambda p, q: F.coalesce(p["x"] == q["x"], F.lit(False))
    long = F.transform(F.filter("_pairs", lambda p, i: same(p, F.get("_pairs", i - 1)) | same(p, F.get("_pairs", i + 1))), lambda p: p["i"])
    out = out.withColumn("_places", F.sort_array(F.coalesce(long, F.col("_places")))).withColumn("n_repeat_words", covered(F.col("_places")))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.drop("_windows", "_packed", "_places", "_pairs")


def normalised(line: Column) -> Column:
    return F.btrim(F.lower(F.regexp_replace(line, r"[^\p{L}]+", " ")))


def hashed_lines(raw: str | Column) -> Column:
    """The lines as structs of their hash (null without letters) and words."""

    def one(line: Column) -> Column:
        plain = normalised(line)
        return F.struct(F.when(F.length(plain) > 0, F.xxhash64(plain)).alias("h"), F.size(words_of(line)).alias("w"))

    return F.transform(raw, one)


def frequent_lines(df: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", documents: int = DOCUMENTS, share: float = SHARE) -> DataFrame:
    """One row per host and distinct text (its hash, same) that has frequent lines: the list of their hashes, each with the
    first document of the line."""
    body = text_or_empty(text)
    lines = F.array_distinct(F.transform(F.filter(F.transform(F.split(body, "\n", -1), normalised), lambda x: F.length(x) > 0), lambda x: F.xxhash64(x)))
    # a null beside the lines of every text counts the texts of a host
    lines = F.concat(lines, F.array(F.lit(None).cast("long")))
    found = df.select(F.col(host).alias("host"), F.col(key).alias("key"), F.xxhash64(body).alias("same"), F.explode(lines).alias("h"))
    once = stored(found.groupBy("host", "h", "same").agg(F.min("key").alias("first")), "lines-of-texts")
    counted = once.groupBy("host", "h").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    texts = counted.filter(F.col("h").isNull()).select(F.col("host").alias("of"), F.col("n").alias("texts"))
    above = counted.filter(F.col("h").isNotNull() & (F.col("n") > documents)).join(texts, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") > share * F.col("texts"))
    above = stored(above.select(F.col("host").alias("of"), F.col("h").alias("line"), F.col("first")), "frequent-lines").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = once.select("host", "h", "same").filter(F.col("h").isNotNull())
    hits = rows.join(above, F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("line")) & (F.pmod("same", F.lit(SALTS)) == F.col("salt")))
    return hits.groupBy("host", "same").agg(F.collect_list(F.struct("h", "first")).alias("lines"))


def judged(df: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", documents: int = DOCUMENTS, share: float = SHARE) -> DataFrame:
    """The rows with their base counts, n_removed_words, the verdict kept, and _gone: which of the raw lines go."""
    df = without(df, *ADDED)
    frequent = frequent_lines(df, key=key, text=text, host=host, documents=documents, share=share)
    frequent = frequent.select(F.col("host").alias("_host"), F.col("same").alias("_text_hash"), F.col("lines").alias("_frequent"))
    out = measured(df.withColumn("_same", F.xxhash64(text_or_empty(text))), text=text).withColumn("_lines", hashed_lines("_raw")).drop("_raw")
    out = out.join(frequent, F.col(host).eqNullSafe(F.col("_host")) & (F.col("_same") == F.col("_text_hash")), "left").drop("_host", "_same", "_text_hash")
    # a document without a key is never the first, and keeps its lines
    out = out.withColumn("_hashes", F.transform(F.filter("_frequent", lambda f: f["first"] != F.col(key)), lambda f: f["h"]))
    out = out.withColumn("_gone", F.transform("_lines", lambda x: F.coalesce(F.array_contains("_hashes", x["h"]), F.lit(False))))
    removed = F.aggregate(F.zip_with("_lines", "_gone", lambda x, g: F.when(g, x["w"]).otherwise(0)), F.lit(0).cast("long"), lambda s, x: s + x)
    out = out.withColumn("n_removed_words", removed)
    left = F.col("n_words") - F.col("n_removed_words")
    kept = ~F.col("base_failed") & ((F.col("n_removed_words") == 0) | ((left >= LEFT_SHARE * F.col("n_words")) & (left >= LEFT_WORDS)))
    return out.withColumn("kept", kept).drop("_lines", "_frequent", "_hashes")


#: The columns that are read, by option.
OWN = {"key": "doc_id", "text": "text", "host": "source"}


def verdicts(df: DataFrame, **options) -> DataFrame:
    """The rows with their counts and verdict."""
    df, names = set_apart(without(df, *ADDED), *(options.get(k, v) for k, v in OWN.items()))
    return judged(df, **options).drop("_gone").withColumnsRenamed(names)


def clean(df: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows kept, with the columns they had (but those that a verdict adds, which are replaced), and their texts without the lines removed."""
    df, names = set_apart(df, text, *(options.get(k, v) for k, v in OWN.items()))
    columns = df.columns
    # the number of the row keeps the filter above the verdict: pushed below, it would repeat all that leads to it
    out = judged(df, text=text, **options).withColumn("_row", F.monotonically_increasing_id()).filter("kept and _row >= 0")
    left = F.array_join(F.transform(F.filter(F.arrays_zip(raw_lines(text_or_empty(text)).alias("raw"), F.col("_gone").alias("gone")), lambda x: ~x["gone"]), lambda x: x["raw"]), "\n")
    return out.withColumn(text, F.when(F.col("n_removed_words") > 0, left).otherwise(F.col(text))).select(*columns).withColumnsRenamed(names)
