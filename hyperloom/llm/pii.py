"""Personal data: candidate spans, boosted trees over their format and context, and calibrated thresholds.

Everything is DataFrame functions. Four base kinds are found by pattern and check, and always stay. Beside them, generators
of high recall propose overlapping candidates (runs of digits, long tokens of letters and digits, assignments, groups of
hexadecimal digits, addresses that are spelt out). Each has features of its format and of the characters and words around
it. Gradient-boosted trees are trained on EXAMPLES labelled lines, a bounded set made here from templates and a seed, in
FOLDS fits that each leave a part of the templates out; a line's score by the trees that never saw its template sets, for every
generator, the lowest threshold that reaches PRECISION. The fits together are the model. It is the same for every table, so it
lies beside this module as a file that train() made and that a test makes again. The trees become arrays that one expression walks for the candidates
inside each row: no text is moved, and nothing is gathered over documents. An added span may overlap base spans; only one
that lies inside a base span is left out, since it adds nothing.

Spans are in code points, end exclusive. Defined results: null texts have no spans; a table may be empty; repeated rows are
judged alike; extra columns stay, clashing ones are replaced; equal starts are ordered by kind. Every pattern runs through
a text once, without backtracking over more than a match; places are looked up in pieces of the text and spans are merged by
running maxima, so the work grows with a text's length, not with its square.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm.common import set_apart, text_or_empty, without

# The base kinds in their order and their patterns. Possessive forms match what the plain ones do: nothing
# that follows could use what they give back. A local part or a number only starts where its run starts (or a match ended).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Names of secrets, and words for the at sign and the dot in spelt-out addresses, in the texts' languages.
SECRETS = "password|passwd|passphrase|passwort|kennwort|mot de passe|contraseña|clave|pwd|secret|token|jeton|api[_-]?key|key|schlüssel|clé|pin"
AT, DOT = "at|arroba|arobase", "dot|punto|punkt|point"
#: Generators of candidates: name of the spans that they add, and pattern. Runs have no upper bound (length is a feature of
#: the trees); they are possessive and checked group by group, so none is read again. What names the kind of a number or key
#: before it (a country, `ghp_`, `fe80::`) is part of it.
GENERATORS = {
    "number": r"(?:(?<![A-Za-z0-9])[A-Z]{2}(?=[0-9]{2}))?\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "token": r"(?<![A-Za-z0-9])(?:[A-Za-z]{2,8}[_-](?:[A-Za-z]{2,6}[_-])?)?(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{16,}+",
    "secret": rf"(?<!\p{{L}})(?iu:{SECRETS})\x20?[:=]\x20?[^\x20\x09-\x0D]{{4,}}+",
    "hex": r"(?<![A-Za-z0-9:])(?:[A-Fa-f0-9]{1,4}+(?::[A-Fa-f0-9]{1,4}+(?![A-Za-z0-9]))*+::(?:[A-Fa-f0-9]{1,4}+(?![A-Za-z0-9]):?)++"
    r"|[A-Fa-f0-9]{2,4}+(?![A-Za-z0-9])(?:[:-][A-Fa-f0-9]{2,4}+(?![A-Za-z0-9])){3,}+)",
    "contact": rf"(?<![A-Za-z0-9._%+-])(?:[A-Za-z0-9._%+-]++(?:\x20(?i:{AT})\x20|\x20?[\[({{<]\x20?(?i:{AT}|@)\x20?[\])}}>]\x20?|\x20?@\x20?)|(?:(?!AT[A-Za-z0-9])[A-Za-z0-9._%+-])++AT)"
    rf"(?:(?!DOT[A-Za-z])[A-Za-z0-9-])++(?:(?:\x20(?i:{DOT})\x20|\x20?[\[({{<]\x20?(?i:{DOT}|\.)\x20?[\])}}>]\x20?|DOT|\x20\.\x20|\.)[A-Za-z0-9-]++(?<=[A-Za-z])\b)++",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": r"\+", "contact": r"\b[aA][tT]\b|@|AT|(?i:arroba|arobase)", "secret": "[:=]", "hex": "[A-Fa-f0-9][:-][:A-Fa-f0-9]"}
#: Characters before and after a candidate that are looked at.
AROUND = 24
#: Labelled lines made for training; parts of their templates, each of which is scored by trees of the others to set the
#: thresholds; the precision asked of those.
EXAMPLES, FOLDS, PRECISION = 6000, 3, 0.9
TREES, DEPTH, SEED = 10, 4, 42
#: Spans summed at once when places are added up; characters of a piece of text in which places are looked up.
BLOCK, PIECE = 128, 256

FEATURES = ["length", "digits", "upper", "lower", "blanks", "dots", "hyphens", "colons", "brackets", "plus", "equals", "groups", "longest_digits", "generator", "letter_before", "digit_after", "symbol_before", "cue_before", "digits_around", "ending", "longest_letters", "first_group", "last_group"]


def scanned(values: Column, first: Column, step, inclusive: bool) -> Column:
    """What ``step`` makes of all longs before each one (and itself, if inclusive); blocks are taken together first, so the
    work isn't the square of their number."""
    none = F.array().cast("array<bigint>")
    total = lambda x: F.aggregate(x, first, step)

    def before(x: Column, own: bool) -> Column:
        start = F.struct(first.alias("so_far"), none.alias("out"))

        def add(s: Column, v: Column) -> Column:
            new = step(s["so_far"], v)
            return F.struct(new.alias("so_far"), F.concat(s["out"], F.array(new if own else s["so_far"])).alias("out"))

        return F.aggregate(x, start, add, lambda s: s["out"])

    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(1), n, F.lit(BLOCK)), lambda i: F.slice(values, i, BLOCK))
    long = F.flatten(F.zip_with(blocks, before(F.transform(blocks, total), False), lambda x, s: F.transform(before(x, inclusive), lambda v: step(s, v))))
    return F.when(n == 0, none).when(n <= BLOCK, before(values, inclusive)).otherwise(long)


def running(values: Column) -> Column:
    """Sums of what stands before each of the longs."""
    return scanned(values, F.lit(0).cast("long"), lambda s, v: s + v, False)


def highest(values: Column) -> Column:
    """The greatest of the longs, none of which is negative, up to each."""
    return scanned(values, F.lit(0).cast("long"), lambda s, v: F.greatest(s, v), True)


def at_most(values: str, x: Column) -> Column:
    """How many of the longs, in order, are at most x: found by steps of powers of two."""
    n = F.size(values)
    powers = F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda p: p <= n)
    return F.aggregate(powers, F.lit(0), lambda at, p: F.when((at + p <= n) & (F.get(values, at + p - 1) <= x), at + p).otherwise(at))


def pieces_of(text: str) -> Column:
    """A text cut every PIECE characters."""
    return F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(pieces: str, start: Column, end: Column) -> Column:
    """The characters from start to end (exclusive), read from the pieces that hold them only."""
    i, j = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    held = F.array_join(F.slice(pieces, i + 1, F.greatest(j - i + 1, F.lit(0))), "")
    return F.when(end > start, F.substring(held, (start - i * PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise("")


SPANS = "array<struct<start:bigint,end:bigint,hit:string>>"


def found(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Adds for each pattern its matches as a column _name of spans (start, end, hit)."""
    tried = lambda name: F.col(text).rlike(NEEDS.get(name, "[0-9]"))
    no_strings = F.array().cast("array<string>")
    df = df.withColumns({f"_hits_{k}": F.when(tried(k), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).otherwise(no_strings) for k, p in patterns.items()})
    steps = {}
    for k, p in patterns.items():
        hits, gaps = f"_hits_{k}", F.split(text, p, -1)
        moved = F.zip_with(F.transform(F.slice(gaps, 1, F.size(hits)), lambda g: F.length(g).cast("long")), hits, lambda g, h: F.struct(g.alias("gap"), F.length(h).cast("long").alias("len"), h.alias("hit")))
        steps[f"_parts_{k}"] = F.when(F.size(hits) > 0, moved)
    df = df.withColumns(steps).drop(*[f"_hits_{k}" for k in patterns])
    sums = {f"_sums_{k}": running(F.transform(f"_parts_{k}", lambda x: x["gap"] + x["len"])) for k in patterns}
    df = df.withColumns(sums)
    made = {}
    for k in patterns:
        spans = F.zip_with(f"_parts_{k}", f"_sums_{k}", lambda x, s: F.struct((s + x["gap"]).alias("start"), (s + x["gap"] + x["len"]).alias("end"), x["hit"].alias("hit")))
        made[f"_{k}"] = F.coalesce(spans.cast(SPANS), F.array().cast(SPANS))
    return df.withColumns(made).drop(*steps, *sums)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    doubled = F.lit("0246813579")
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.substring(doubled, d + 1, F.lit(1)).cast("int"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda s, v: s + v) % 10 == 0


def valid(kind: str, span: Column) -> Column:
    digits = F.regexp_replace(span["hit"], "[^0-9]", "")
    if kind == "ip":  # parts of many digits are too large unless the digits are zeros
        return F.forall(F.split(span["hit"], r"\."), lambda x: F.length(F.ltrim(x, F.lit("0"))) <= 3) & F.forall(F.split(span["hit"], r"\."), lambda x: F.coalesce(F.right(x, F.lit(9)).cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def features(c: Column) -> Column:
    """The FEATURES, as an array of doubles, of a candidate with hit, generator, before and after."""
    hit, before, after = c["hit"], c["before"], c["after"]
    count = lambda x, p: F.length(F.regexp_replace(x, p, ""))
    longest = lambda p: F.array_max(F.transform(F.split(hit, p), lambda x: F.length(x)))
    # fixed values: words that stand before personal numbers and names of keys, in the languages of the texts
    cue = r"(?i)\b(?:tel|tél|telefon|teléfono|phone|fon|mobil|call|fax|card|carte|karte|tarjeta|visa|account|acct|konto|compte|cuenta|iban|ssn|social security|passport|pasaporte|passeport|reisepass|mail|contact|user|id)"
    values = {
        "length": F.length(hit), "digits": count(hit, "[^0-9]"), "upper": count(hit, "[^A-Z]"), "lower": count(hit, "[^a-z]"), "blanks": count(hit, r"[^\x20]"),
        "dots": count(hit, "[^.]"), "hyphens": count(hit, "[^-]"), "colons": count(hit, "[^:]"), "brackets": count(hit, r"[^()\[\]{}<>]"), "plus": count(hit, "[^+]"),
        "equals": count(hit, "[^=]"), "groups": F.size(F.split(hit, "[^0-9]+")), "longest_digits": longest("[^0-9]+"), "generator": c["generator"],
        "letter_before": before.rlike(r"\p{L}$"), "digit_after": after.rlike("^[0-9]"), "symbol_before": before.rlike(r"[$€£#/._-]$"), "cue_before": before.rlike(cue), "digits_around": count(F.concat(before, after), "[^0-9]"),
        "ending": hit.rlike(r"(?i)(?:\.|dot|punto|punkt|point)[^a-z]*(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|co)$"), "longest_letters": longest(r"\P{L}+"),
        "first_group": F.length(F.regexp_extract(hit, "[0-9]+", 0)), "last_group": F.length(F.regexp_extract(hit, "([0-9]+)[^0-9]*$", 1)),
    }
    return F.array(*[F.coalesce(values[k].cast("double"), F.lit(0.0)) for k in FEATURES])


def candidates(df: DataFrame, text: str) -> DataFrame:
    """Adds _all: the candidates of every generator, with its number and their features x."""
    df = found(df, text, GENERATORS).withColumns({"_pieces": pieces_of(text), "_n": F.length(text).cast("long")})
    own = lambda i, k: F.transform(f"_{k}", lambda s: F.struct(F.lit(i).alias("generator"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit")))
    before = lambda s: cut("_pieces", F.greatest(s["start"] - AROUND, F.lit(0).cast("long")), s["start"])
    after = lambda s: cut("_pieces", s["end"], F.least(s["end"] + AROUND, F.col("_n")))
    seen = F.transform(F.concat(*[own(i, k) for i, k in enumerate(GENERATORS)]), lambda s: F.struct(s["generator"].alias("generator"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), before(s).alias("before"), after(s).alias("after")))
    described = F.transform(seen, lambda c: F.struct(c["generator"].alias("generator"), c["start"].alias("start"), c["end"].alias("end"), features(c).alias("x")))
    return df.withColumn("_all", described).drop("_pieces", "_n", *[f"_{k}" for k in GENERATORS])


# Templates of labelled lines. # stands for a digit, ^ for a capital, % for a hexadecimal digit, & for a letter
# or digit, * for a word. Long runs of digits that pass the check of cards are a base kind, so the ones left are harmless;
# so are bare digests.
PERSONAL = [
    "(###) ###-####", "###-###-####", "###.###.####", "+## ## #### ####", "+# (###) ###-####", "0# ## ## ## ##", "tel #### ######", "tel (###) ######", "phone ### ### ####", "mobile: #### ### ###",
    "fax ##-####-####", "Telefon #### #######", "teléfono ### ## ## ##", "tél. 0# ## ## ## ##", "call ###-####", "ssn ###-##-####", "my ssn is ###-##-####", "###-##-####", "social security number ### ## ####",
    "iban ^^## #### #### #### ####", "IBAN: ^^## #### #### #### #### ##", "account ##########", "Konto ##########", "cuenta ##########", "compte ##########", "account no. ########", "passport #########", "pasaporte #########",
    "AKIA^^^^#^^^#^^^^##^", "AKIA#^^^#^^^^^^##^^^", "AKIA^^^^^^^^^^^^^##^", "AIza&&&&&&&&&&&&&&#&&&&&^&&&&&&&&&^&", "^&#&&^&&#&&^&&&#", "^#^#^#^#^#^#^#^#^#^#", "&&^&#&&^&#&&^&#&&^&#",
    "password=%%%%%%%%", "Passwort: *####", "passwort=*##", "contraseña = *##", "contraseña: &&&&&&&#", "mot de passe : %%%%%%%#", "pwd: &&&&&&&#&&", "clave=#&&&&&&&", "kennwort: &&&#&&&!", "password: ^*##!", "key: %%%%%%%%%%%#",
    "token=^^^#%%#^%%#^", "secret = %%%%%%%%%#", 'token = "%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%"', 'api_key: "&&&&&&&&&&&&&#&&&&&&&&&&&&&"', "pin: ####", "pin = ######", "api-key=&&&&-&&&&-&&#&", "password=*#&@*.&&.com!*", "pwd=&&&#&!&&$&&", "secret: *-*-#*-*", "token=*.#*.*/*", "password: *&@*#",
    "fe80::%%%%:%%%%:%%%%:%%%#", "2001:db8::%%%#:#", "2001:#%:%#::%%%#", "fe80::%#", "ghp_&&&&&#&&&&&&&&&&^&&&&&&&&&#&&&&", "sk-&&&^&#&&&&&&&&&^&&&&&&&&", "xoxb-#########^&&&&&&&&&#&&&", "^^## #### #### #### #### ##",
    "%%:%%:%%:%%:%%:%#", "#%:%%:%%:%%:%%:%%", "%%-%%-%%-%%-%%-%#", "#%-%%-%%-%%-%%-%%", "%%%%:%%%%:%%%%:%%%%:%%%%:%%%%:%%%%:%%%#", "#%%%:%%%%:%%%%:%%%%:%%%%:%%%%", "ab:cd:ef:fa:ce:bd", "dc-af-be-ed-fa-cb", "de:ad:be:ef:ca:fe",
    "*.* at * dot com", "* [at] * [dot] org", "*(at)*.net", "* at * dot com", "* at * dot net", "* arroba * punto es", "* arroba * punto com", "* (at) * (dot) de", "*## at * dot fr", "* [at] * punkt de", "*.* @ * . com",
    # longer than any usual value
    "token=" + "&%^#" * 80, "key: " + "#^%." * 60, "secret=" + "%^" * 110, "api_key = " + "^%#-" * 70, "^%#^" * 40, "^#^%" * 75, "^^#" * 55, "%%%%:" * 19 + "%%%#", "%%:" * 31 + "%#",
    " ".join(["###-###-####"] * 5), " ".join(["+## ### ### ####"] * 4), " ".join(["###.###.####"] * 7),
]
HARMLESS = [
    "20##-0#-0# 0#:0#", "19##-20##", "$# ### ###.##", "#.#######", "0.########", "# ### ###", "#, ##, ### and ####", "#.#.#.#", "version #.##.#", "##/##/20##", "0#.0#.19## 0#.0#.20##", "# # # # # # # #", "1 2 3 4 5 6 7 8",
    "2 4 6 8 10 12 14", "################", "################", "4###############", "###############", "##############", "#### #### #### ####", "####-####-####-####", "##########", "##### ##### #####", "##-##-##-##", "####-##-##",
    "20##-##-## 20##-##-##", "isbn ###-#-##-######-#", "isbn ###-#-####-####-#", "## ### ### *", "#e#######", "3.14159265", "2.71828182", "100 000 000", "1 000 000 000", "#" * 60, "# " * 50 + "#", "#.## #.## #.## #.##",
    "%" * 40, "%" * 39 + "#", "%" * 31 + "#", "%" * 17 + "#", "%" * 128, "*#*#*", "***#", "*#**", "***##", "*" * 4 + "#", "##" + "*" * 4, "page#########*#", "%" * 64,
    "key: *", "key = *", "token: *", "pin: *", "password: *", "clave: *", "Schlüssel: *", "secret: *", "key: **", "token = **", "mot de passe : *", "passwort: *", "pin: *.",
    "lat ##.#### #.####", "## #### ##.####", "ab::cd", "cafe::bad", "a::be", "dd::fa::ce", "abc-*-*-*", "no-*****************", "^^## ####", "^^##",
    "0#:0#:0#:0#", "0#:0#:0#:##", "ab-cd-ab-ed", "bad-fed-dad-bee", "face-bead-cafe-deed", "##-##-##-##-##", "####-##-##-##", "20##-0#-0#-0#", "be-ad-ed-be", "10-20-30-40", "ace-bad-cab-fee", "1:20:30:40", "12:30:45:10", "####-####-####-####-####",
    "* at * dot the", "look at *. ^*", "* at the *", "at ## dot #", "* at *. ^*", "that *. ^*", "*at **. ^*", "*at *. ^*", "* at * point of", "* at * dot *", "what *. And", "at *. Then", "eat *. ^*ed", "that of. As", "* at * . *", "rat in. On",
]


def examples(spark: SparkSession, n: int = EXAMPLES, seed: int = SEED, templates: list[tuple[str, bool]] | None = None) -> DataFrame:
    """Labelled lines (id, template, text, personal): templates filled by hashes of the seed, between made-up words."""
    forms = templates or [(x, True) for x in PERSONAL] + [(x, False) for x in HARMLESS]
    draw = lambda *x: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), *x), F.lit(1 << 30))
    letters = lambda s, m: F.substring(F.lit(s), (draw(F.lit(s), m) % len(s) + 1).cast("int"), F.lit(1))
    word = lambda *x: F.translate(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("id"), *x), 256), F.lit(1), (draw(*x) % 5 + 2).cast("int")), "0123456789", "etaoinshrd")
    digits, capitals = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def fill(c: Column, i: Column) -> Column:
        of = F.when(c == "#", letters(digits, i)).when(c == "^", letters(capitals, i)).when(c == "%", letters(digits + "abcdef", i))
        return of.when(c == "&", letters(capitals + capitals.lower() + digits, i)).when(c == "*", word(i)).otherwise(c)

    drawn = F.array(*[F.struct(F.lit(x).alias("form"), F.lit(y).alias("personal")) for x, y in forms])
    rows = spark.range(0, n, 1, 4).withColumn("template", (F.col("id") % len(forms)).cast("int")).withColumn("t", F.get(drawn, F.col("template")))
    filled = F.array_join(F.transform(F.split("t.form", ""), fill), "")
    return rows.select("id", "template", F.concat_ws(" ", word(F.lit("a")), word(F.lit("b")), filled, word(F.lit("c"))).alias("text"), F.col("t.personal").alias("personal"))


class Model:
    """Boosted trees of one or more fits, whose mean is the score, as arrays of complete binary trees of one depth, and a threshold
    for every generator."""

    feature: list[int]
    limit: list[float]
    value: list[float]

    def __init__(self, fits: list, depth: int, thresholds: dict[str, float]):
        inner, self.depth, self.thresholds, self.trees = (1 << depth) - 1, depth, thresholds, 0
        self.feature, self.limit, self.value = [], [], []
        for tree, weight in ((t, w / len(fits)) for fit in fits for t, w in zip(fit.trees, fit.treeWeights, strict=True)):
            feature, limit, value = [0] * inner, [float("inf")] * inner, [0.0] * (inner + 1)
            todo = [(0, tree._call_java("rootNode"))]
            while todo:
                at, node = todo.pop()
                if at >= inner:
                    value[at - inner] = weight * node.prediction()
                elif node.subtreeDepth() == 0:
                    todo.append((2 * at + 1, node))  # a leaf above the last level: always the left way
                else:
                    split = node.split()
                    feature[at], limit[at] = split.featureIndex(), split.threshold()
                    todo += [(2 * at + 1, node.leftChild()), (2 * at + 2, node.rightChild())]
            self.feature += feature
            self.limit += limit
            self.value += value
            self.trees += 1

    def score(self, x: Column) -> Column:
        """The rounded sum of the trees' values for an array of FEATURES."""
        constant = lambda values, kind: F.array(*map(F.lit, values)).cast(f"array<{kind}>")
        feature, limit, value, inner = constant(self.feature, "int"), constant(self.limit, "double"), constant(self.value, "double"), (1 << self.depth) - 1

        def leaf(tree: Column) -> Column:
            step = lambda at, _: 2 * at + F.when(F.get(x, F.get(feature, tree * inner + at)) <= F.get(limit, tree * inner + at), 1).otherwise(2)
            return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), step) - inner

        return F.round(F.aggregate(F.sequence(F.lit(0), F.lit(self.trees - 1)), F.lit(0.0), lambda s, t: s + F.get(value, t * (inner + 1) + leaf(t))), 3)


def train(spark: SparkSession, *, n: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION) -> Model:
    """Trees of each part of the templates left out in turn, which are the model together. Every line is scored by the trees that
    saw no line of its template; of these scores, a generator's threshold is the lowest from which on its candidates reach the
    precision, or that of the most precise ones."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    fold = F.pmod(F.xxhash64("template", F.lit(seed)), F.lit(FOLDS)).cast("int")
    rows = candidates(examples(spark, n, seed), "text").select(F.col("personal").cast("double").alias("label"), fold.alias("fold"), F.explode("_all").alias("c"))
    rows = rows.select("label", "fold", "c.generator", "c.x", array_to_vector("c.x").alias("vector")).coalesce(1).cache()
    learner = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=seed, stepSize=0.3)
    fits = [learner.fit(rows.filter(F.col("fold") != k)) for k in range(FOLDS)]
    unseen = F.coalesce(*[F.when(F.col("fold") == k, Model([fit], DEPTH, {}).score(F.col("x"))) for k, fit in enumerate(fits)])
    held = rows.groupBy("generator", unseen.alias("score")).agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    rows.unpersist()
    return Model(fits, DEPTH, {kind: threshold([(r.score, r.good, r.n) for r in held if r.generator == i], precision) for i, kind in enumerate(GENERATORS)})


def threshold(scores: list[tuple[float, float, int]], precision: float) -> float:
    """The lowest score from which on the precision is reached, or else that of the highest one; from (score, good ones, all).
    Good and bad candidates weigh the same in all, whatever the numbers of their templates."""
    every = max(sum(g for _, g, _ in scores), 1), max(sum(n - g for _, g, n in scores), 1)
    good = bad = 0.0
    reached = [(0.0, 0.0)]
    for score, own, count in sorted(scores, reverse=True):
        good, bad = good + own / every[0], bad + (count - own) / every[1]
        reached.append((min(precision, good / (good + bad)), -score))
    return -max(reached)[1]


#: The model of train() with its usual parameters, as written by ``python -m hyperloom.llm.pii``; a test makes it again.
FILE = Path(__file__).with_name("pii_model.json")


def saved(model: Model) -> str:
    return json.dumps({"features": FEATURES, "generators": list(GENERATORS), **vars(model)})


def trained() -> Model:
    """The model in FILE: the labelled lines don't depend on a table, so it needn't be fitted for each."""
    held = json.loads(FILE.read_text())
    if held.pop("features") != FEATURES or held.pop("generators") != list(GENERATORS):
        raise ValueError(f"{FILE.name} is of other features: make it again by python -m hyperloom.llm.pii")
    model = Model([], held["depth"], {})
    vars(model).update(held)
    return model


def detect(df: DataFrame, *, text: str = "text", model: Model | None = None) -> DataFrame:
    """Adds base and added, arrays of spans (start, kind_order, kind, end) in order; the text column stays as it is."""
    model = model or trained()
    df, apart = set_apart(without(df, "base", "added"), text)
    df = df.withColumn("_text", text_or_empty(text))
    df = found(df, "_text", BASE)
    order = [*BASE, *GENERATORS]

    def checked(k: str) -> Column:
        span = lambda s: F.struct(s["start"].alias("start"), F.lit(order.index(k)).alias("kind_order"), F.lit(k).alias("kind"), s["end"].alias("end"))
        return F.transform(F.filter(f"_{k}", lambda s: valid(k, s)), span)

    df = df.withColumn("base", F.array_sort(F.concat(*map(checked, BASE)))).drop(*[f"_{k}" for k in BASE])
    df = candidates(df, "_text")
    names, limits = F.array(*map(F.lit, GENERATORS)), F.array(*[F.lit(float(model.thresholds[k])) for k in GENERATORS])
    df = df.withColumns({"_starts": F.transform("base", lambda b: b["start"]), "_reach": highest(F.transform("base", lambda b: b["end"]))})
    # of the base spans that start no later, one reaches as far
    inside = lambda c: F.coalesce(F.get("_reach", at_most("_starts", c["start"]) - 1) >= c["end"], F.lit(False))
    chosen = F.filter("_all", lambda c: (model.score(c["x"]) >= F.get(limits, c["generator"])) & ~inside(c))
    span = lambda c: F.struct(c["start"].alias("start"), (c["generator"] + len(BASE)).alias("kind_order"), F.get(names, c["generator"]).alias("kind"), c["end"].alias("end"))
    return df.withColumn("added", F.array_sort(F.transform(chosen, span))).drop("_all", "_text", "_starts", "_reach").withColumnsRenamed(apart)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(df: DataFrame, *, text: str = "text", model: Model | None = None) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base_sha256 and spans."""
    df, names = set_apart(without(df, *(f"n_{k}" for k in BASE), "base_sha256", "spans"), text)
    out = detect(df, text=text, model=model)

    def count(k: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = {f"n_{k}": count(k) for k in BASE}
    every = F.array_sort(F.concat("base", "added"))
    return out.withColumns(counts | {"base_sha256": F.sha2(listed(F.col("base")), 256), "spans": listed(every)}).drop("base", "added").withColumnsRenamed(names)


def redact(df: DataFrame, *, text: str = "text", model: Model | None = None) -> DataFrame:
    """The rows with each span, or run of overlapping spans, replaced by its first kind in brackets; nulls stay null."""
    df, names = set_apart(df, text)
    columns = df.columns
    out = detect(df, text=text, model=model).withColumn("_spans", F.array_sort(F.concat("base", "added")))
    out = out.withColumn("_ends", highest(F.transform("_spans", lambda s: s["end"])))
    # a span that starts where all before it have ended begins a run, which ends where the next one begins
    begins = F.filter(F.sequence(F.lit(0), F.size("_spans") - 1), lambda i: (i == 0) | (F.get("_ends", i - 1) <= F.get("_spans", i)["start"]))
    out = out.withColumn("_begins", F.when(F.size("_spans") > 0, begins))
    following = F.concat(F.slice("_begins", F.lit(2), F.size("_begins")), F.array(F.size("_spans")))
    run = lambda a, b: F.struct(F.get("_spans", a)["start"].alias("start"), F.get("_ends", b - 1).alias("end"), F.get("_spans", a)["kind"].alias("kind"))
    out = out.withColumns({"_merged": F.zip_with("_begins", following, run), "_pieces": F.when(F.size("_spans") > 0, pieces_of(text))})
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("_merged", lambda s: s["end"]))
    starts = F.concat(F.transform("_merged", lambda s: s["start"]), F.array(F.length(text).cast("long")))
    between = F.zip_with(ends, starts, lambda a, b: cut("_pieces", a, b))
    marks = F.concat(F.transform("_merged", lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))), F.array(F.lit("")))
    clean = F.array_join(F.zip_with(between, marks, lambda a, b: F.concat(a, b)), "")
    return out.withColumn(text, F.when(F.size("_spans") > 0, clean).otherwise(F.col(text))).select(*columns).withColumnsRenamed(names)


if __name__ == "__main__":
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    FILE.write_text(saved(train(session)) + "\n")
    session.stop()
