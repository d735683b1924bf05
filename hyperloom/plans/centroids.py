"""Queries: models of several centroids, baselines, spectra, entropy sets, episode scores, and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperloom.functions.itemmem import packed
from hyperloom.operators import boost as bo
from hyperloom.operators import encode as en
from hyperloom.operators import features as fe
from hyperloom.operators import kernel as ke
from hyperloom.operators import neighbours as ne
from hyperloom.operators import predict as pr
from hyperloom.operators import sweep as sw
from hyperloom.operators import train as tr
from hyperloom.plans import models as mo
from hyperloom.plans import signals as si
from hyperloom.plans.registry import ENC, IM, LEVELS, LV, ORACLES, STEP, WINS, D, L, S, bit_sql, encoded, hv_sql, levels, listed_words, query, rounded, shown, table, vectors
from hyperloom.sources.scratch import kept, scratch

# ---- two classes of five centroids: class = label mod 2, centroid = label div 2

CM = f"""{ENC}, cm2 AS (SELECT label % 2 AS class, label // 2 AS centroid, pos, sum(bit)::BIGINT AS acc, count(*) AS n, (sum(bit) > count(*) // 2)::INT AS bit FROM enc GROUP BY ALL),
    cd AS (SELECT win, label % 2 AS y, class, centroid, sum(xor(enc.bit, cm2.bit))::INT AS dist FROM enc JOIN cm2 USING (pos) GROUP BY ALL)"""
NEAR = "nr AS (SELECT win, y, min(dist * 100 + centroid) FILTER (class = 0) AS a, min(dist * 100 + centroid) FILTER (class = 1) AS b FROM cd GROUP BY 1, 2)"


def centroid_rows(spark, sf) -> DataFrame:
    return encoded(spark, sf).select("win", (F.col("label") % 2).alias("y"), (F.col("label") % 2).alias("class"), F.floor(F.col("label") / 2).cast("int").alias("centroid"), "pos", "bit")


def centroid_model(rows: DataFrame) -> DataFrame:
    return tr.train_bundle(rows, ["class", "centroid"])


def centroid_distances(spark, sf) -> DataFrame:
    rows = centroid_rows(spark, sf)
    return pr.distances(packed(rows, "win", "y"), packed(centroid_model(rows), "class", "centroid"), ["win", "y"])


@query(f"WITH {CM}, {NEAR} SELECT win, (b // 100 < a // 100)::INT AS pred, (CASE WHEN b // 100 < a // 100 THEN b % 100 + 1 ELSE -(a % 100) - 1 END)::INT AS centroid FROM nr")
def prd4_nearest_centroids(spark, sf):
    rows = centroid_rows(spark, sf)
    model = kept(spark, "model")(packed(centroid_model(rows), "class", "centroid"))
    out = pr.nearest_multi(pr.nearness(packed(rows, "win"), model, ["win"]), ["win"])
    return out.select("win", "pred", F.col("centroid").cast("int").alias("centroid"))


@query(f"""WITH {CM}, {NEAR}, mv AS (SELECT win, y, a % 100 AS c0, b % 100 AS c1 FROM nr WHERE (b // 100 < a // 100)::INT <> y),
    g AS (SELECT y AS class, CASE WHEN y = 0 THEN c0 ELSE c1 END AS centroid, pos, sum(bit) AS da, count(*) AS dn FROM enc JOIN mv USING (win) GROUP BY ALL UNION ALL SELECT 1 - y, CASE WHEN y = 0 THEN c1 ELSE c0 END, pos, -sum(bit), -count(*) FROM enc JOIN mv USING (win) GROUP BY ALL),
    gs AS (SELECT class, centroid, pos, sum(da) AS da, sum(dn) AS dn FROM g GROUP BY ALL)
    SELECT class, centroid, pos, (acc + coalesce(da, 0))::DOUBLE AS acc, (n + coalesce(dn, 0))::DOUBLE AS n, (acc + coalesce(da, 0) > (n + coalesce(dn, 0)) / 2)::INT AS bit FROM cm2 LEFT JOIN gs USING (class, centroid, pos)""")
def trn9_centroid_update(spark, sf):
    """A pass with a frozen model: the nearest centroid of the right class gains a wrongly predicted window's vector, the
    nearest of the other class loses it."""
    rows = centroid_rows(spark, sf)
    near = lambda c: F.min(F.when(F.col("class") == c, F.struct("dist", "centroid")))
    both = centroid_distances(spark, sf).groupBy("win", "y").agg(near(0).alias("a"), near(1).alias("b"))
    moved = both.filter((F.col("b.dist") < F.col("a.dist")).cast("int") != F.col("y"))
    own = F.when(F.col("y") == 0, F.col("a.centroid")).otherwise(F.col("b.centroid"))
    other = F.when(F.col("y") == 0, F.col("b.centroid")).otherwise(F.col("a.centroid"))
    moved = moved.select("win", own.alias("own"), other.alias("other"))
    wrong = rows.select("win", "y", "pos", "bit").join(moved, "win").withColumn("weight", F.lit(1.0))
    # gains and losses go to centroids of different numbers, so each is an update of its own
    model = centroid_model(rows).withColumns({"acc": F.col("acc").cast("double"), "n": F.col("n").cast("double")})
    gains = wrong.select(F.col("own").alias("centroid"), F.col("y").alias("label"), F.col("y").alias("pred"), "pos", "bit", "weight")
    losses = wrong.select(F.col("other").alias("centroid"), (1 - F.col("y")).alias("label"), (1 - F.col("y")).alias("pred"), "pos", "bit", (-F.col("weight")).alias("weight"))
    return tr.updated(model, gains.unionByName(losses), ["centroid"], subtract=False).select("class", "centroid", "pos", "acc", "n", "bit")


@query(f"""WITH {CM}, sz AS (SELECT DISTINCT class, centroid, n FROM cm2), rk AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n, centroid) AS r, count(*) OVER (PARTITION BY class) AS k FROM sz),
    lf AS (SELECT s.step::INT AS step, class, centroid FROM rk, unnest(range(0, 4)) AS s(step) WHERE r > (k * s.step) // 4 OR r = k), pd AS (SELECT step, win, y, min(dist * 10 + class) % 10 AS pred FROM cd JOIN lf USING (class, centroid) GROUP BY ALL),
    sc AS (SELECT step, round(avg((pred = y)::INT), 6) AS "right" FROM pd GROUP BY 1), nn AS (SELECT step, count(*) AS centroids FROM lf GROUP BY 1), bs AS (SELECT *, max("right") OVER (ORDER BY step) AS best FROM sc)
    SELECT step, centroids, "right", min(("right" >= best - 0.02)::INT) OVER (ORDER BY step) AS kept FROM bs JOIN nn USING (step)""")
def trn11_removal_scores(spark, sf):
    """The share of right windows at every step of dropping the smallest centroids; kept until it first falls under the best so far."""
    rows = centroid_rows(spark, sf)
    left = tr.reduce_by_removal(centroid_model(rows).select("class", "centroid", "n").distinct(), [], 4)
    scored = centroid_distances(spark, sf).join(left.select("step", "class", "centroid"), ["class", "centroid"])
    best = scored.groupBy("step", "win", "y").agg(F.min(F.struct("dist", "class"))["class"].alias("pred"))
    right = best.groupBy("step").agg(F.round(F.avg((F.col("pred") == F.col("y")).cast("int")), 6).alias("right")).join(left.groupBy("step").agg(F.count("*").alias("centroids")), "step")
    w = W.orderBy("step")  # one row for each step
    return right.withColumn("_best", F.max("right").over(w)).withColumn("kept", F.min((F.col("right") >= F.col("_best") - 0.02).cast("int")).over(w)).select("step", "centroids", "right", "kept")


def counters(spark, sf) -> DataFrame:
    rows = centroid_model(centroid_rows(spark, sf)).select("class", "centroid", "pos", F.col("acc").alias("a"), "n")
    return tr.with_bits(rows, ["class", "centroid"])


def listed(model: DataFrame) -> DataFrame:
    return model.select("class", "centroid", "n", F.array_join(F.transform("acc", lambda x: x.cast("string")), ",").alias("acc"), F.array_join(F.transform("hv", lambda x: x.cast("string")), ",").alias("hv"))


@query(f"""WITH {CM}, pq AS (SELECT a.class, a.centroid, a.n, b.centroid AS into_, sum(xor(a.bit, b.bit)) AS dist FROM cm2 a JOIN cm2 b ON a.class = b.class AND a.centroid <> b.centroid AND a.pos = b.pos GROUP BY ALL),
    nq AS (SELECT class, centroid, n, min(dist * 100 + into_) AS best, avg(dist) AS mean FROM pq GROUP BY ALL), sm AS (SELECT class, arg_min(centroid, n * 100 + centroid) AS centroid, arg_min(best, n * 100 + centroid) AS best, arg_min(mean, n * 100 + centroid) AS mean FROM nq GROUP BY 1),
    mg AS (SELECT class, centroid, best % 100 AS into_ FROM sm WHERE best // 100 < mean), r AS (SELECT cm2.class, coalesce(into_, cm2.centroid)::INT AS centroid, pos, sum(acc)::BIGINT AS acc, sum(n)::BIGINT AS n FROM cm2 LEFT JOIN mg ON cm2.class = mg.class AND cm2.centroid = mg.centroid GROUP BY ALL),
    w AS (SELECT class, centroid, n, pos // 32 AS w, sum((acc > n // 2)::BIGINT << (pos % 32))::BIGINT AS v FROM r GROUP BY ALL), t AS (SELECT class, centroid, n, string_agg(v::VARCHAR, ',' ORDER BY w) AS hv FROM w GROUP BY ALL)
    SELECT t.class, t.centroid, t.n, string_agg(r.acc::VARCHAR, ',' ORDER BY pos) AS acc, hv FROM t JOIN r USING (class, centroid) GROUP BY ALL""")
def trn12_merge_step(spark, sf):
    """Each class's smallest centroid is merged into its nearest one."""
    return listed(tr.merged_model(counters(spark, sf), [], D, 1.0))


@query()
def trn12_merge_until(spark, sf):
    """The same again and again, while the smallest one is clearly nearer to another than to all."""
    return listed(tr.reduce_by_merging(counters(spark, sf), [], D, 0.9, kept(spark, "merged")))


# ---- baselines

INTS = "iv AS (SELECT vec_id, label, vec_id % 5 = 0 AS held, list_transform(embedding, x -> floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings)"


@query(f"""WITH {INTS}, pq AS (SELECT a.vec_id, b.vec_id AS other, b.label, list_sum(list_transform(list_zip(a.v, b.v), p -> (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM iv a JOIN iv b ON a.held AND NOT b.held),
    nq AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS r FROM pq), vt AS (SELECT vec_id, label, count(*) AS c FROM nq WHERE r <= 5 GROUP BY ALL)
    SELECT vec_id, arg_max(label, c * 1000 - label)::INT AS pred, round(max(c) / 5.0, 6) AS p FROM vt GROUP BY 1""".replace("x ->", "lambda x:").replace("p ->", "lambda p:"))
def trn14_prd9_knn(spark, sf):
    """Every fifth vector is predicted by its five nearest of the others."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(1024 * x.cast("double")).cast("long")).alias("v"))
    out = ne.knn(rows.filter("vec_id % 5 <> 0"), rows.filter("vec_id % 5 = 0"), 5, "vec_id")
    return rounded(out.withColumn("pred", F.col("pred").cast("int")), "p")


@query()
def trn14_prd9_all_baselines(spark, sf):
    """Two classes: what each classifier, fitted to four fifths of the vectors, says of the last fifth, with its probability."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 2).alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    train, test, out = rows.filter("vec_id % 5 <> 0").persist(), rows.filter("vec_id % 5 = 0"), None
    for kind in ("tree", "forest", "bagging", "boosting", "svm"):
        pred = tr.baseline(train, kind).transform(test)
        p = F.get(vector_to_array("probability"), F.col("prediction").cast("int")) if kind != "svm" else F.lit(None).cast("double")
        own = pred.select("vec_id", "label", F.lit(kind).alias("kind"), F.col("prediction").cast("int").alias("pred"), p.alias("p"))
        out = own if out is None else out.unionByName(own)
    return out


ROUNDS = 6


def boost_sql(k: int) -> str:
    """Round k on the margins s{k}: weights by feature, level and label, the stump of the least error, the margins after it."""
    return f"""h{k} AS MATERIALIZED (SELECT i AS f, level, y, sum(exp(-(2 * y - 1) * m)) AS w FROM s{k} JOIN lv USING (win) WHERE NOT held GROUP BY ALL),
    c{k} AS (SELECT f, t, sum(CASE WHEN (level > t)::INT = y THEN 0 ELSE w END) / sum(w) AS wrong FROM h{k}, unnest(range(0, {LEVELS - 1})) AS u(t) GROUP BY ALL),
    t{k} AS (SELECT round(wrong, 12) AS e, f, t, 0 AS o FROM c{k} UNION ALL SELECT round(1 - wrong, 12), f, t, 1 FROM c{k}),
    b{k} AS MATERIALIZED (SELECT e, f, t, 1 - 2 * o AS sign, 0.5 * ln((1 - greatest(e, 1e-10)) / greatest(e, 1e-10)) AS vote FROM t{k} ORDER BY e, f, t, o LIMIT 1),
    s{k + 1} AS MATERIALIZED (SELECT s.win, y, held, m + sign * vote * CASE WHEN level > t THEN 1 ELSE -1 END AS m FROM s{k} s JOIN lv USING (win) JOIN b{k} ON lv.i = b{k}.f)"""


BOOST = f"""{LV}, s0 AS MATERIALIZED (SELECT vec_id AS win, label % 2 AS y, vec_id % 5 = 0 AS held, 0::DOUBLE AS m FROM embeddings), {", ".join(boost_sql(k) for k in range(ROUNDS))}"""


def leveled_rows(spark, sf) -> DataFrame:
    rows = levels(spark, sf).groupBy("win", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "level"))), lambda x: x["level"]).alias("levels"))
    return rows.withColumn("label", F.col("label") % 2)


def stumps_of(spark, sf) -> tuple[DataFrame, list]:
    rows = kept(spark, "leveled")(leveled_rows(spark, sf))
    return rows, bo.boosted_stumps(rows.filter("win % 5 <> 0"), ROUNDS, LEVELS)


@query(f"WITH {BOOST} " + " UNION ALL ".join(f"SELECT {k + 1}::INT AS round, f::INT AS feature, t::INT AS cut, sign::INT AS sign, round(vote, 6) AS vote FROM b{k}" for k in range(ROUNDS)))
def trn14_boosted_stumps(spark, sf):
    """Stumps found on reweighted rows, one after another, with their votes."""
    _, stumps = stumps_of(spark, sf)
    out = spark.createDataFrame([(i + 1, s.feature, s.cut, s.sign, s.vote) for i, s in enumerate(stumps)], "round int, feature int, cut int, sign int, vote double")
    return rounded(out, "vote")


@query(f"WITH {BOOST} SELECT win, (m > 0)::INT AS pred, round(m, 6) AS margin FROM s{ROUNDS} WHERE held")
def trn14_prd9_boosted(spark, sf):
    """What they say of the rows that they weren't found on."""
    rows, stumps = stumps_of(spark, sf)
    m = bo.margin(stumps)
    return rounded(rows.filter("win % 5 = 0").select("win", (m > 0).cast("int").alias("pred"), m.alias("margin")), "margin")


@query()
def trn14_prd9_kernel_and_boosted_learners(spark, sf):
    """A machine with a Gaussian kernel, trees and linear machines on reweighted rows: predictions of every fifth vector."""
    from pyspark.ml import classification as c
    from pyspark.ml.functions import array_to_vector

    rows = kept(spark, "vectors")(table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 2).cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("v")))
    train, test = rows.filter("vec_id % 5 <> 0"), rows.filter("vec_id % 5 = 0")
    out = ke.KernelSVM(train).transform(test).select("vec_id", "label", F.lit("kernel").alias("kind"), F.col("prediction").cast("int").alias("pred"), F.lit(None).cast("double").alias("p"))
    vectors = lambda df: df.withColumn("features", array_to_vector("v"))
    for kind, learner in (("adaboost_tree", c.DecisionTreeClassifier(maxDepth=2, seed=1)), ("adaboost_svm", c.LinearSVC(maxIter=5))):
        said = bo.AdaBoost(vectors(train).select("label", "features"), learner, 4, kept(spark, "weights")).transform(vectors(test))
        out = out.unionByName(said.select("vec_id", "label", F.lit(kind).alias("kind"), F.col("prediction").cast("int").alias("pred"), "p"))
    return out


# ---- encoders

HOWS = {
    "FeatxVal": mo.maj(mo.FV, "win"), "ChxFeatxVal": mo.maj(f"SELECT win, q.pos, xor(q.bit, cm.bit) AS bit FROM {mo.maj(mo.FV, 'win, ch')} q JOIN cm ON q.ch = cm.ch AND q.pos = cm.pos", "win"),
    "FeatxChxVal": mo.maj(f"SELECT win, q.pos, xor(q.bit, fm.bit) AS bit FROM {mo.maj(mo.CV, 'win, f')} q JOIN fm ON q.f = fm.f AND q.pos = fm.pos", "win"),
    "ChFeatCombxVal": mo.maj("SELECT win, vm.pos, xor(pm.bit, vm.bit) AS bit FROM lv JOIN vm ON lv.level = vm.level JOIN pm ON lv.f * 8 + lv.ch = pm.pair AND pm.pos = vm.pos", "win"),
}


@query(mo.B0 + " UNION ALL ".join(f"SELECT '{how}' AS how, 0 AS block, win, hv FROM ({hv_sql(sql, 'win')})" for how, sql in HOWS.items()) + f" UNION ALL SELECT 'FeatAppend', block, win, hv FROM ({hv_sql(f'SELECT win, f::INT AS block, pos, bit FROM ' + mo.maj(mo.CV, 'win, f'), 'win', 'block')})")
def enc14_multi_feature(spark, sf):
    """The five bindings of several features for every channel, by the packed encoder."""
    m = en.Memories(spark, D, LEVELS, 8, 8)
    rows = levels(spark, sf).groupBy("win").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "level"))), lambda x: x["level"]).alias("levels"))
    out = None
    for how in [*HOWS, "FeatAppend"]:
        own = en.encode_packed(rows, m, how, ["win"], 8)
        own = own.select(F.lit(how).alias("how"), (F.col("block") if how == "FeatAppend" else F.lit(0)).alias("block"), "win", F.array_join(F.transform("hv", lambda x: x.cast("string")), ",").alias("hv"))
        out = own if out is None else out.unionByName(own)
    return out


# spectra of the 8 values of every channel: 5 frequencies, the magnitudes over the largest in 20 levels
SPECTRA = f"""{LV}, {IM}, dx AS (SELECT win, ch, k.i::INT AS f, sqrt(pow(sum(v * cos(2 * pi() * k.i * f / 8)), 2) + pow(sum(v * sin(2 * pi() * k.i * f / 8)), 2)) AS m FROM e, unnest(range(0, 5)) AS k(i) GROUP BY win, ch, k.i),
    sx AS (SELECT win, ch, f, least(floor(round(19 * m / max(m) OVER (PARTITION BY win, ch), 9)), 19)::INT AS level FROM dx), fv AS (SELECT win, sx.ch, sx.f, vm.pos, xor(fm.bit, vm.bit) AS bit FROM sx JOIN vm ON sx.level = vm.level JOIN fm ON sx.f = fm.f AND fm.pos = vm.pos)"""


def spectra(spark, sf) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("win"), "embedding").filter(F.size("embedding") > 0)
    by = lambda x: {"levels": [[c.tolist() for c in row] for row in zip(*fe.fft_peak_levels_by(x, 8, 8.0, 4.0, LEVELS))]}
    return fe.per_arrays(rows, ["win"], "embedding", by, {"levels": "array<array<int>>"})


def fft_sql(how: str) -> str:
    inner = mo.maj("SELECT * FROM fv", "win, ch")
    if how == "FreqxVal":
        return mo.maj(f"SELECT win, pos, bit FROM {inner}", "win")
    if how == "ChxFreqxVal":
        return mo.maj(f"SELECT win, q.pos, xor(q.bit, cm.bit) AS bit FROM {inner} q JOIN cm ON q.ch = cm.ch AND q.pos = cm.pos", "win")
    return mo.maj("SELECT win, vm.pos, xor(cm.bit, vm.bit) AS bit FROM sx JOIN vm ON sx.level = vm.level JOIN cm ON sx.ch = cm.ch AND (cm.pos - sx.f + 64) % 64 = vm.pos", "win")


FFT = ["FreqxVal", "ChxFreqxVal", "PermChFreqxVal"]


@query(f"WITH {SPECTRA} " + " UNION ALL ".join(f"SELECT '{how}' AS how, win, hv FROM ({hv_sql(fft_sql(how), 'win')})" for how in FFT))
def enc15_fft(spark, sf):
    m = en.Memories(spark, D, LEVELS, 8, 8)
    return listed_words(en.encode_spectra_packed(spectra(spark, sf), m, FFT, ["win"])).select("win", "hv", "how")


ORACLES["enc12_lbp"] = f"""WITH {S}, c AS (SELECT * FROM (SELECT subject, channel, t, {" + ".join(f"(lead(x, {i + 1}) OVER o > lead(x, {i}) OVER o)::INT * {1 << 5 - i}" for i in range(6))} AS lbp FROM s WINDOW o AS (PARTITION BY subject ORDER BY t)) WHERE lbp IS NOT NULL),
    n AS (SELECT subject, count(*) AS n FROM c GROUP BY 1), wi AS (SELECT subject, unnest(range(0, ((n - {L} + {STEP} - 1) // {STEP})::BIGINT)) AS win FROM n WHERE n > {L}), w AS (SELECT c.*, win FROM c JOIN wi ON c.subject = wi.subject AND t >= win * {STEP} AND t < win * {STEP} + {L}),
    p AS (SELECT unnest(range(0, {D}))::INT AS pos), vm AS (SELECT l.i::INT AS level, pos, {bit_sql("level", "l.i", "pos")} AS bit FROM unnest(range(0, 64)) AS l(i), p), cm AS (SELECT l.i::INT AS ch, pos, {bit_sql("ch", "l.i", "pos")} AS bit FROM unnest(range(0, 5)) AS l(i), p),
    b AS (SELECT subject, win, vm.pos, xor(vm.bit, cm.bit) AS bit FROM w JOIN vm ON w.lbp = vm.level JOIN cm ON cm.ch = list_position(['click', 'error', 'purchase', 'signup', 'view'], channel) - 1 AND cm.pos = vm.pos) """ + hv_sql("SELECT subject, win, pos, (sum(bit) > count(*) // 2)::INT AS bit FROM b GROUP BY ALL", "subject", "win")


# ---- spectra and entropies of windows

POWER = f"""{WINS}, q AS (SELECT subject, win, x, t - win * {STEP} AS i, avg(x) OVER (PARTITION BY subject, win) AS mean FROM w), dq AS (SELECT subject, win, k.i::INT AS f, pow(sum((x - mean) * cos(2 * pi() * k.i * q.i / 8)), 2) + pow(sum((x - mean) * sin(2 * pi() * k.i * q.i / 8)), 2) AS m2, pow(sum(x * cos(2 * pi() * k.i * q.i / 8)), 2) + pow(sum(x * sin(2 * pi() * k.i * q.i / 8)), 2) AS raw2 FROM q, unnest(range(0, 5)) AS k(i) GROUP BY subject, win, k.i)"""


@query(f"WITH {POWER}, r AS (SELECT subject, win, f, sqrt(raw2) / max(sqrt(raw2)) OVER v AS m FROM dq WINDOW v AS (PARTITION BY subject, win)) SELECT subject, win, f, round(m / sum(m) OVER (PARTITION BY subject, win), 6) AS v FROM r")
def fea14_spectrum_rows(spark, sf):
    return rounded(si.fea14_fft_spectrum(spark, sf).select("subject", "win", F.posexplode("spectrum").alias("f", "v")), "v")


#: Places of a band's first and last frequency among 0, 1, 2, 3 and 4 Hz: before the first above either end.
PLACES = {"total": (0, 4), "dc": (0, 0), "mov": (0, 0), "delta": (0, 4), "theta": (0, 4), "alpha": (0, 4), "middle": (0, 4), "beta": (0, 4), "gamma": (0, 4)}


@query(f"""WITH {POWER}, pw AS (SELECT subject, win, f, m2 / 64 * CASE WHEN f BETWEEN 1 AND 3 THEN 2 ELSE 1 END AS p FROM dq), tz AS (SELECT subject, win, f, (p + lead(p) OVER (PARTITION BY subject, win ORDER BY f)) / 2 AS a FROM pw),
    bd(band, lo, hi) AS (VALUES {", ".join(f"('{k}', {a}, {b})" for k, (a, b) in PLACES.items())}), bp AS (SELECT subject, win, band, coalesce(sum(a) FILTER (f >= lo AND f < hi), 0) AS v FROM tz, bd GROUP BY ALL)
    SELECT subject, win, band, round(v, 6) AS v, round(CASE WHEN max(v) FILTER (band = 'total') OVER z > 0 THEN v / max(v) FILTER (band = 'total') OVER z ELSE 0 END, 6) AS rel FROM bp WINDOW z AS (PARTITION BY subject, win)""")
def fea3_band_power_rows(spark, sf):
    wide = si.fea3_band_powers(spark, sf)
    rows = wide.select("subject", "win", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col(k).alias("v"), (F.col(f"rel_{k}") if k != "total" else F.when(F.col("total") > 0, 1.0).otherwise(0.0)).alias("rel")) for k in fe.BANDS])).alias("b"))
    return rounded(rows.select("subject", "win", "b.*"), "v", "rel")


@query(f"""WITH {WINS}, q AS (SELECT subject, win, t - win * {STEP} AS i, x, stddev_pop(x) OVER (PARTITION BY subject, win) AS sd FROM w), g AS (SELECT subject, win, i, sd, x AS a, lead(x, 1) OVER o AS b, lead(x, 2) OVER o AS c FROM q WINDOW o AS (PARTITION BY subject, win ORDER BY i)),
    h AS (SELECT p.subject, p.win, (greatest(abs(p.a - r.a), abs(p.b - r.b)) <= 0.2 * p.sd)::INT AS two, (greatest(abs(p.a - r.a), abs(p.b - r.b), abs(p.c - r.c)) <= 0.2 * p.sd)::INT AS three FROM g p JOIN g r ON p.subject = r.subject AND p.win = r.win AND p.i <> r.i AND p.i <= 5 AND r.i <= 5)
    SELECT subject, win, round(-ln((sum(three) + 0.001) / (sum(two) + 0.001)), 5) AS sampen FROM h GROUP BY 1, 2""")
def fea7_sample_entropy_rounded(spark, sf):
    return si.fea7_sample_entropy(spark, sf)


@query()
def fea10_feature_set_54(spark, sf):
    """37 entropies and 17 band powers of vectors as windows of 64 samples at 64 Hz."""
    return fe.feature_set(table(spark, sf, "embeddings").select("vec_id", "embedding"), ["vec_id"], "embedding", 54, 64.0)


@query()
def fea12_entropy_symbols(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return fe.per_array(rows, ["vec_id"], "embedding", fe.entropy_symbols_of, dict.fromkeys(fe.ENTROPIES, "int"), (10,))


# ---- episode scores: every true event in order uses the first predicted one that meets it and isn't used

NINE = mo.NINE


def episodes_sql(source: str) -> str:
    """Tables te and pe of the events of a source (subject, win, y_true, y), and ec (subject, tp, fn, fp)."""
    return f"""{mo.events_sql('te', source, 'y_true')}, {mo.events_sql('pe', source, 'y')},
    ep(subject, k, used, tp, far) AS (SELECT subject, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT subject FROM te UNION SELECT subject FROM pe)
        UNION ALL SELECT g.subject, g.k + 1, coalesce(min(p.event_id), g.used)::BIGINT, g.tp + (min(p.event_id) IS NOT NULL)::BIGINT, g.far + coalesce((arg_min(p.start, p.event_id) < t.start)::BIGINT + (arg_min(p.stop, p.event_id) > t.stop)::BIGINT, 0)
        FROM ep g JOIN te t ON t.subject = g.subject AND t.event_id = g.k + 1 LEFT JOIN pe p ON p.subject = g.subject AND p.event_id > g.used AND p.start < t.stop AND p.stop > t.start GROUP BY g.subject, g.k, g.used, g.tp, g.far, t.start, t.stop),
    mt AS (SELECT p.subject, count(*) AS c FROM pe p WHERE EXISTS (SELECT 1 FROM te t WHERE t.subject = p.subject AND p.start < t.stop AND p.stop > t.start) GROUP BY 1), np AS (SELECT subject, count(*) AS c FROM pe GROUP BY 1),
    ec AS (SELECT subject, max(k) AS events, max(tp) AS tp, max(k) - max(tp) AS fn, max(far) + any_value(coalesce(np.c, 0)) - any_value(coalesce(mt.c, 0)) AS fp FROM ep LEFT JOIN np USING (subject) LEFT JOIN mt USING (subject) GROUP BY 1)"""


def nine_sql(source: str) -> str:
    f1 = lambda s, p: f"CASE WHEN {s} + {p} > 0 THEN 2 * {s} * {p} / ({s} + {p}) WHEN {s} IS NOT NULL AND {p} IS NOT NULL THEN 0 END"
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) END"
    return f"""{episodes_sql(source)}, dc AS (SELECT subject, count(*) AS n, {ratio('sum(y * y_true)', 'sum(y_true)')} AS sens_d, {ratio('sum(y * y_true)', 'sum(y)')} AS prec_d FROM {source} GROUP BY 1),
    ed AS (SELECT dc.*, {ratio('tp', 'tp + fn')} AS sens_e, {ratio('tp', 'tp + fp')} AS prec_e, coalesce(fp, 0) / (n / 24.0) * 24 AS fp_per_day FROM dc LEFT JOIN ec USING (subject)),
    nf AS (SELECT *, {f1('sens_e', 'prec_e')} AS f1_e, {f1('sens_d', 'prec_d')} AS f1_d FROM ed), n9 AS (SELECT subject, {", ".join(f"round({c}, 6) AS {c}" for c in NINE if c not in ("f1_mean", "f1_gmean"))}, round((f1_e + f1_d) / 2, 6) AS f1_mean, round(sqrt(f1_e * f1_d), 6) AS f1_gmean FROM nf)"""


ALL = f"{mo.MERGE.replace('mg AS', 'mg0 AS')}"
ORACLES["evt3_episode_counts"] = f"WITH RECURSIVE {ALL}, mg AS (SELECT subject, win, y_true, y_s2 AS y FROM mg0), {episodes_sql('mg')} SELECT subject, tp::BIGINT AS tp, fn::BIGINT AS fn, fp::BIGINT AS fp FROM ec"


@query(f"WITH RECURSIVE {ALL}, mg AS (SELECT subject, win, y_true, y_s2 AS y FROM mg0), {nine_sql('mg')} SELECT * FROM n9")
def evt5_nine_scores(spark, sf):
    return mo.evt5_metrics9(spark, sf)


BAYES5 = "(SELECT subject, win, (nth >= 5 AND evidence >= 1.5)::INT AS y_bayes FROM e)"


@query(f"WITH RECURSIVE {mo.BAYES}, {ALL[ALL.index('v AS (SELECT') :]}, mx AS (SELECT mg0.*, y_bayes FROM mg0 JOIN {BAYES5} USING (subject, win)), mg AS ("
       + " UNION ALL ".join(f"SELECT subject || '|{c}' AS subject, win, y_true, {c} AS y FROM mx" for c in ("y", "y_s1", "y_s2", "y_bayes"))
       + f"), {nine_sql('mg')} SELECT split_part(subject, '|', 1)::BIGINT AS subject, split_part(subject, '|', 2) AS smoothing, {', '.join(NINE)} FROM n9")
def evt6_36_scores(spark, sf):
    return mo.evt6_metrics36(spark, sf)


@query(f"WITH RECURSIVE {mo.EL}, mg AS (SELECT element AS subject, row_number() OVER (PARTITION BY element ORDER BY win) - 1 AS win, y AS y_true, (d1 < d0)::INT AS y FROM el), {nine_sql('mg')} SELECT subject AS element, {', '.join(NINE)} FROM n9")
def evt8_scores_per_element(spark, sf):
    return mo.evt8_metrics_per_element(spark, sf)


@query(f"""WITH {mo.BAYES}, rg AS (SELECT subject, min(evidence) AS lo, max(evidence) AS hi FROM e GROUP BY 1), gr AS (SELECT subject, (lo + hi) / 2 + i * 0.2 AS t FROM (SELECT subject, lo, hi, unnest(range(0, floor((hi - (lo + hi) / 2) / 0.2)::BIGINT + 1)) AS i FROM rg)),
    sc AS (SELECT gr.subject, t, round(2 * sum((evidence >= t)::INT * y_true) / (sum((evidence >= t)::INT) + sum(y_true)), 9) AS f1 FROM gr JOIN e USING (subject) GROUP BY 1, 2), tp AS (SELECT *, max(f1) OVER (PARTITION BY subject) AS top FROM sc),
    bt AS (SELECT subject, quantile_cont(t, 0.5) AS t FROM tp WHERE f1 = top AND f1 > 0 GROUP BY 1) SELECT subject, round(coalesce(t, 1.5), 5) AS threshold FROM (SELECT DISTINCT subject FROM e) LEFT JOIN bt USING (subject)""")
def smo4_best_threshold(spark, sf):
    return mo.smo4_bayes_threshold(spark, sf)


#: Labels of the evidence of full windows at every threshold, each a subject of its own; its scores.
GRID = f"""{mo.BAYES}, fw AS (SELECT subject, min(evidence) AS lo, max(evidence) AS hi FROM e WHERE nth >= 5 GROUP BY 1), gd AS (SELECT subject, i, lo + 0.5::DOUBLE * (hi - lo) + i * 0.2::DOUBLE AS t
      FROM (SELECT subject, lo, hi, unnest(range(0, ceil((hi - (lo + 0.5::DOUBLE * (hi - lo))) / 0.2::DOUBLE)::BIGINT)) AS i FROM fw)),
    mg AS (SELECT subject || '|' || i AS subject, win, y_true, (nth >= 5 AND evidence >= t)::INT AS y FROM e JOIN gd USING (subject)), {episodes_sql('mg')}"""


@query(f"""WITH RECURSIVE {GRID} SELECT gd.subject, i::INT AS i, round(t, 6) AS threshold, coalesce(tp, 0)::BIGINT AS tp, coalesce(fn, 0)::BIGINT AS fn, coalesce(fp, 0)::BIGINT AS fp FROM gd LEFT JOIN ec ON ec.subject = gd.subject || '|' || gd.i""")
def smo4_threshold_scores(spark, sf):
    """Episodes hit, missed and made up at every threshold."""
    return rounded(sw.threshold_scores(mo.bayes(spark, sf), ["subject"], 5), "threshold")


@query(f"""WITH RECURSIVE {GRID}, sc AS (SELECT gd.subject, t, coalesce(round(2 * (tp / events) * (tp / nullif(tp + fp, 0)) / nullif(tp / events + tp / nullif(tp + fp, 0), 0), 9), 0) AS f1 FROM ec JOIN gd ON ec.subject = gd.subject || '|' || gd.i WHERE events > 0),
    tt AS (SELECT subject, f1, list_sort(list(t)) AS t FROM sc s WHERE f1 = (SELECT max(f1) FROM sc z WHERE z.subject = s.subject) GROUP BY 1, 2)
    SELECT subject, round(coalesce(t[len(t) // 2 + 1], 1.5), 6) AS threshold, round(f1, 6) AS f1 FROM (SELECT DISTINCT subject FROM e) LEFT JOIN tt USING (subject)""")
def smo4_episode_threshold(spark, sf):
    """The threshold of each subject's evidence whose events score best."""
    return rounded(sw.fit_threshold(mo.bayes(spark, sf), ["subject"], 5), "threshold", "f1")


def greedy_sql(steps: int) -> str:
    out = f"WITH {mo.EL}, gp AS (SELECT element, win, y, d0 - d1 AS gap FROM el)"
    for i in range(1, steps + 1):
        chosen = " UNION ALL ".join(f"SELECT element FROM b{j}" for j in range(1, i)) or "SELECT element FROM gp WHERE false"
        out += f""", c{i} AS (SELECT element, round(avg(((round(gap + coalesce(s, 0), 9) > 0)::INT = y)::INT), 6) AS value FROM gp LEFT JOIN (SELECT win, sum(gap) AS s FROM gp WHERE element IN ({chosen}) GROUP BY 1) USING (win) WHERE element NOT IN ({chosen}) GROUP BY 1),
        b{i} AS (SELECT {i} AS k, element, value FROM c{i} ORDER BY value DESC, element LIMIT 1)"""
    return out + " " + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(1, steps + 1))


ORACLES["sel6_greedy_order"] = greedy_sql(8)


# ---- logs and models on disk


@query("WITH n AS (SELECT max(len(embedding)) AS k FROM embeddings), p AS (SELECT unnest(range(0, 64))::INT AS pos), m AS (SELECT l.i::INT AS idx, pos, " + bit_sql("feat", "l.i", "pos") + " AS bit FROM (SELECT unnest(range(0, k)) AS i FROM n) l, p) " + hv_sql("SELECT * FROM m", "idx"))
def snk4_item_memory_read_back(spark, sf):
    from hyperloom.plans.streams import snk4_item_memory

    return snk4_item_memory(spark, sf)


@query(ORACLES["smp1_balance"].rpartition("SELECT subject AS event_recording")[0] + """, pairs AS (SELECT subject AS event_recording, start, stop, background_recording, row_number() OVER (PARTITION BY subject ORDER BY start)::INT AS nth FROM e JOIN b ON k % (SELECT count(*) FROM b) = j WHERE n >= need)
    SELECT 'r' || event_recording || '_e' || nth AS new_name, event_recording, start, stop, background_recording FROM pairs""")
def snk6_pairing_log(spark, sf):
    """Which background each new recording was made with, and its name, written and read back."""
    path = scratch(spark, "pairs")
    nth = F.row_number().over(W.partitionBy("event_recording").orderBy("start"))
    rows = si.smp1_balance(spark, sf).withColumn("new_name", F.concat(F.lit("r"), F.col("event_recording"), F.lit("_e"), nth))
    rows.select("new_name", "event_recording", "start", "stop", "background_recording").write.parquet(path)
    return spark.read.parquet(path)


# ---- the same results under the names of the operators

ORACLES |= {a: ORACLES[b] for a, b in (("evt5_metrics9", "evt5_nine_scores"), ("evt6_metrics36", "evt6_36_scores"), ("evt8_metrics_per_element", "evt8_scores_per_element"), ("smo4_bayes_threshold", "smo4_best_threshold"), ("fea7_sample_entropy", "fea7_sample_entropy_rounded"), ("snk4_item_memory", "snk4_item_memory_read_back"))}
ORACLES["fea3_band_powers"] = "SELECT subject, win, " + ", ".join([f"max(v) FILTER (band = '{k}') AS {k}" for k in PLACES] + [f"max(rel) FILTER (band = '{k}') AS rel_{k}" for k in PLACES if k != "total"]) + f" FROM ({ORACLES['fea3_band_power_rows']}) GROUP BY 1, 2"
