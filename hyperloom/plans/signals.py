"""Queries: sources, selection, windows, features, normalising, folds."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperloom.operators import features as fe
from hyperloom.operators import folds as fo
from hyperloom.operators import normalise as no
from hyperloom.operators import windows as wi
from hyperloom.plans.registry import E_, LV, STEP, WINS, L, S, levels, query, rounded, signal, table, vectors
from hyperloom.sources import tables as so
from hyperloom.sources.scratch import kept

K = ["subject"]
KW = ["subject", "win"]
REC = "rec AS (SELECT s.*, (t // 16)::BIGINT AS recording FROM s)"


def recorded(spark, sf):
    return signal(spark, sf).withColumn("recording", F.floor(F.col("t") / 16))


def windows(spark, sf):
    return wi.sliding_windows(signal(spark, sf), K, L, STEP)


EV = """r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t) - 1 AS i FROM s), g AS (SELECT *, i - row_number() OVER (PARTITION BY subject, label ORDER BY t) AS g, max(i) OVER (PARTITION BY subject) AS last FROM r),
    runs AS (SELECT subject, min(i) AS a, max(i) AS b, any_value(last) AS last FROM g WHERE label = 1 GROUP BY subject, g),
    ev AS (SELECT subject, greatest(a, 1)::BIGINT AS start, least(b + 1, last)::BIGINT AS stop FROM runs WHERE NOT (a = b AND (a = 0 OR b = last)))"""


def events_of(spark, sf):
    from hyperloom.operators.events import label_events

    return label_events(signal(spark, sf).withColumnRenamed("t", "win"), K, "label").drop("event_id")


@query(f"WITH {S}, {REC}, c AS (SELECT subject, recording, count(*) AS n FROM rec GROUP BY 1, 2) SELECT *, sum(n) OVER (PARTITION BY subject ORDER BY recording)::BIGINT AS \"end\" FROM c")
def src4_concat_recordings(spark, sf):
    return so.concat_recordings(recorded(spark, sf), K)


MARKS = "mk AS (SELECT user_id AS subject, event_id AS time, CASE event_type WHEN 'click' THEN 32 WHEN 'view' THEN 33 ELSE 0 END AS code FROM events)"


def marks(spark, sf):
    code = F.when(F.col("event_type") == "click", 32).when(F.col("event_type") == "view", 33).otherwise(0)
    return table(spark, sf, "events").select(F.col("user_id").alias("subject"), F.col("event_id").alias("time"), code.alias("code"))


@query(f"WITH {MARKS}, q AS (SELECT *, row_number() OVER (PARTITION BY subject, code ORDER BY time)::INT AS nth FROM mk WHERE code > 0) SELECT a.subject, a.nth, a.time AS start, b.time AS stop FROM q a JOIN q b ON a.subject = b.subject AND a.nth = b.nth AND a.code = 32 AND b.code = 33")
def src5_pair_marks(spark, sf):
    return so.pair_marks(marks(spark, sf), K)


@query(f"WITH {MARKS} SELECT subject, code, trunc(time / 512.0::DOUBLE * 256.0)::BIGINT AS time FROM mk")
def src6_rescale_marks(spark, sf):
    return so.rescale_marks(marks(spark, sf), 512.0, 256.0)


ADMIT = """q AS (SELECT o_custkey % 50 AS subject, o_custkey AS recording, CASE WHEN o_custkey % 7 = 0 THEN 512.0 ELSE 256.0 END AS rate, count(DISTINCT o_orderpriority) AS channels, count(*) AS length FROM orders GROUP BY o_custkey),
    r AS (SELECT *, CASE WHEN rate <> 256 THEN 'rate' WHEN channels < 3 THEN 'channels' WHEN length < 6 THEN 'length' END AS reason FROM q)"""


@query(f"WITH {ADMIT} SELECT subject, count(*) FILTER (reason IS NULL) AS good, count(*) FILTER (reason = 'rate') AS bad_rate, count(*) FILTER (reason = 'channels') AS bad_channels, count(*) FILTER (reason = 'length') AS bad_length, count(*) FILTER (reason IS NULL) >= 3 AS enough FROM r GROUP BY 1")
def src8_admit_recordings(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("channels"), F.count("*").alias("length"))
    r = o.select((F.col("o_custkey") % 50).alias("subject"), F.col("o_custkey").alias("recording"), F.when(F.col("o_custkey") % 7 == 0, 512.0).otherwise(256.0).alias("rate"), "channels", "length")
    return so.admit(r, rate=256.0, channels=3, length=6, wanted=3)[1]


@query("SELECT l_returnflag AS flag, name, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT l_returnflag, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS name, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem) GROUP BY 1, 2")
def src3_long_features(spark, sf):
    rows = so.long_features(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity", "l_extendedprice", "l_discount", "l_tax"), "flag")
    return rounded(rows.groupBy("flag", "name").agg(F.count("*").alias("n"), F.avg("v").alias("mean")), "mean")


@query(f"WITH {S}, ok AS (SELECT subject FROM s WHERE channel IN ('click', 'view', 'purchase') GROUP BY 1 HAVING count(DISTINCT channel) = 3) SELECT subject, channel, t, x, label, list_position(['click', 'view', 'purchase'], channel)::INT - 1 AS pos FROM s JOIN ok USING (subject) WHERE channel IN ('click', 'view', 'purchase')")
def prj1_select_channels(spark, sf):
    return fo.select_channels(signal(spark, sf), K, ["click", "view", "purchase"])


@query(f"WITH {S} SELECT subject, recording, CASE WHEN count(DISTINCT channel) FILTER (channel IN ('click', 'view')) = 2 THEN 'a' WHEN count(DISTINCT channel) FILTER (channel IN ('error', 'purchase')) = 2 THEN 'b' END AS vocabulary FROM (SELECT *, (t // 4)::BIGINT AS recording FROM s) GROUP BY 1, 2")
def prj2_resolve_channels(spark, sf):
    return fo.resolve_channels(signal(spark, sf).withColumn("recording", F.floor(F.col("t") / 4)), ["subject", "recording"], ["click", "view"], ["error", "purchase"])


NTH = "c AS (SELECT user_id AS subject, event_type AS channel, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS t, value AS x FROM events)"


@query(f"WITH {NTH} SELECT a.subject, a.t, 'click-view' AS channel, round(-(a.x - b.x), 6) AS x FROM c a JOIN c b ON a.subject = b.subject AND a.t = b.t AND a.channel = 'click' AND b.channel = 'view' UNION ALL SELECT a.subject, a.t, 'view-error', round(-(a.x - b.x), 6) FROM c a JOIN c b ON a.subject = b.subject AND a.t = b.t AND a.channel = 'view' AND b.channel = 'error'")
def prj3_derive_pairs(spark, sf):
    place = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1
    c = table(spark, sf, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("channel"), place.cast("long").alias("t"), F.col("value").alias("x"))
    return rounded(fo.derive_pairs(c, K, [("click", "view"), ("view", "error")]), "x")


@query(f"WITH {E_} SELECT win, label, i::INT AS i, ch::INT AS ch, f::INT AS f, v FROM e WHERE f IN (1, 3)")
def prj4_select_features(spark, sf):
    return vectors(spark, sf).filter(F.col("f").isin(1, 3))


@query(f"WITH {E_}, u AS (SELECT win, 'raw' AS feature, i, v FROM e UNION ALL SELECT win, 'size', i, abs(v) FROM e) SELECT win, count(*) AS n, round(sum(v), 5) AS total, count(DISTINCT feature) AS families FROM u GROUP BY 1")
def prj5_merge_features(spark, sf):
    e = vectors(spark, sf)
    u = e.select("win", F.lit("raw").alias("feature"), "i", "v").unionByName(e.select("win", F.lit("size").alias("feature"), "i", F.abs("v").alias("v")))
    return u.groupBy("win").agg(F.count("*").alias("n"), F.round(F.sum("v"), 5).alias("total"), F.count_distinct("feature").alias("families"))


@query("SELECT channel || '_' || u.name AS feature FROM (SELECT DISTINCT event_type AS channel FROM events), unnest([" + ", ".join(f"'{n}'" for n in fe.feature_names()) + "]) AS u(name)")
def prj6_feature_names(spark, sf):
    names = F.explode(F.array(*map(F.lit, fe.feature_names())))
    return table(spark, sf, "events").select(F.col("event_type").alias("channel")).distinct().withColumn("name", names).select(F.concat_ws("_", "channel", "name").alias("feature"))


@query(f"WITH {S}, d AS (SELECT subject, channel, t, CASE WHEN label = 1 THEN NULL ELSE x END AS v FROM s), m AS (SELECT channel, avg(v) AS m FROM d GROUP BY 1) SELECT subject, channel, t, round(coalesce(v, m, 0), 6) AS v FROM d JOIN m USING (channel)")
def prj7_clean(spark, sf):
    v = F.when(F.col("label") == 1, F.when(F.col("t") % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(F.col("x"))
    return rounded(no.clean(signal(spark, sf).select("subject", "channel", "t", v.alias("v")), ["channel"]), "v").select("subject", "channel", "t", "v")


@query(f"WITH {S} SELECT subject, (t // 2)::BIGINT AS t, x FROM s WHERE t % 2 = 0")
def flt1_decimate(spark, sf):
    return fo.decimate(signal(spark, sf), 2).select("subject", "t", "x")


@query(f"WITH {S}, o AS (SELECT subject, min(t) AS onset FROM s WHERE label = 1 GROUP BY 1) SELECT subject, t, x, 'pre' AS segment FROM s JOIN o USING (subject) WHERE t >= onset - 6 AND t < onset UNION ALL SELECT subject, t, x, 'event' FROM s JOIN o USING (subject) WHERE t >= onset AND t < onset + 4")
def flt2_cut_segments(spark, sf):
    s = signal(spark, sf)
    onsets = s.filter("label = 1").groupBy("subject").agg(F.min("t").alias("onset"))
    return fo.cut_segments(s, onsets, K, {"pre": (-6, 0), "event": (0, 4)}).select("subject", "t", "x", "segment")


FLT = """m AS (SELECT subject, greatest(start - 3, coalesce(lag(stop) OVER w, 0)) AS lo, start, stop, {hi} AS hi FROM ev WINDOW w AS (PARTITION BY subject ORDER BY start))
    SELECT subject, t, x FROM s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.subject = s.subject AND ((t >= lo AND t < start) OR (t >= stop AND t < hi)))"""


@query(f"WITH {S}, {EV}, " + FLT.format(hi="least(stop + 2, coalesce(lead(start) OVER w, 1000000000))"))
def flt3_drop_margins(spark, sf):
    return fo.drop_margins(signal(spark, sf), events_of(spark, sf), K, 3, 2).select("subject", "t", "x")


@query(f"WITH {S}, {EV}, " + FLT.format(hi="stop"))
def flt4_drop_margins_before(spark, sf):
    return fo.drop_margins(signal(spark, sf), events_of(spark, sf), K, 3, 2, after_events=False).select("subject", "t", "x")


@query(f"WITH {S} SELECT subject, t, x FROM s WHERE t >= 1 AND label = 0")
def flt5_drop_first(spark, sf):
    return fo.drop_first(signal(spark, sf)).filter("label = 0").select("subject", "t", "x")


@query(f"WITH {S}, {EV} SELECT s.subject, t, (EXISTS (SELECT 1 FROM ev WHERE ev.subject = s.subject AND t >= start AND t < stop))::INT AS label FROM s")
def joi1_label_by_interval(spark, sf):
    return fo.label_by_interval(signal(spark, sf), events_of(spark, sf), K).select("subject", "t", "label")


@query(f"WITH {WINS} SELECT subject, t, win, x FROM w")
def win1_sliding_windows(spark, sf):
    return windows(spark, sf).select("subject", "t", "win", "x")


@query(f"WITH {WINS} SELECT subject, win, round(avg(x), 6) AS avg FROM w GROUP BY 1, 2")
def win2_moving_average(spark, sf):
    return rounded(wi.moving_average(signal(spark, sf), K, L, STEP), "avg")


@query(f"WITH {WINS} SELECT subject, win, (avg(label) > 0.5)::INT AS majority, ceil(avg(label))::INT AS majority_up, max(label) AS any, min(label) AS every FROM w GROUP BY 1, 2")
def win3_window_labels(spark, sf):
    s, out = signal(spark, sf), None
    for how, name in (("majority", "majority"), ("majority_up", "majority_up"), ("atLeastOne", "any"), ("allOne", "every")):
        part = wi.window_labels(s, K, L, STEP, how).withColumnRenamed("label", name)
        out = part if out is None else out.join(part, KW)
    return out


@query(f"WITH {S} SELECT subject, t, round(sum(x) OVER (PARTITION BY subject ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS run FROM s")
def win4_running_sum(spark, sf):
    return rounded(wi.running_sum(signal(spark, sf), K, 5), "run").select("subject", "t", "run")


@query(f"WITH {S} SELECT subject, t, round(x - lag(x, 1) OVER o, 6) AS shift_1, round(x - lag(x, 3) OVER o, 6) AS shift_3 FROM s WINDOW o AS (PARTITION BY subject ORDER BY t) QUALIFY row_number() OVER o > 3")
def win5_time_shift(spark, sf):
    return rounded(wi.time_shift(signal(spark, sf), K, [1, 3], "x", "diff"), "shift_1", "shift_3").select("subject", "t", "shift_1", "shift_3")


ZC = "d AS (SELECT subject, t, sign(lead(x) OVER o - x) AS sg FROM s WINDOW o AS (PARTITION BY subject ORDER BY t)), z AS (SELECT subject, t, (lead(sg) OVER (PARTITION BY subject ORDER BY t) <> sg)::INT AS zc FROM d)"


@query(f"WITH {S}, {ZC} SELECT subject, t, zc FROM z WHERE zc IS NOT NULL")
def win6_zero_crossings(spark, sf):
    return wi.zero_crossings(signal(spark, sf), K).filter("zc is not null").select("subject", "t", "zc")


@query(f"WITH {S} SELECT subject, t, round(avg(x) OVER o, 6) AS run_mean, min(x) OVER o AS run_min FROM s WINDOW o AS (PARTITION BY subject ORDER BY t ROWS UNBOUNDED PRECEDING)")
def win7_running_stats(spark, sf):
    return rounded(wi.running_stats(signal(spark, sf), K), "run_mean").select("subject", "t", "run_mean", "run_min")


@query(f"WITH {WINS}, d AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY subject, win ORDER BY t)) AS d FROM w) SELECT subject, win, round(avg(abs(x)), 6) AS mean_ampl, round(avg(d), 6) AS line_length FROM d GROUP BY 1, 2")
def fea1_fea2_amplitude_line_length(spark, sf):
    return rounded(fe.amplitude(signal(spark, sf), K, L, STEP), "mean_ampl", "line_length")


@query(f"""WITH {S}, {ZC}, q AS (SELECT subject, t, sum(zc) OVER (PARTITION BY subject ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS run FROM z WHERE zc IS NOT NULL),
    n AS (SELECT subject, count(*) AS n FROM q GROUP BY 1), wi AS (SELECT subject, unnest(range(0, ((n - {L} + {STEP} - 1) // {STEP})::BIGINT)) AS win FROM n WHERE n > {L})
    SELECT q.subject, win, round(avg(run), 6) AS zero_cross FROM q JOIN wi ON q.subject = wi.subject AND t >= win * {STEP} AND t < win * {STEP} + {L} GROUP BY 1, 2""")
def fea4_zero_cross(spark, sf):
    return rounded(fe.zero_cross_feature(signal(spark, sf), K, 4, L, STEP), "zero_cross")


@query(f"""WITH {WINS}, r AS (SELECT subject, win, min(x) AS lo, max(x) AS hi, count(*) AS n FROM w GROUP BY 1, 2),
    b AS (SELECT subject, win, CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 10), 9) ELSE 0 END AS bin, n, count(*) AS c FROM w JOIN r USING (subject, win) GROUP BY ALL), p AS (SELECT subject, win, c::DOUBLE / n AS p FROM b)
    SELECT subject, win, round(-sum(p * log2(p)), 6) AS shannon, round(-log2(sum(p * p)), 6) AS renyi, round(1 - sum(p * p), 6) AS tsallis FROM p GROUP BY 1, 2""")
def fea6_hist_entropies(spark, sf):
    return rounded(fe.hist_entropies(windows(spark, sf), KW), "shannon", "renyi", "tsallis")


@query(f"""WITH {WINS}, o AS (SELECT subject, win, x AS a, lead(x, 1) OVER v AS b, lead(x, 2) OVER v AS c FROM w WINDOW v AS (PARTITION BY subject, win ORDER BY t)),
    k AS (SELECT subject, win, (b < a)::INT + 2 * (c < a)::INT + 4 * (c < b)::INT AS shape, count(*) AS n FROM o WHERE c IS NOT NULL GROUP BY ALL), p AS (SELECT subject, win, n::DOUBLE / sum(n) OVER (PARTITION BY subject, win) AS p FROM k)
    SELECT subject, win, round(-sum(p * log2(p)) / log2(6), 6) AS perm_entropy FROM p GROUP BY 1, 2""")
def fea8_perm_entropy(spark, sf):
    return rounded(fe.perm_entropy(windows(spark, sf), KW), "perm_entropy")


@query(f"""WITH {S}, r AS (SELECT subject, t, x, avg(x) OVER o AS m, min(x) OVER o AS lo FROM s WINDOW o AS (PARTITION BY subject ORDER BY t ROWS UNBOUNDED PRECEDING)),
    q AS (SELECT subject, t, CASE WHEN x > lo THEN (m - lo) / (x - lo) ELSE 0.0 END AS norm FROM r) SELECT subject, t, ((norm >= 0.25)::INT + (norm >= 0.5)::INT + (norm >= 1)::INT + (norm >= 2)::INT) AS symbol FROM q""")
def fea13_amplitude_symbol(spark, sf):
    return fe.amplitude_symbol(signal(spark, sf), K, [0.25, 0.5, 1.0, 2.0]).select("subject", "t", "symbol")


@query(f"WITH {S}, q AS (SELECT subject, t, " + " + ".join(f"(lead(x, {i + 1}) OVER o > lead(x, {i}) OVER o)::INT * {1 << 5 - i}" for i in range(6)) + " AS lbp FROM s WINDOW o AS (PARTITION BY subject ORDER BY t)) SELECT * FROM q WHERE lbp IS NOT NULL")
def fea15_lbp_codes(spark, sf):
    return fe.lbp_codes(signal(spark, sf), K).filter("lbp is not null").select("subject", "t", "lbp")


@query(f"WITH {S} SELECT subject, channel, round(quantile_cont(x, 0.05), 6) AS p_lo, round(quantile_cont(x, 0.95), 6) AS p_hi, round(quantile_cont(x, 0.95) - quantile_cont(x, 0.05), 6) AS range FROM s GROUP BY 1, 2")
def fea17_percentile_range(spark, sf):
    return rounded(fe.percentile_range(signal(spark, sf), ["subject", "channel"], kept(spark, "samples")), "p_lo", "p_hi", "range")


@query(f"WITH {WINS}, d AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY subject, win ORDER BY t)) AS d FROM w), q AS (SELECT subject, win, avg(abs(x)) AS mean_ampl, avg(d) AS line_length FROM d GROUP BY 1, 2) SELECT subject, win, 'mean_ampl' AS feature, round(mean_ampl, 6) AS v FROM q UNION ALL SELECT subject, win, 'line_length', round(line_length, 6) FROM q")
def fea18_extract_features(spark, sf):
    return rounded(fe.long_form(fe.amplitude(signal(spark, sf), K, L, STEP), K, ["mean_ampl", "line_length"]), "v")


@query()
def fea3_band_powers(spark, sf):
    rows = fe.band_powers(windows(spark, sf), KW, 8.0)
    return rounded(rows, *[c for c in rows.columns if c not in KW])


@query()
def fea5_approx_zero_cross(spark, sf):
    return fe.approx_zero_cross(signal(spark, sf).select("subject", "t", "x"), K, [16.0, 64.0], 4, L, STEP, kept(spark, "simplified"))


@query()
def fea7_sample_entropy(spark, sf):
    rows = fe.per_group(windows(spark, sf), KW, lambda x: {"sampen": fe.sample_entropy_of(x)}, {"sampen": "double"})
    return rows.select(*KW, F.round("sampen", 5).alias("sampen"))


@query()
def fea9_fea10_entropy_features(spark, sf):
    return fe.entropy_features(windows(spark, sf), KW, level=2)


MORLET = f"""{WINS}, q AS (SELECT subject, win, x - avg(x) OVER (PARTITION BY subject, win) AS v, t - win * {STEP} AS i FROM w), b AS (SELECT k, f, 3 / (pi() * f) AS s, (ceil((24 / (pi() * f) + 0.0625) * 8)::BIGINT - 1) // 2 AS mid FROM (VALUES (0, 0.5::DOUBLE), (1, 1), (2, 2)) AS b(k, f)),
    a AS (SELECT subject, win, k, f, s, v, (3 - i + mid) / 8.0::DOUBLE - 4 * s AS tt FROM q, b), e AS (SELECT subject, win, k, (pow(sum(v * cos(2 * pi() * f * tt) * exp(-tt * tt / (2 * s * s))), 2) + pow(sum(v * sin(2 * pi() * f * tt) * exp(-tt * tt / (2 * s * s))), 2)) / s AS energy FROM a GROUP BY subject, win, k, s)"""


@query(f"WITH {MORLET} SELECT subject, win, arg_max(k, (round(energy, 9), -k))::INT AS symbol FROM e GROUP BY 1, 2")
def fea11_cwt_symbol(spark, sf):
    return fe.per_group(windows(spark, sf), KW, lambda x: {"symbol": fe.cwt_symbol_of(x, 8.0, [0.5, 1.0, 2.0])}, {"symbol": "int"})


@query(f"""WITH {MORLET}, r AS (SELECT subject, win, k, sqrt(energy) AS rms, sqrt(energy) / nullif(sum(sqrt(energy)) OVER (PARTITION BY subject, win), 0) AS share FROM e), bg AS (SELECT subject, win FROM w GROUP BY 1, 2 HAVING sum(label) = 0),
    nz AS (SELECT k, avg(share) AS noise FROM r JOIN bg USING (subject, win) GROUP BY 1) SELECT subject, win, arg_max(k, (round(rms / noise, 9), -k))::INT AS symbol FROM r JOIN nz USING (k) GROUP BY 1, 2""")
def fea11_cwt_symbol_over_noise(spark, sf):
    """The band that stands out most from windows without events."""
    w = windows(spark, sf)
    energies = fe.per_group(w, KW, lambda x: {"energies": fe.cwt_energies_of(x, 8.0, [0.5, 1.0, 2.0]).tolist()}, {"energies": "array<double>"})
    rows = kept(spark, "energies")(energies.join(w.groupBy(*KW).agg(F.sum("label").alias("events")), KW))
    return fe.noise_free_symbol(rows, fe.fit_noise(rows, F.col("events") == 0)).select(*KW, "symbol")


@query(f"""WITH {WINS}, o AS (SELECT subject, win, x AS a, lead(x, 1) OVER v AS b, lead(x, 2) OVER v AS c FROM w WINDOW v AS (PARTITION BY subject, win ORDER BY t)),
    k AS (SELECT subject, win, (b < a)::INT + 2 * (c < a)::INT + 4 * (c < b)::INT AS shape, count(*) AS n FROM o WHERE c IS NOT NULL GROUP BY ALL), p AS (SELECT subject, win, n::DOUBLE / sum(n) OVER (PARTITION BY subject, win) AS p FROM k),
    q AS (SELECT subject, win, round(-sum(p * log2(p)) / log2(6), 6) AS e FROM p GROUP BY 1, 2) SELECT subject, win, least(greatest(floor((e - 0.3) / 0.07), 0), 9)::INT AS symbol FROM q""")
def fea12_entropy_symbol(spark, sf):
    e = rounded(fe.perm_entropy(windows(spark, sf), KW), "perm_entropy")
    return e.select("subject", "win", F.least(F.greatest(F.floor((F.col("perm_entropy") - 0.3) / 0.07), F.lit(0)), F.lit(9)).cast("int").alias("symbol"))


@query()
def fea14_fft_spectrum(spark, sf):
    return fe.per_group(windows(spark, sf), KW, lambda x: {"spectrum": fe.fft_spectrum_of(x, 8.0, 4.0).tolist()}, {"spectrum": "array<double>"})


@query()
def fea16_bandpass(spark, sf):
    return fe.bandpass(signal(spark, sf).select("subject", "t", "x"), K, 8.0, 0.5, 2.0)


@query(f"WITH {LV} SELECT win, i::INT AS i, level FROM lv")
def nrm1_minmax_levels(spark, sf):
    return levels(spark, sf).select("win", "i", "level")


@query(f"WITH {E_}, mm AS (SELECT i, min(v) AS lo, quantile_cont(v, 0.9) AS hi FROM e GROUP BY i) SELECT win, i::INT AS i, greatest(floor(round(19 * least((v - lo) / (hi - lo), 1), 9)), 0)::INT AS level FROM e JOIN mm USING (i)")
def nrm2_percentile_levels(spark, sf):
    e = vectors(spark, sf)
    rows = no.discretise(e, no.fit_percentile(e, ["i"], kept(spark, "values")), ["i"], 20, clip=True)
    return rows.select("win", "i", no.leveled(F.round(19 * F.col("norm"), 9) / 19, 20).alias("level"))


@query(f"WITH {S}, {REC}, mm AS (SELECT subject, recording, min(x) AS lo, max(x) AS hi FROM rec GROUP BY 1, 2) SELECT subject, t, coalesce(floor(9 * CASE WHEN hi > lo THEN (x - lo) / (hi - lo) END), 0)::INT AS level FROM rec JOIN mm USING (subject, recording)")
def nrm3_levels_per_recording(spark, sf):
    r, by = recorded(spark, sf).withColumnRenamed("x", "v"), ["subject", "recording"]
    return no.discretise(r, no.fit_minmax(r, by), by, 10).select("subject", "t", "level")


@query(f"WITH {S} SELECT subject, t, least(greatest(floor(9 * ((x - 5.0) / (100.0 - 5.0))), 0), 9)::INT AS level FROM s")
def nrm4_levels_by_stored_bounds(spark, sf):
    s = signal(spark, sf).withColumn("v", F.col("x"))
    bounds = s.select("channel").distinct().withColumns({"lo": F.lit(5.0), "hi": F.lit(100.0)})
    return no.discretise(s, bounds, ["channel"], 10).select("subject", "t", "level")


@query(f"WITH {S}, q AS (SELECT subject, t, x, min(x) OVER (PARTITION BY subject) AS lo, max(x) OVER (PARTITION BY subject) AS hi FROM s) SELECT subject, t, round((x - lo) / (hi - lo), 6) AS norm FROM q")
def nrm5_minmax(spark, sf):
    s = signal(spark, sf).withColumnRenamed("x", "v")
    return rounded(no.discretise(s, no.fit_minmax(s, K), K, 10), "norm").select("subject", "t", "norm")


BG = """e AS (SELECT *, row_number() OVER (ORDER BY subject, start) - 1 AS k, 2 * (stop - start) AS need FROM ev), b AS (SELECT subject AS background_recording, count(*) AS n, row_number() OVER (ORDER BY subject) - 1 AS j FROM s WHERE subject % 3 = 0 GROUP BY 1)"""


def background(spark, sf):
    return signal(spark, sf).filter("subject % 3 = 0").groupBy(F.col("subject").alias("recording")).agg(F.count("*").alias("n"))


@query(f"""WITH {S}, {EV}, {BG} SELECT subject AS event_recording, start, stop, background_recording, (('0x' || substr(md5('42|' || subject::VARCHAR || '|' || start::VARCHAR), 1, 8))::BIGINT % (n - need + 1))::BIGINT AS "offset",
    (need // 2)::BIGINT AS before_n, (need - need // 2)::BIGINT AS after_n FROM e JOIN b ON k % (SELECT count(*) FROM b) = j WHERE n >= need""")
def smp1_balance(spark, sf):
    return fo.balance(events_of(spark, sf).withColumnRenamed("subject", "recording"), background(spark, sf), 2)


@query(f"WITH {S}, {EV}, n AS (SELECT subject, count(*) AS n FROM s GROUP BY 1) SELECT subject, start, stop, greatest(start - (2 * (stop - start)) // 2, 0)::BIGINT AS lo, least(stop + (2 * (stop - start)) // 2, n)::BIGINT AS hi FROM ev JOIN n USING (subject)")
def smp2_balance_same(spark, sf):
    return fo.balance_same(events_of(spark, sf), wi.lengths(signal(spark, sf), K), K, 2)


@query(f"WITH {S}, q AS (SELECT subject, t, CASE WHEN label = 1 THEN 1 WHEN t % 2 = 0 THEN 0 ELSE 2 END AS part FROM s) SELECT subject, t, part, row_number() OVER (PARTITION BY subject ORDER BY part, t) - 1 AS win FROM q")
def smp3_recompose(spark, sf):
    s = signal(spark, sf).select("subject", "t", "label")
    rows = fo.recompose(s.filter("label = 0 and t % 2 = 0"), s.filter("label = 1"), s.filter("label = 0 and t % 2 = 1"), K)
    return rows.select("subject", "t", "part", F.col("win").cast("long").alias("win"))


@query(f"""WITH RECURSIVE {S}, {EV}, z AS (SELECT subject, max(t) AS last FROM s GROUP BY 1),
    cut(subject, chunk, lo, hi, last) AS (SELECT z.subject, 0::BIGINT, 0::BIGINT, coalesce(stop, 10)::BIGINT, z.last FROM z LEFT JOIN ev ON ev.subject = z.subject AND start < 10 AND stop > 10
        UNION ALL SELECT cut.subject, chunk + 1, hi, coalesce(stop, hi + 10)::BIGINT, cut.last FROM cut LEFT JOIN ev ON ev.subject = cut.subject AND start < hi + 10 AND stop > hi + 10 WHERE hi <= cut.last)
    SELECT s.subject, t, chunk FROM s JOIN cut ON s.subject = cut.subject AND t >= lo AND t < hi""")
def rch1_rechunk_fixed(spark, sf):
    return fo.rechunk_fixed(signal(spark, sf), events_of(spark, sf), K, 10).select("subject", "t", "chunk")


@query(f"""WITH {S}, c AS (SELECT subject, t, label, (t // 10)::BIGINT AS chunk FROM s), h AS (SELECT subject, chunk, max(label) AS has FROM c GROUP BY 1, 2),
    o AS (SELECT subject, chunk, row_number() OVER v AS nth, max(has) OVER v AS seen FROM h WINDOW v AS (PARTITION BY subject ORDER BY chunk)), f AS (SELECT subject, min(chunk) AS first FROM o WHERE nth >= 2 AND seen = 1 GROUP BY 1)
    SELECT subject, t, CASE WHEN chunk <= coalesce(first, -1) THEN 0 ELSE chunk - coalesce(first, 0) END AS chunk FROM c LEFT JOIN f USING (subject)""")
def rch2_first_chunk_with_event(spark, sf):
    c = signal(spark, sf).select("subject", "t", "label", F.floor(F.col("t") / 10).alias("chunk"))
    return fo.first_chunk_with_event(c, K, 2).select("subject", "t", "chunk")


@query(f"WITH {S}, q AS (SELECT *, (label = 1 AND coalesce(lead(label) OVER o, 1) = 0)::INT AS e FROM s WINDOW o AS (PARTITION BY subject ORDER BY t)) SELECT subject, t, coalesce(sum(e) OVER (PARTITION BY subject ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk FROM q")
def rch3_event_to_event(spark, sf):
    return fo.rechunk_event_to_event(signal(spark, sf), K).select("subject", "t", "chunk")


IDX = f"{S}, {REC}, i AS (SELECT subject, recording, row_number() OVER (PARTITION BY subject ORDER BY recording)::INT - 1 AS idx FROM (SELECT DISTINCT subject, recording FROM rec))"


@query(f"WITH {IDX} SELECT a.subject, a.recording, b.idx AS fold, CASE WHEN a.idx = b.idx THEN 'test' ELSE 'train' END AS role FROM i a JOIN i b USING (subject)")
def cv1_leave_one_recording_out(spark, sf):
    return fo.folds_loo(recorded(spark, sf), K)


@query(f"WITH {IDX} SELECT a.subject, a.recording, b.idx AS fold, CASE WHEN a.idx <= b.idx THEN 'train' ELSE 'test' END AS role FROM i a JOIN i b ON a.subject = b.subject AND a.idx <= b.idx + 1 WHERE b.idx < (SELECT max(idx) FROM i c WHERE c.subject = a.subject)")
def cv2_rolling(spark, sf):
    return fo.folds_rolling(recorded(spark, sf), K)


@query("SELECT subject, fold::INT AS fold, CASE WHEN subject % 4 = fold THEN 'test' ELSE 'train' END AS role FROM (SELECT DISTINCT c_custkey AS subject FROM customer), unnest(range(0, 4)) AS u(fold)")
def cv3_groups(spark, sf):
    return fo.folds_groups(table(spark, sf, "customer").select(F.col("c_custkey").alias("subject")), 4)


@query(f"WITH {S}, c AS (SELECT subject, label, count(*) AS n FROM s GROUP BY 1, 2), a AS (SELECT label, sum(n) AS all_n FROM c GROUP BY 1) SELECT subject AS held_out, c.label, (all_n - n)::BIGINT AS n FROM c JOIN a USING (label)")
def cv4_leave_one_subject_out(spark, sf):
    c = signal(spark, sf).groupBy("subject", "label").agg(F.count("*").alias("n"))
    a = c.groupBy("label").agg(F.sum("n").alias("all_n"))
    return c.join(a, "label").select(F.col("subject").alias("held_out"), "label", (F.col("all_n") - F.col("n")).alias("n"))
