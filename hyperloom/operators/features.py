"""Features of windows. Those that built-in functions can express are aggregates; spectra, wavelets, filters and entropies of
templates are numpy kernels over one window, or one series, at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperloom.operators.polyline import simplified_series
from hyperloom.operators.selection import exact_percentiles
from hyperloom.operators.windows import running_stats, running_sum, series, sliding_windows, zero_crossings

#: Bands of the spectrum in Hz (fixed values).
BANDS = {"total": (0, 45), "dc": (0, 0.5), "mov": (0.1, 0.5), "delta": (0.5, 4), "theta": (4, 8), "alpha": (8, 13), "middle": (12, 13), "beta": (13, 30), "gamma": (30, 45)}
#: Low-pass decomposition filter of the Daubechies wavelet with four vanishing moments (published constants).
DB4 = [-0.010597401785069, 0.032883011666885, 0.030841381835987, -0.187034811719094, -0.027983769416984, 0.630880767929590, 0.714846570552542, 0.230377813308855]


def feature_names(thresholds: list[int] = (16, 32, 64, 128, 256)) -> list[str]:
    """Names of the features of one channel, by families: amplitude, line length, spectrum, zero crossings."""
    relative = [f"rel_{k}" for k in BANDS if k != "total"]
    return ["mean_ampl", "line_length", *BANDS, *relative, "zero_cross", *[f"zero_cross_{t}" for t in thresholds]]


def amplitude(df: DataFrame, keys: list[str], length: int, step: int) -> DataFrame:
    """mean_ampl and line_length of every window."""
    w = W.partitionBy(*keys, "win").orderBy("t")
    rows = sliding_windows(df, keys, length, step).withColumn("d", F.abs(F.col("x") - F.lag("x").over(w)))
    return rows.groupBy(*keys, "win").agg(F.avg(F.abs("x")).alias("mean_ampl"), F.avg("d").alias("line_length"))


def zero_cross_feature(df: DataFrame, keys: list[str], fs: int, length: int, step: int) -> DataFrame:
    """Sign changes, summed over a second around each sample, averaged over windows."""
    flagged = zero_crossings(df, keys).filter("zc is not null")
    summed = running_sum(flagged, keys, fs, "zc")
    return sliding_windows(summed, keys, length, step).groupBy(*keys, "win").agg(F.avg("run").alias("zero_cross"))


def hist_entropies(windows: DataFrame, keys: list[str], bins: int = 10, a: float = 2.0, q: float = 2.0) -> DataFrame:
    """Shannon (log2), Renyi and Tsallis entropies of a histogram over each window's own range."""
    ends = windows.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    p = windows.join(ends, keys).groupBy(*keys, at.alias("bin"), "n").agg((F.count("*") / F.col("n")).alias("p"))
    return p.groupBy(*keys).agg(
        (-F.sum(F.col("p") * F.log2("p"))).alias("shannon"),
        (F.log2(F.sum(F.pow("p", F.lit(a)))) / (1 - a)).alias("renyi"),
        ((1 - F.sum(F.pow("p", F.lit(q)))) / (q - 1)).alias("tsallis"),
    )


def perm_entropy(windows: DataFrame, keys: list[str], order: int = 3) -> DataFrame:
    """Entropy of the orders of successive values, divided by its maximum; earlier values first in ties."""
    from math import factorial, log2

    w = W.partitionBy(*keys).orderBy("t")
    values = F.array(*[F.struct(F.lead("x", i).over(w).alias("v"), F.lit(i).alias("i")) for i in range(order)])
    shape = windows.withColumn("_last", F.lead("x", order - 1).over(w)).withColumn("_shape", F.transform(F.array_sort(values), lambda s: s["i"])).filter("_last is not null")
    counted = shape.groupBy(*keys, "_shape").agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(W.partitionBy(*keys))
    return counted.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p")) / log2(factorial(order))).alias("perm_entropy"))


def amplitude_symbol(df: DataFrame, keys: list[str], edges: list[float]) -> DataFrame:
    """Samples normalised by the running mean and minimum, as the number of thresholds below."""
    rows = running_stats(df, keys)
    norm = F.when(F.col("x") > F.col("run_min"), (F.col("run_mean") - F.col("run_min")) / (F.col("x") - F.col("run_min"))).otherwise(0.0)
    bins = F.array(*map(F.lit, edges))
    return rows.withColumn("norm", norm).withColumn("symbol", F.size(F.filter(bins, lambda e: e <= F.col("norm"))))


def lbp_codes(df: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    """Code of n successive rises (1) and falls (0) from each sample on, the first in the highest bit."""
    w = series(keys)
    code = sum(((F.lead("x", i + 1).over(w) > F.lead("x", i).over(w)).cast("int") * (1 << n - 1 - i) for i in range(n)), F.lit(0))
    return df.withColumn("lbp", code)


def percentile_range(df: DataFrame, keys: list[str], keep, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """The exact percentiles, by counting passes over the samples that ``keep`` stores."""
    p = exact_percentiles(df, keys, "x", [lo, hi], keep)
    return p.select(*keys, F.col("p")[0].alias("p_lo"), F.col("p")[1].alias("p_hi"), (F.col("p")[1] - F.col("p")[0]).alias("range"))


def entropy_symbol(values: DataFrame, column: str, lo: float, hi: float, levels: int) -> DataFrame:
    level = F.floor((F.col(column) - lo) / ((hi - lo) / levels))
    return values.withColumn("symbol", F.least(F.greatest(level, F.lit(0)), F.lit(levels - 1)).cast("int"))


# ---- kernels over one window


def band_powers_of(x: np.ndarray, fs: float) -> dict[str, float]:
    """Power in each band by the trapezoid rule over a one-sided periodogram of the values less their mean."""
    x = x - x.mean()
    freq = np.fft.rfftfreq(len(x), 1 / fs)
    power = np.abs(np.fft.rfft(x)) ** 2 / (fs * len(x))
    power[1 : (len(x) + 1) // 2] *= 2
    out = {}
    for name, (lo, hi) in BANDS.items():
        a, b = max(int(np.argmax(freq > lo)) - 1, 0), max(int(np.argmax(freq > hi)) - 1, 0)
        b = b if (freq > hi).any() else len(freq) - 1
        part = slice(a, b + 1)
        out[name] = float(np.trapezoid(power[part], freq[part]))
    return out | {f"rel_{k}": v / out["total"] if out["total"] else 0.0 for k, v in out.items() if k != "total"}


def sample_entropy_of(x: np.ndarray, dim: int = 2, r: float = 0.2, eps: float = 0.001) -> float:
    """Negative logarithm of the share of template pairs that still match when longer by one."""

    def matches(m: int) -> int:
        t = np.lib.stride_tricks.sliding_window_view(x, m)[: len(x) - dim]
        return int((np.abs(t[:, None] - t[None, :]).max(axis=2) <= r * x.std()).sum()) - len(t)

    return float(-np.log((matches(dim + 1) + eps) / (matches(dim) + eps))) if len(x) > dim else 0.0


def dwt_of(x: np.ndarray, level: int) -> list[np.ndarray]:
    """Detail bands of each level and the last approximation, with symmetric ends."""
    low = np.array(DB4)
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    out, a = [], np.asarray(x, dtype=float)
    for _ in range(level):
        if len(a) < 2:
            break
        wide = np.pad(a, len(low) - 1, mode="symmetric")
        out.append(np.convolve(wide, high, "valid")[1::2])
        a = np.convolve(wide, low, "valid")[1::2]
    return [*out, a]


def fft_spectrum_of(x: np.ndarray, fs: float, bound: float) -> np.ndarray:
    """Magnitudes up to a frequency, divided by the largest and then by their sum; zeros where that is undefined."""
    m = np.abs(np.fft.rfft(x))[np.fft.rfftfreq(len(x), 1 / fs) <= bound]
    m = m / m.max() if m.max() > 0 else np.zeros_like(m)
    return m / m.sum() if m.sum() > 0 else m


def fft_peak_levels_of(x: np.ndarray, fs: float, bound: float, levels: int) -> dict[str, list[int]]:
    """Magnitudes up to a frequency, over the largest, as levels."""
    m = np.abs(np.fft.rfft(x))[np.fft.rfftfreq(len(x), 1 / fs) <= bound]
    share = m / m.max() if m.max() > 0 else np.zeros_like(m)
    return {"levels": np.minimum(np.floor(np.round((levels - 1) * share, 9)), levels - 1).astype(int).tolist()}


def fft_peak_levels_by(x: np.ndarray, size: int, fs: float, bound: float, levels: int) -> list[np.ndarray]:
    """The same of every ``size`` values in turn of each row, with what is over at its end: arrays (rows, frequencies)."""
    ends = range(0, x.shape[1], size)
    out = []
    for part in (x[:, a : a + size] for a in ends):
        m = np.abs(np.fft.rfft(part, axis=1))[:, np.fft.rfftfreq(part.shape[1], 1 / fs) <= bound]
        top = m.max(axis=1, keepdims=True)
        share = np.divide(m, top, out=np.zeros_like(m), where=top > 0)
        out.append(np.minimum(np.floor(np.round((levels - 1) * share, 9)), levels - 1).astype(np.int32))
    return out


def cwt_symbol_of(x: np.ndarray, fs: float, freqs: list[float], cycles: float = 6.0) -> int:
    """Index of the Morlet band with the largest root-mean-square energy in the middle fifth of the window."""
    return int(np.argmax(cwt_energies_of(x, fs, freqs, cycles)))


def cwt_energies_of(x: np.ndarray, fs: float, freqs: list[float], cycles: float = 6.0) -> np.ndarray:
    """Root-mean-square energy of each Morlet band in the middle fifth of the window."""
    energy = []
    for f in freqs:
        s = cycles / (2 * np.pi * f)
        t = np.arange(-4 * s, 4 * s + 0.5 / fs, 1 / fs)
        wave = np.exp(2j * np.pi * f * t - t**2 / (2 * s**2)) / np.sqrt(s)
        first = (len(wave) - 1) // 2  # the wave may be longer than the window
        part = np.convolve(x - x.mean(), wave)[first : first + len(x)]
        a, b = int(len(part) * 0.4), max(int(len(part) * 0.6), int(len(part) * 0.4) + 1)
        energy.append(np.sqrt((np.abs(part[a:b]) ** 2).mean()))
    return np.array(energy)


def fit_noise(energies: DataFrame, background: Column) -> DataFrame:
    """One row, noise: the mean share of each band in the energy of background windows, from rows with an array of energies."""
    total = F.aggregate("energies", F.lit(0.0), lambda s, x: s + x)
    shares = energies.filter(background & (total > 0)).select(F.posexplode(F.transform("energies", lambda x: x / total)).alias("band", "share"))
    means = shares.groupBy("band").agg(F.avg("share").alias("share"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "share"))), lambda x: x["share"]).alias("noise"))


def noise_free_symbol(energies: DataFrame, noise: DataFrame) -> DataFrame:
    """Adds symbol: the band whose energy is the largest multiple of the noise's (the first, if tied)."""
    rows = energies.crossJoin(F.broadcast(noise))  # one row
    ratio = F.transform("energies", lambda x, i: F.struct(F.round(x / F.get("noise", i), 9).alias("r"), (-i).alias("at")))
    return rows.withColumn("symbol", -F.array_max(ratio)["at"]).drop("noise")


def simplified(x: np.ndarray, eps: float) -> np.ndarray:
    """The series between the points that vertical-distance line simplification keeps, interpolated back."""
    keep = np.zeros(len(x), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        line = np.interp(np.arange(a, b + 1), [a, b], [x[a], x[b]])
        off = np.abs(x[a : b + 1] - line)
        k = int(off.argmax())
        if off[k] > eps:
            keep[a + k] = True
            todo += [(a, a + k), (a + k, b)]
    at = np.flatnonzero(keep)
    return np.interp(np.arange(len(x)), at, x[at])


def bandpass_sections(fs: float, lo: float, hi: float) -> tuple[float, list[tuple[float, float]]]:
    """Fourth-order Butterworth band-pass by the bilinear transform, as four equal-gain sections g (1 - z^-2) / (1 + a1 z^-1 + a2 z^-2)."""
    w1, w2 = np.tan(np.pi * lo / fs), np.tan(np.pi * hi / fs)
    low = np.exp(1j * np.pi * (2 * np.arange(4) + 5) / 8) * (w2 - w1) / 2
    root = np.sqrt(low**2 - w1 * w2)
    s = np.concatenate([low + root, low - root])
    z = (1 + s) / (1 - s)
    g = ((w2 - w1) ** 4 / np.prod(1 - s).real) ** 0.25
    return float(g), [(-2 * p.real, abs(p) ** 2) for p in z[z.imag > 0]]


def recursive(v: np.ndarray, a1: float, a2: float, block: int = 256) -> np.ndarray:
    """y[n] = v[n] - a1 y[n-1] - a2 y[n-2] from rest: within blocks by one matrix product, between them by the last two values."""
    h = np.zeros(block + 1)
    h[0] = 1.0
    for n in range(1, block + 1):
        h[n] = -a1 * h[n - 1] - (a2 * h[n - 2] if n > 1 else 0.0)
    lag = np.subtract.outer(np.arange(block), np.arange(block))
    forced = np.pad(v, (0, -len(v) % block)).reshape(-1, block) @ np.where(lag >= 0, h[np.abs(lag)], 0.0).T
    free = np.stack([h[1:], -a2 * h[:-1]])  # what the last value and the one before it leave
    states, y1, y2 = np.zeros((len(forced), 2)), 0.0, 0.0
    for i, row in enumerate(forced):
        states[i] = y1, y2
        y1, y2 = row[-1] + y1 * free[0, -1] + y2 * free[1, -1], row[-2] + y1 * free[0, -2] + y2 * free[1, -2]
    return (forced + states @ free).ravel()[: len(v)]


def bandpass_of(x: np.ndarray, fs: float, lo: float, hi: float) -> np.ndarray:
    """The sections run forwards and backwards over the values, which are continued by 27 values turned about each end (all
    but one of a shorter array), each pass starting as if its first value had always been there."""
    g, sections = bandpass_sections(fs, lo, hi)

    def passed(v: np.ndarray) -> np.ndarray:
        before = v[0]
        for a1, a2 in sections:
            v = recursive(g * (v - np.concatenate([[before, before], v])[: len(v)]), a1, a2)
            before = 0.0  # a constant doesn't pass a section
        return v

    edge = min(27, len(x) - 1)
    wide = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]])
    return passed(passed(wide)[::-1])[::-1][edge : edge + len(x)]


def bandpass(df: DataFrame, keys: list[str], fs: float, lo: float, hi: float, chunk: int = 1 << 16) -> DataFrame:
    """The rows (keys, t, x without nulls) with the filtered value y. A series is cut in chunks of t, so its length doesn't
    matter; each also gets as many samples on either side as it takes for a start to fade to 1e-12."""
    fade = int(np.ceil(np.log(1e-12) / np.log(max(a2 for _, a2 in bandpass_sections(fs, lo, hi)[1]) ** 0.5)))
    types = dict(df.dtypes)
    to = F.sequence(F.greatest(F.floor((F.col("t") - fade) / chunk), F.lit(0)), F.floor((F.col("t") + fade) / chunk))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        own = (pdf["t"] // chunk == pdf["_chunk"]).to_numpy()
        return pdf.assign(y=bandpass_of(pdf["x"].to_numpy(float), fs, lo, hi) if own.any() else 0.0)[own].drop(columns="_chunk")

    return df.withColumn("_chunk", F.explode(to)).groupBy(*keys, "_chunk").applyInPandas(run, ", ".join(f"`{k}` {t}" for k, t in types.items()) + ", y double")


def per_array(df: DataFrame, keys: list[str], column: str, fn, columns: dict[str, str], args: tuple = ()) -> DataFrame:
    """The keys of every row and what a numpy function, that gives a dict, makes of its array: no shuffle, a batch at a time."""
    types = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"`{c}` {t}" for c, t in columns.items()])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = pd.DataFrame([fn(np.asarray(x, dtype=float), *args) for x in pdf[column]], columns=list(columns))
            yield pd.concat([pdf[keys].reset_index(drop=True), made], axis=1)

    return df.select(*keys, column).mapInPandas(run, schema)


def per_arrays(df: DataFrame, keys: list[str], column: str, fn, columns: dict[str, str], args: tuple = ()) -> DataFrame:
    """The same with a function that takes the arrays of one length together, as rows of a matrix, and gives a dict of columns
    (arrays or lists). Of a null array all columns are null."""
    types = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"`{c}` {t}" for c, t in columns.items()])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            none = frame[column].isna()
            if none.any():
                yield frame.loc[none, keys].reindex(columns=[*keys, *columns])
            frame = frame[~none]
            for n, pdf in frame.groupby(frame[column].map(len)):
                step = max(1, min(ROWS, HELD // max(n, 1) ** 2))
                for part in (pdf.iloc[i : i + step] for i in range(0, len(pdf), step)):
                    made = fn(np.stack(part[column].to_numpy()).astype(float), *args)
                    yield pd.concat([part[keys].reset_index(drop=True), pd.DataFrame(made, columns=list(columns))], axis=1)

    return df.select(*keys, column).mapInPandas(run, schema)


#: Rows of a matrix that a function gets, and pairs of values in them.
ROWS, HELD = 1024, 1 << 22


def per_group(df: DataFrame, keys: list[str], fn, columns: dict[str, str], args: tuple = (), per=per_array) -> DataFrame:
    """One row per group: the group's values in order of t through a numpy function that gives a dict, of each array or (per_arrays)
    of many."""
    whole = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("_x"))
    return per(whole, keys, "_x", fn, columns, args)


def per_series(df: DataFrame, keys: list[str], fn, args: tuple = (), to: str = "y") -> DataFrame:
    """The rows with a column that a numpy function makes of each whole series."""
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {t}" for k, t in types.items()) + f", `{to}` double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return pdf.assign(**{to: fn(pdf["x"].to_numpy(float), *args)})

    return df.groupBy(*keys).applyInPandas(run, schema)


def band_powers(windows: DataFrame, keys: list[str], fs: float) -> DataFrame:
    return per_group(windows, keys, band_powers_of, {k: "double" for k in [*BANDS, *[f"rel_{k}" for k in BANDS if k != "total"]]}, (fs,))


def approx_zero_cross(df: DataFrame, keys: list[str], eps: list[float], fs: int, length: int, step: int, keep) -> DataFrame:
    """The zero-cross feature of the simplified series (keys, t, x), for every eps."""
    return zero_cross_feature(simplified_series(df, keys, eps, keep), [*keys, "eps"], fs, length, step)


def shape(x: np.ndarray, a: float = 2.0) -> dict[str, float]:
    p = np.histogram(x, 10)[0] / max(len(x), 1)
    p = p[p > 0]
    s2 = float((p**2).sum())
    return {"shannon": float(-(p * np.log2(p)).sum()), "renyi": float(np.log2((p**a).sum()) / (1 - a)), "tsallis": 1 - s2}


def entropy_set_of(x: np.ndarray, level: int, order: int) -> dict[str, float]:
    """Entropies of the window and of each of its wavelet bands."""
    from math import factorial, log2

    out = {"sampen": sample_entropy_of(x)}
    bands = dwt_of(x, level)
    bands += [np.zeros(1)] * (level + 1 - len(bands))
    for i, band in enumerate(bands):
        out |= {f"{k}_{i}": v for k, v in shape(band).items()}
        t = np.argsort(np.lib.stride_tricks.sliding_window_view(band, order), axis=1, kind="stable") if len(band) >= order else np.zeros((0, order))
        p = np.unique(t, axis=0, return_counts=True)[1] / max(len(t), 1)
        out[f"perm_{i}"] = float(-(p * np.log2(p)).sum() / log2(factorial(order))) if len(t) else 0.0
    return out


# ---- the same for many windows of one length, as rows of a matrix


def dwt_by(x: np.ndarray, level: int) -> list[np.ndarray]:
    low = np.array(DB4)
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    out, a = [], x
    for _ in range(level):
        if a.shape[1] < 2:
            break
        wide = np.pad(a, ((0, 0), (len(low) - 1,) * 2), mode="symmetric")
        n = wide.shape[1] - len(low) + 1  # what spans two rows is left out
        passed = lambda f: np.pad(np.convolve(wide.ravel(), f, "valid"), (0, len(low) - 1)).reshape(wide.shape)[:, 1:n:2]  # noqa: B023, E731
        detail, a = passed(high), passed(low)
        out.append(detail)
    return [*out, a]


def entropy_of_counts(row: np.ndarray, counts: np.ndarray, total: int, n: int) -> np.ndarray:
    """Entropy (log2) of each of n rows, from counts in any order."""
    p = counts / total
    return np.bincount(row, -p * np.log2(p), n)


def shape_by(x: np.ndarray) -> dict[str, np.ndarray]:
    if x.shape[1] == 0:
        return {k: np.full(len(x), v) for k, v in shape(x[:0].ravel()).items()}
    lo, hi = x.min(axis=1), x.max(axis=1)
    if not np.isfinite(hi - lo).all():
        raise ValueError("values have to be finite")
    flat = np.where(lo == hi, 0.5, 0.0)
    edges = np.linspace(lo - flat, hi + flat, 11, axis=1)
    at = (x[:, :, None] >= edges[:, None, 1:10]).sum(axis=2) + 10 * np.arange(len(x))[:, None]
    counts = np.bincount(at.ravel(), minlength=10 * len(x)).reshape(-1, 10)
    row, bin_ = np.nonzero(counts)
    s2 = ((counts / x.shape[1]) ** 2).sum(axis=1)
    return {"shannon": entropy_of_counts(row, counts[row, bin_], x.shape[1], len(x)), "renyi": -np.log2(s2), "tsallis": 1 - s2}


def perm_entropy_by(x: np.ndarray, order: int = 3) -> np.ndarray:
    from math import factorial, log2

    n = x.shape[1] - order + 1
    if n < 1:
        return np.zeros(len(x))
    shapes = np.argsort(np.lib.stride_tricks.sliding_window_view(x, order, axis=1), axis=2, kind="stable") @ order ** np.arange(order)
    found, counts = np.unique(shapes + np.arange(len(x))[:, None] * order**order, return_counts=True)
    return entropy_of_counts(found // order**order, counts, n, len(x)) / log2(factorial(order))


def sample_entropy_by(x: np.ndarray, dim: int = 2, r: float = 0.2, eps: float = 0.001) -> np.ndarray:
    n = x.shape[1] - dim
    if n < 1:
        return np.zeros(len(x))
    near = np.abs(x[:, :, None] - x[:, None, :]) <= (r * x.std(axis=1))[:, None, None]
    matches = lambda m: np.logical_and.reduce([near[:, q : q + n, q : q + n] for q in range(m)]).sum(axis=(1, 2)) - n
    return -np.log((matches(dim + 1) + eps) / (matches(dim) + eps))


def entropy_set_by(x: np.ndarray, level: int, order: int) -> dict[str, np.ndarray]:
    out, bands = {"sampen": sample_entropy_by(x)}, dwt_by(x, level)
    bands += [np.zeros((len(x), 1))] * (level + 1 - len(bands))
    for i, band in enumerate(bands):
        out |= {f"{k}_{i}": v for k, v in shape_by(band).items()} | {f"perm_{i}": perm_entropy_by(band, order)}
    return out


def entropy37_by(x: np.ndarray) -> dict[str, np.ndarray]:
    *details, _ = dwt_by(x, 7)
    bands = {f"d{k}": details[k - 1] if k <= len(details) else np.zeros((len(x), 1)) for k in range(7, 2, -1)}
    out = {f"samp_{i}_{k}": sample_entropy_by(bands[k], 2, r) for i, r in ((1, 0.2), (2, 0.35)) for k in ("d7", "d6")}
    out |= {f"perm_{k}_{n}": perm_entropy_by(b, n) for k, b in bands.items() for n in (3, 5, 7)}
    return out | {f"{name}_{k}": v for k, b in {"sig": x, **bands}.items() for name, v in shape_by(b).items()}


def band_powers_by(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    n = x.shape[1]
    freq = np.fft.rfftfreq(n, 1 / fs)
    power = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)) ** 2 / (fs * n)
    power[:, 1 : (n + 1) // 2] *= 2
    out = {}
    for name, (lo, hi) in BANDS.items():
        a, b = max(int(np.argmax(freq > lo)) - 1, 0), max(int(np.argmax(freq > hi)) - 1, 0)
        part = slice(a, (b if (freq > hi).any() else len(freq) - 1) + 1)
        out[name] = np.trapezoid(power[:, part], freq[part], axis=1)
    total = out["total"]
    return out | {f"rel_{k}": np.divide(v, total, out=np.zeros_like(v), where=total != 0) for k, v in out.items() if k != "total"}


def feature_set_by(x: np.ndarray, size: int, fs: float) -> dict[str, np.ndarray]:
    out = entropy37_by(x)
    if size > 37:
        out |= {k: v for k, v in band_powers_by(x, fs).items() if size == 54 or k.startswith("rel_")}
    return out | ({"mean_ampl": np.abs(x).mean(axis=1)} if size == 46 else {})


def entropy_features(windows: DataFrame, keys: list[str], level: int = 7, order: int = 3) -> DataFrame:
    names = ["sampen", *[f"{k}_{i}" for i in range(level + 1) for k in ("shannon", "renyi", "tsallis", "perm")]]
    return per_group(windows, keys, entropy_set_by, dict.fromkeys(names, "double"), (level, order), per_arrays)


def long_form(df: DataFrame, keys: list[str], families: list[Column | str]) -> DataFrame:
    return df.unpivot([*keys, "win"], families, "feature", "v")


# ---- entropies of a window by name, and the feature sets made of them


def perm_entropy_of(x: np.ndarray, order: int = 3) -> float:
    """Permutation entropy over its greatest value."""
    from math import factorial, log2

    if len(x) < order:
        return 0.0
    shapes = np.argsort(np.lib.stride_tricks.sliding_window_view(x, order), axis=1, kind="stable")
    p = np.unique(shapes, axis=0, return_counts=True)[1] / len(shapes)
    return float(-(p * np.log2(p)).sum() / log2(factorial(order)))


def spectral_entropy_of(x: np.ndarray, segment: int = 256) -> float:
    """Entropy of the mean power spectrum of Hann-weighted segments, half overlapping, over its greatest value."""
    n = min(segment, len(x))
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = np.lib.stride_tricks.sliding_window_view(x, n)[:: max(n // 2, 1)]
    power = (np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * hann, axis=1)) ** 2).mean(axis=0)
    power[1 : (n + 1) // 2] *= 2
    if not power.sum() or len(power) < 2:
        return 0.0
    p = power[power > 0] / power.sum()
    return float(-(p * np.log2(p)).sum() / np.log2(len(power)))


def svd_entropy_of(x: np.ndarray, order: int = 3) -> float:
    """Entropy of the singular values of the matrix of delays, over its greatest value."""
    s = np.linalg.svd(np.lib.stride_tricks.sliding_window_view(x, order), compute_uv=False)
    s = s[s > 0] / s.sum() if s.sum() else s[:0]
    return float(-(s * np.log2(s)).sum() / np.log2(order))


def close_counts(x: np.ndarray, m: int, r: float) -> np.ndarray:
    """For each run of m values the number of runs, itself included, that stay within r of it everywhere."""
    t = np.lib.stride_tricks.sliding_window_view(x, m)
    return (np.abs(t[:, None] - t[None, :]).max(axis=2) <= r).sum(axis=1)


def approximate_entropy_of(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    phi = [np.log(c / len(c)).mean() for c in (close_counts(x, k, r * x.std()) for k in (m, m + 1))]
    return float(phi[0] - phi[1])


def plain_sample_entropy_of(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """Without smoothing: infinite where no longer run matches, 0 where no run matches."""
    b = int(close_counts(x[:-1], m, r * x.std()).sum()) - (len(x) - m)
    a = int(close_counts(x, m + 1, r * x.std()).sum()) - (len(x) - m)
    return float(-np.log(a / b)) if a else (float("inf") if b else 0.0)


#: Entropies of a window and the ranges (fixed values) that are cut in symbols.
ENTROPIES = {
    "perm": (perm_entropy_of, 0.8, 1.0), "spectral": (spectral_entropy_of, 0.3, 1.0), "svd": (svd_entropy_of, 0.2, 1.0),
    "approximate": (approximate_entropy_of, 0.2, 1.8), "sample": (plain_sample_entropy_of, 0.2, 2.2),
}


def entropy_symbols_of(x: np.ndarray, levels: int) -> dict[str, int]:
    """The symbol of every entropy: its place among equal steps of the range, within it at either end."""
    out = {}
    for name, (fn, lo, hi) in ENTROPIES.items():
        v = fn(x)
        out[name] = levels - 1 if v == float("inf") else int(min(max(np.floor((v - lo) / ((hi - lo) / levels)), 0), levels - 1))
    return out


def entropy37_of(x: np.ndarray) -> dict[str, float]:
    """Sample entropies of the two widest detail bands at two radii, permutation entropies of five bands at three orders, and
    Shannon, Renyi and Tsallis entropies of the window and those bands."""
    *details, _ = dwt_of(x, 7)
    bands = {f"d{k}": details[k - 1] if k <= len(details) else np.zeros(1) for k in range(7, 2, -1)}
    out = {f"samp_{i}_{k}": sample_entropy_of(bands[k], 2, r) for i, r in ((1, 0.2), (2, 0.35)) for k in ("d7", "d6")}
    out |= {f"perm_{k}_{n}": perm_entropy_of(b, n) for k, b in bands.items() for n in (3, 5, 7)}
    return out | {f"{name}_{k}": v for k, b in {"sig": x, **bands}.items() for name, v in shape(b).items()}


def feature_set_of(x: np.ndarray, size: int, fs: float) -> dict[str, float]:
    """37 entropies; 45: also the eight relative band powers; 46: also the mean amplitude; 54: all band powers."""
    out = entropy37_of(x)
    if size > 37:
        out |= {k: v for k, v in band_powers_of(x, fs).items() if size == 54 or k.startswith("rel_")}
    return out | ({"mean_ampl": float(np.abs(x).mean())} if size == 46 else {})


def feature_set(df: DataFrame, keys: list[str], column: str, size: int, fs: float) -> DataFrame:
    names = list(feature_set_of(np.arange(8.0), size, fs))
    return per_arrays(df, keys, column, feature_set_by, dict.fromkeys(names, "double"), (size, fs))
