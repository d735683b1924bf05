"""The causal operators on streams. Times are event times; a watermark bounds the state and drops rows that come later."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hyperloom.operators.predict import distances, predict


def window_features(stream: DataFrame, keys: list[str], size: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """Count, mean and mean size of values in sliding windows of event time."""
    at = F.window("ts", size, slide)
    return stream.withWatermark("ts", late).groupBy(*keys, at).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.avg(F.abs("x")).alias("mean_ampl"))


def running_normaliser(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with the mean and minimum of its key so far (by time within a batch), kept as state of three numbers."""
    types = dict(stream.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in [*keys, "ts", "x"]) + ", run_mean double, run_min double"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, low = state.get if state.exists else (0, 0.0, float("inf"))
        pdf = pd.concat(list(frames)).sort_values("ts", kind="stable")
        count = n + pd.Series(range(1, len(pdf) + 1), index=pdf.index)
        sums, lows = total + pdf["x"].cumsum(), pdf["x"].cummin().clip(upper=low)
        state.update((int(n + len(pdf)), float(sums.iloc[-1]), float(lows.iloc[-1])))
        yield pdf.assign(run_mean=sums / count, run_min=lows)[[*keys, "ts", "x", "run_mean", "run_min"]]

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "n long, total double, low double", "append", GroupStateTimeout.NoTimeout)


def score_stream(encoded: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Distances of a stream's vectors to a stored model, a stateless join with a static table."""
    return distances(encoded, model, keys)


def train_stream(encoded: DataFrame, step, path: str):
    """A writer that hands every batch to a training step, which makes the next version of the model."""
    return encoded.writeStream.option("checkpointLocation", path).foreachBatch(step)


def sent_events(stream: DataFrame, keys: list[str], length: int, value, on, gap: int, silent: str, late: str) -> DataFrame:
    """Events (keys, start, stop, since) of places where ``on(recent, place)`` holds, recent being the last ``length`` values of a
    key in order of (ts, win): sent once ``gap`` places without follow, or when its key has been silent. A key is silent once a
    row, or event time (of all keys), has passed its last one by more than ``silent``; its places start at 0 again, so results
    don't depend on how rows fall in batches. start and stop are places, since is the time of the first one. State: the last
    values, the place, the time, and the open event; it goes when a key falls silent."""
    types = dict(stream.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", start long, stop long, since long"
    wait = int(pd.Timedelta(silent).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, at, start, last, since, seen = state.get if state.exists else ([], 0, -1, -1, 0, None)
        recent, out = list(recent), []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, start, last + 1, since)] if start >= 0 else [], columns=[*keys, "start", "stop", "since"])
            return
        pdf = pd.concat(list(frames)).sort_values(["_ms", "win"])
        for v, ms in zip(value(pdf), pdf["_ms"].tolist(), strict=True):
            if seen is not None and ms - seen > wait:
                out += [(*key, start, last + 1, since)] if start >= 0 else []
                recent, at, start = [], 0, -1
            recent = [*recent, float(v)][-length:]
            if on(recent, at):
                start, since, last = (at, ms, at) if start < 0 else (start, since, at)
            elif start >= 0 and at - last >= gap:
                out.append((*key, start, last + 1, since))
                start = -1
            at, seen = at + 1, ms
        state.update((recent, at, start, last, since, seen))
        state.setTimeoutTimestamp(max(seen + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[*keys, "start", "stop", "since"])

    held = "recent array<double>, at long, start long, last long, since long, seen long"
    grouped = stream.withWatermark("ts", late).withColumn("_ms", F.unix_millis("ts")).groupBy(*keys)
    return grouped.applyInPandasWithState(run, schema, held, "append", GroupStateTimeout.EventTimeTimeout).withColumn("since", F.timestamp_millis("since"))


def smoothed_events(stream: DataFrame, keys: list[str], length: int, share: float, gap: int, silent: str, late: str = "0 seconds") -> DataFrame:
    """Events of votes: the share of ones among the last ``length`` labels; the first ``length`` places are never on. The stream
    has keys, ts, win and y."""
    return sent_events(stream, keys, length, lambda pdf: pdf["y"], lambda recent, at: at >= length and sum(recent) >= share * length, gap, silent, late)


def evidence_events(stream: DataFrame, keys: list[str], length: int, threshold: float, gap: int, silent: str, late: str = "0 seconds") -> DataFrame:
    """Events of evidence: the log ratio of the last ``length`` probabilities reaches the threshold. The stream has keys, ts,
    win, y and p."""

    def on(recent: list[float], at: int) -> bool:
        up, down = math.prod(recent), math.prod(1 - x for x in recent)
        return at + 1 >= length and math.log((up + 1e-8) / (down + 1e-8)) >= threshold

    return sent_events(stream, keys, length, lambda pdf: pdf["p"].where(pdf["y"] == 1, 1 - pdf["p"]), on, gap, silent, late)


def sessions(stream: DataFrame, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of positive rows no farther apart than a gap, by the built-in session window."""
    return stream.filter("y = 1").withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))


__all__ = ["evidence_events", "predict", "running_normaliser", "score_stream", "sent_events", "sessions", "smoothed_events", "train_stream", "window_features"]
