"""Models that learn from streams: one for each key, kept as state, updated by mini-batches, with timers that end it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hyperloom.operators.train import bits_of, minibatch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that processors with several kinds of state need, for the streams started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class OnlineModel(StatefulProcessor):
    """State of a key: counters of each class, the rows of the open mini-batch, its number, and the time of the last row.

    A mini-batch is closed by the first row of a later one, or when the key has been silent; then it updates the model, which
    is sent. Silence also ends the model: the state goes, and rows that come later start a new one. Since mini-batches are
    numbered in the rows and silence is seen in their times, too, results don't depend on how rows fall in batches of Spark.
    Rows of a mini-batch that is closed already are late and dropped.
    """

    def __init__(self, d: int, wait: int, always: bool, taken: float):
        self.d, self.wait, self.always, self.taken = d, wait, always, taken

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.model = handle.getMapState("model", "class int", "acc array<double>, n double")
        self.held = handle.getListState("held", "win long, label int, hv array<bigint>")
        self.at = handle.getValueState("at", "batch long, seen long, timer long")

    def applied(self, model: dict, held: list[tuple], key: tuple, batch: int) -> tuple[dict, list[tuple]]:
        rows = pd.DataFrame(sorted(held, key=lambda r: r[0]), columns=["win", "label", "hv"])
        model = minibatch(model, bits_of(rows)[:, : self.d], rows["label"].to_numpy(), self.always, self.taken)
        return model, [(*key, batch, c, a.tolist(), n) for c, (a, n) in sorted(model.items())]

    def read(self) -> tuple[dict, list[tuple], int, int, int]:
        batch, seen, timer = self.at.get() if self.at.exists() else (-1, -1, -1)
        model = {k[0]: (np.array(v[0], dtype=float), float(v[1])) for k, v in self.model.iterator()}
        return model, [(r[0], r[1], list(r[2])) for r in self.held.get()] if self.held.exists() else [], batch, seen, timer

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        model, held, batch, seen, timer = self.read()
        out: list[tuple] = []
        frame = pd.concat(list(rows)).sort_values(["ms", "win"])
        for ms, own, win, label, hv in zip(frame["ms"].tolist(), frame["batch"].tolist(), frame["win"].tolist(), frame["label"].tolist(), frame["hv"], strict=True):
            if seen >= 0 and ms - seen > self.wait:
                out += self.applied(model, held, key, batch)[1] if held else []
                model, held, batch = {}, [], -1
            if own < batch:
                continue
            if own > batch and held:
                model, sent = self.applied(model, held, key, batch)
                out, held = out + sent, []
            batch, seen = own, max(seen, ms)
            held.append((win, label, [int(x) for x in hv]))
        self.store(model, held)
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = max(seen + self.wait, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.at.update((batch, seen, timer))
        yield self.frame(out, key)

    def store(self, model: dict, held: list[tuple]) -> None:
        self.model.clear()
        for c, (a, n) in model.items():
            self.model.updateValue((c,), (a.tolist(), n))
        self.held.put(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        model, held, batch, _, _ = self.read()
        out = self.applied(model, held, key, batch)[1] if held else []
        self.model.clear()
        self.held.clear()
        self.at.clear()
        yield self.frame(out, key)

    def frame(self, out: list[tuple], key: tuple) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[*(f"k{i}" for i in range(len(key))), "batch", "class", "acc", "n"])



def online_models(stream: DataFrame, keys: list[str], d: int, silent: str, late: str = "0 seconds", always: bool = True, taken: float = 0.5) -> DataFrame:
    """(keys, batch, class, acc, n): the model after each mini-batch, by the rule of :func:`hyperloom.operators.train.minibatch`.
    The stream has keys, ts, batch (a number that grows within a key), win, label and hv; run it under :func:`rocksdb`."""
    types = dict(stream.dtypes)
    schema = ", ".join(f"k{i} {types[k]}" for i, k in enumerate(keys)) + ", batch long, `class` int, acc array<double>, n double"
    rows = stream.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts")).select(*keys, "ts", "ms", "batch", "win", "label", "hv")
    model = OnlineModel(d, int(pd.Timedelta(silent).total_seconds() * 1000), always, taken)
    sent = rows.groupBy(*keys).transformWithStateInPandas(model, schema, "append", "eventTime")
    return sent.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})
