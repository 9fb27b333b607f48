"""Keyed state for streams: one small object for each key, and processors whose sessions end by a timer.

Keys are dealt to buckets by their hash, and a bucket is one group of Spark's: its state is a map from key to object, its
rows are sorted together. A group costs some milliseconds in each batch, which tables of many short keys can't pay each.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A key's rows of a batch in order: a column's name to its values.
Rows = dict[str, np.ndarray]
Step = Callable[[Any, tuple, Rows], list[tuple]]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that the keys share. A stream must keep this number from run to run, as it must its shuffle partitions.
BUCKETS = 1024
#: Rows after which a bucket's output is handed on.
OUT_ROWS = 10_000


def dealt(stream: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return stream.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def by_key(batches: Iterator[pd.DataFrame], keys: list[str], order: list[str]) -> Iterator[tuple[tuple, Rows]]:
    """Each key of a bucket with its rows in order; nulls are a key like any other."""
    whole = pd.concat(list(batches))
    code = whole.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    at = np.lexsort([*(whole[c].to_numpy() for c in reversed(order)), code])
    columns = {c: whole[c].to_numpy()[at] for c in whole.columns if c != "_bucket"}
    borders = [0, *(np.flatnonzero(np.diff(code[at])) + 1).tolist(), len(at)]
    names = [[None if pd.isna(x) else x for x in columns[k][borders[:-1]].tolist()] for k in keys]
    for i, key in enumerate(zip(*names, strict=True)):
        yield key, {c: x[borders[i] : borders[i + 1]] for c, x in columns.items()}


def stateful(stream: DataFrame, keys: list[str], order: list[str], schema: str, make: Callable[[], Any], step: Step, mode: str = "append", buckets: int = BUCKETS) -> DataFrame:
    """step(state, key, rows in order) for each key of each batch; step changes the state in place and gives rows.

    Rows of a key are read in their order within a batch; batches come in order. The object must stay
    bounded: its attributes are written to the state store after every batch. The rows of one bucket's keys are
    sorted together, so a trigger's limits (maxFilesPerTrigger) bound them, and the states of one bucket's keys are
    written together, so `buckets` should grow with the keys.
    """

    def run(_: tuple, batches: Iterator[pd.DataFrame], store: Any) -> Iterator[pd.DataFrame]:
        held = pickle.loads(store.get[0]) if store.exists else {}
        out: list[tuple] = []
        for key, rows in by_key(batches, keys, order):
            own = make()
            vars(own).update(held.get(key, {}))
            out += step(own, key, rows)
            held[key] = vars(own)
            if len(out) >= OUT_ROWS:
                yield frame(schema, out)
                out = []
        store.update((pickle.dumps(held),))
        if out:
            yield frame(schema, out)

    return dealt(stream, keys, buckets).groupBy("_bucket").applyInPandasWithState(run, schema, "blob binary", mode, "NoTimeout")


def processed(stream: DataFrame, keys: list[str], schema: str, processor: StatefulProcessor, mode: str = "append", time: str = "none") -> DataFrame:
    """The rows of a stateful processor; its states live in RocksDB, which the session is set to."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, time)


def in_sessions(stream: DataFrame, keys: list[str], order: list[str], schema: str, gap: int, make: Callable[[], Any], step: Step, close: Callable[[Any, tuple], list[tuple]], mode: str = "append", buckets: int = BUCKETS) -> DataFrame:
    """step and close over the sessions of each key; stream has ts with a watermark."""
    return processed(dealt(stream, keys, buckets), ["_bucket"], schema, Sessions(keys, order, schema, gap, make, step, close), mode, "eventTime")


def frame(schema: str, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in schema.split(", ")])


def milliseconds(times: np.ndarray) -> np.ndarray:
    return times.astype("datetime64[ms]").astype(np.int64)


class Sessions(StatefulProcessor):
    """Sessions of the keys of a bucket, which end where a key's event time stands still for `gap` milliseconds.

    Rows have ts. Within a batch, and between batches, a row more than gap after the one before begins a new
    session: close(state, key) is called and a new state made. Where no row follows, a timer does so once the
    watermark has passed the last row's time by gap; the key's state is then removed. So the result does not depend on
    how rows fall into batches. step and close are as for stateful(). A bucket has one timer, for the session that
    ends first.
    """

    def __init__(self, keys: list[str], order: list[str], schema: str, gap: int, make: Callable[[], Any], step: Step, close: Callable[[Any, tuple], list[tuple]]) -> None:
        self.keys, self.order, self.schema, self.gap = keys, order, schema, gap
        self.make, self.step, self.close_session = make, step, close

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", "blob binary, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        blob, timer = self.own.get() if self.own.exists() else (None, None)
        held = pickle.loads(blob) if blob else {}
        out: list[tuple] = []
        for name, part in by_key(rows, self.keys, self.order):
            out += self._take(held, name, part)
            if len(out) >= OUT_ROWS:
                yield frame(self.schema, out)
                out = []
        self._keep(held, timer)
        if out:
            yield frame(self.schema, out)

    def _take(self, held: dict, key: tuple, rows: Rows) -> list[tuple]:
        """What a key's rows give; held is the bucket's map from key to state and time of its end."""
        own, out = self.make(), []
        at = milliseconds(rows["ts"])
        last = at[0]
        if key in held:
            attributes, until = held[key]
            vars(own).update(attributes)
            last = until - self.gap
        before = np.maximum.accumulate(np.concatenate(([last], at)))
        fresh = np.flatnonzero(at - before[:-1] > self.gap).tolist()
        # The first piece goes on with what is held, unless it too lies beyond the gap.
        for n, (lo, hi) in enumerate(zip([0, *fresh], [*fresh, len(at)], strict=True)):
            if n:
                out += self.close_session(own, key)
                own = self.make()
            if lo < hi:
                out += self.step(own, key, {c: x[lo:hi] for c, x in rows.items()})
        held[key] = vars(own), int(before[-1]) + self.gap
        return out

    def _keep(self, held: dict, timer: int | None) -> None:
        """Writes a bucket's sessions, and sets its timer to the first end; timer: the one that is set."""
        first = min((until for _, until in held.values()), default=None)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is None:
            self.own.clear()
            return
        if timer != first:
            self.handle.registerTimer(first)
        self.own.update((pickle.dumps(held), first))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.own.exists():
            return
        held = pickle.loads(self.own.get()[0])
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        out: list[tuple] = []
        for name in [k for k, (_, until) in held.items() if until <= now]:
            own = self.make()
            vars(own).update(held.pop(name)[0])
            out += self.close_session(own, name)
        self._keep(held, None)
        if out:
            yield frame(self.schema, out)

    def close(self) -> None: ...
