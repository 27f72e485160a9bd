"""Keyed state with event-time timers: open batches and silent nodes that need no new row to end."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from modelpulse.spec import BATCH_ROWS, CAPTURE_TICK_SECONDS

# The processors run in tasks and travel with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


@contextmanager
def options(spark: SparkSession, wanted: Mapping[str, str] = ROCKSDB) -> Iterator[None]:
    """Session options for what is started inside; a stream keeps those it was started with."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _ms(us: int) -> int:
    """The first whole millisecond that isn't before a moment."""
    return -(-us // 1_000)


# --- rows or tick -----------------------------------------------------------------------------


class OpenBatch(StatefulProcessor):
    """Buffer of one sender: emptied at `size` rows, and by a timer at the end of its tick.

    The state holds the rows of the open batch, fewer than `size`, its tick and its number; it is
    cleared when the tick ends, so senders that stop leave nothing behind.
    """

    def __init__(self, keys: Sequence[str], held: T.StructType, at: str, order: Sequence[str], size: int, tick_us: int):
        self.keys, self.held, self.at, self.order, self.size, self.tick_us = list(keys), held, at, list(order), size, tick_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.held)
        self.place = handle.getValueState("place", "tick bigint, part bigint")

    def _flushed(self, key: tuple, rows: pd.DataFrame, tick: int, part: int | np.ndarray) -> pd.DataFrame:
        return rows.assign(**dict(zip(self.keys, key)), tick=tick, part=part)[[*self.keys, *self.held.names, "tick", "part"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = self.held.names
        new = pd.concat([r[names] for r in rows], ignore_index=True)
        new = new.sort_values(self.order, kind="stable", ignore_index=True)
        held = [list(r) for r in self.rows.get()] if self.rows.exists() else []
        tick, part = self.place.get() if self.place.exists() else (None, 0)
        before = tick
        for mine, group in new.groupby(new[self.at] // self.tick_us, sort=True):
            mine = int(mine)
            if tick is not None and mine < tick:
                mine = tick  # late, but within the watermark: it joins what is open
            if mine != tick:
                if held:
                    yield self._flushed(key, pd.DataFrame(held, columns=names), tick, part)
                held, tick, part = [], mine, 0
            buffered = pd.concat([pd.DataFrame(held, columns=names), group], ignore_index=True) if held else group.reset_index(drop=True)
            full = len(buffered) // self.size
            if full:
                # One frame for all full batches of a tick: each frame costs a message to the JVM.
                sent = buffered[: full * self.size]
                yield self._flushed(key, sent, tick, part + np.arange(len(sent)) // self.size)
            held, part = buffered[full * self.size :].values.tolist(), part + full
        if held:
            self.rows.put([tuple(r) for r in held])
        else:
            self.rows.clear()
        self.place.update((tick, part))
        if tick != before:
            if before is not None:
                self.handle.deleteTimer(_ms((before + 1) * self.tick_us))
            self.handle.registerTimer(_ms((tick + 1) * self.tick_us))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.rows.exists():
            tick, part = self.place.get()
            yield self._flushed(key, pd.DataFrame([list(r) for r in self.rows.get()], columns=self.held.names), tick, part)
        self.rows.clear()
        self.place.clear()

    def close(self) -> None:
        pass


def stream_rows_or_tick(
    stream: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    watermark: str,
    size: int = BATCH_ROWS,
    seconds: int = CAPTURE_TICK_SECONDS,
) -> DataFrame:
    """Rows of a stream with the batch (tick, part) that took them, as the batch is sent off.

    A buffer per `keys` is emptied at `size` rows or when the watermark passes the end of its tick,
    whether or not another row comes; `batching.batch_rows_or_tick` is the same over a table.
    `keys` must name the sender (a model and a salt or client): one task works through all rows of a
    sender in a micro-batch. Rows are of plain types; the rest of a tick that is still open when the
    stream stops stays in the state. Start the stream inside `options(spark)`.
    """
    at = "at_us"
    moments = stream.select("*", F.unix_micros(F.col(ts).cast("timestamp")).alias(at), F.col(ts).cast("timestamp").alias("row_moment"))
    kept = {f.name: f for f in moments.schema.fields if f.name not in ("row_moment", ts)}
    named = [kept[k] for k in keys]
    held = T.StructType([f for n, f in kept.items() if n not in keys])
    out = T.StructType([*named, *held.fields, T.StructField("tick", T.LongType()), T.StructField("part", T.LongType())])
    width = seconds * 1_000_000
    processor = OpenBatch(keys, held, at, [at if c == ts else c for c in order], size, width)
    flushed = (
        moments.withWatermark("row_moment", watermark)
        .select(*kept, "row_moment")
        .groupBy(*keys)
        .transformWithStateInPandas(processor, outputStructType=out, outputMode="Append", timeMode="EventTime")
    )
    return flushed.select(
        *[c for c in stream.columns if c != ts],
        F.timestamp_micros(F.col(at)).alias(ts),
        F.timestamp_micros(F.col("tick") * width).alias("tick"),
        "part",
    )


# --- silent nodes -----------------------------------------------------------------------------

ALERT = "node string, event string, at bigint, first_seen bigint, last_seen bigint, events bigint"


#: Groups of nodes that are watched together.
GROUPS = 128
SEEN = {"node": object, "first": "int64", "last": "int64", "events": "int64", "grey": bool}


class Silence(StatefulProcessor):
    """Watch of a group of nodes: one timer at the next moment at which one of them falls silent.

    A node is silent one timeout after its last event, which a later event moves. The state is a list
    per column with an entry per node, read and written at once: a call to the state costs far more
    than a node.
    """

    def __init__(self, timeout_us: int):
        self.timeout_us = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState(
            "seen",
            "node array<string>, first array<bigint>, last array<bigint>, events array<bigint>, grey array<boolean>, timer bigint",
        )

    def _held(self) -> tuple[pd.DataFrame, int | None]:
        *columns, timer = self.seen.get() if self.seen.exists() else (*[[]] * len(SEEN), None)
        return pd.DataFrame({n: pd.Series(list(c), dtype=t) for (n, t), c in zip(SEEN.items(), columns)}), timer

    def _keep(self, nodes: pd.DataFrame, timer: int | None) -> None:
        """Write the state, with the timer at the next silence instead of the one that was set."""
        ends = nodes.loc[~nodes["grey"], "last"]
        wanted = _ms(int(ends.min()) + self.timeout_us + 1) if len(ends) else None
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.seen.update((*[nodes[c].tolist() for c in SEEN], wanted))

    def _alarms(self, nodes: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "node": nodes["node"], "event": "grey", "at": nodes["last"] + self.timeout_us + 1,
            "first_seen": nodes["first"], "last_seen": nodes["last"], "events": nodes["events"],
        })

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, timer = self._held()
        new = pd.concat([r[["node", "first", "last", "events"]] for r in rows], ignore_index=True)
        new = new.sort_values(["first", "last"], kind="stable").assign(grey=False)
        # What was known of a node stands before its new slots.
        slots = pd.concat([held, new], ignore_index=True).astype(SEEN)
        slots = slots.sort_values("node", kind="stable", ignore_index=True)
        until = slots.groupby("node", sort=False)["last"].cummax()
        same = (slots["node"] == slots["node"].shift()).to_numpy()
        back = same & (slots["first"] - until.shift(fill_value=0) > self.timeout_us).to_numpy()
        period = np.cumsum(~same | back)
        periods = slots.groupby(period, sort=False).agg(
            node=("node", "first"), first=("first", "min"), last=("last", "max"), events=("events", "sum"), grey=("grey", "first")
        )
        began = slots.loc[back, ["node", "first"]]
        latest = (periods["node"] != periods["node"].shift(-1)).to_numpy()
        self._keep(periods[latest], timer)
        told = periods[~latest]
        if len(told):
            yield self._alarms(told[~told["grey"]])
            seen = began["first"]
            yield pd.DataFrame({"node": began["node"], "event": "seen", "at": seen, "first_seen": seen, "last_seen": seen, "events": 0})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, _ = self._held()
        # The timer that fired is gone; a node is silent when its whole millisecond has come.
        ends = -(-(held["last"] + self.timeout_us + 1) // 1_000)
        silent = (ends <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())) & ~held["grey"]
        self._keep(held.assign(grey=held["grey"] | silent), None)
        if silent.any():
            yield self._alarms(held[silent])

    def close(self) -> None:
        pass


def _busy(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """First and last event of a node per slot as long as the timeout; in a slot no silence fits."""
    for pdf in batches:
        slots = pdf.assign(slot=pdf["at"] // width).groupby(["node", "slot"], sort=False)
        told = slots.agg(first=("at", "min"), last=("at", "max"), events=("at", "size"), moment=("moment", "max"))
        yield told.reset_index()[["node", "first", "last", "events", "moment"]]


def silence_alerts(stream: DataFrame, timeout_seconds: float, watermark: str, groups: int = GROUPS) -> DataFrame:
    """Alerts of a stream of (node, ts): (node, event, at, first_seen, last_seen, events).

    'grey' comes once the watermark has passed the moment (`at`) at which a node has been silent for
    longer than the timeout, with the period of activity before it, also for nodes that never send
    again; 'seen' withdraws it when the node does. Tasks first bring the events of a node down to two
    moments per slot, so a hot node sends few rows. Nodes are watched in `groups` of them, whose states
    grow with the number of nodes; a stream keeps the number it began with. Start the stream inside
    `options(spark)`.
    """
    width = int(timeout_seconds * 1_000_000)
    moments = stream.select("node", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("ts").cast("timestamp").alias("moment"))
    busy = moments.where("node is not null and at is not null").mapInPandas(
        lambda batches: _busy(batches, width), "node string, first bigint, last bigint, events bigint, moment timestamp"
    )
    alerts = (
        busy.withWatermark("moment", watermark)
        .withColumn("group", F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int"))
        .groupBy("group")
        .transformWithStateInPandas(Silence(width), outputStructType=ALERT, outputMode="Append", timeMode="EventTime")
    )
    return alerts.select(
        "node", "event", *[F.timestamp_micros(F.col(c)).alias(c) for c in ("at", "first_seen", "last_seen")], "events"
    )
