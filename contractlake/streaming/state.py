"""Stateful stream operators with timers: turn state, deduplication and change detection, in state that stays bounded.

All of them forget by one rule: what a key has seen counts until `keep_ms` have passed without a row of it. A
row that comes later than that finds nothing, and timers delete what the watermark has left behind as far; so
deleting changes no answer, and each has a batch twin over gaps in time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

TERMINAL = ("Completed", "Interrupted", "Failed")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


#: How many groups the keys of a stream are dealt to. One call handles a group's rows of a batch, so a batch costs calls by groups and not by keys.
GROUPS = 1024


class _Forgetful(StatefulProcessor):
    """Many keys by group: under each group a map from key to what is known of it and the time of its last row, read and written in bulk.

    A timer a group, at multiples of half of keep_ms. names: the columns that go out; types: of the keys.
    """

    def __init__(self, keep_ms: int, keys: list[str], types: str, names: list[str]):
        self.keep_ms, self.keys, self.types, self.names = keep_ms, keys, types, names
        self.whole = {k: t.split()[-1] in ("tinyint", "smallint", "int", "bigint") for k, t in zip(keys, types.split(", "), strict=True)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getListState("known", f"{self.types}, known_value string, known_ms long")

    def changed(self, rows: pd.DataFrame, known: dict[tuple, tuple]) -> list[tuple]:
        """What goes out for the rows, which are in order; known is brought up to them."""
        raise NotImplementedError

    def in_order(self, rows: pd.DataFrame, order: list[str], *columns: str) -> Iterator[tuple]:
        """Each row's key and its columns, by order; a null among numbers stays one."""
        rows = rows.sort_values(order)
        given = []
        for name in self.keys:
            c = rows[name]
            whole = pd.api.types.is_float_dtype(c) and self.whole[name]
            given.append([None if pd.isna(x) else int(x) if whole else x for x in c.tolist()] if c.hasnans else c.tolist())
        return zip(zip(*given), *(rows[c].tolist() for c in columns), strict=True)

    def remind(self, last_ms: int) -> None:
        step = max(1, self.keep_ms // 2)
        self.handle.registerTimer((last_ms + self.keep_ms) // step * step + step)

    def read(self) -> dict[tuple, tuple]:
        return {tuple(row[:-2]): tuple(row[-2:]) for row in self.known.get()}

    def put(self, known: dict[tuple, tuple]) -> None:
        if known:
            self.known.put([(*key, *value) for key, value in known.items()])
        else:
            self.known.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.read()
        out = self.changed(pd.concat(list(rows)), known)
        self.put(known)
        # the group is looked at when its first key is due; later ones are due again then
        self.remind(min(ms for _, ms in known.values()))
        yield pd.DataFrame({name: list(c) for name, c in zip(self.names, zip(*out), strict=True)} if out else {name: [] for name in self.names}, dtype=object)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        known = self.read()
        kept = {k: v for k, v in known.items() if v[1] + self.keep_ms >= watermark}
        if len(kept) < len(known):
            self.put(kept)
        if kept:
            self.remind(min(ms for _, ms in kept.values()))
        yield pd.DataFrame([], columns=self.names)

    def close(self) -> None:
        pass


class _Turns(_Forgetful):
    """Known of a turn (or item) is its status."""

    def changed(self, rows: pd.DataFrame, known: dict[tuple, tuple]) -> list[tuple]:
        out = []
        for at, seq, status, ms in self.in_order(rows, ["seq"], "seq", "status", "ms"):
            now, last = known.get(at, ("", 0))
            if ms - last > self.keep_ms:
                now = ""
            if now not in TERMINAL and status != now:
                now = status
                out.append((*at, seq, status))
            known[at] = (now, max(last, ms))
        return out


class _Last(_Forgetful):
    """Known of a key is its last value. Rows whose value is new to the key, and all rows of a key without values, go on with the value before."""

    def changed(self, rows: pd.DataFrame, known: dict[tuple, tuple]) -> list[tuple]:
        out = []
        for at, seq, new, ms in self.in_order(rows, ["ms", "seq"], "seq", "value", "ms"):
            value, last = known.get(at, (None, None))
            if last is None or ms - last > self.keep_ms:
                value = None
            if new is not None and new != value:
                out.append((*at, seq, new, value))
                value = new
            known[at] = (value, ms if last is None else max(last, ms))
        return out


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the group of their keys in front."""
    return rows.select(F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int").alias("key_group"), "*")


def reduce_turns(events: DataFrame, time: str, keys: tuple[str, ...] = ("thread", "turn"), keep_ms: int = 3_600_000) -> DataFrame:
    """events: keys, seq, status and time, a column under a watermark. A row for each accepted change of status: keys, seq, status.

    The first terminal status stays, later events never reopen what has ended, until keep_ms pass without an
    event of it: then it may start anew. keys say what has a status: turns, or with an item among them, items.
    Rows behind the watermark are dropped. Needs the state store that `started` sets up.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    kinds = ", ".join(f"{k} {types[k]}" for k in keys)
    processor = _Turns(keep_ms, list(keys), kinds, [*keys, "seq", "status"])
    rows = _grouped(events.select(*keys, "seq", "status", time, F.unix_millis(F.col(time)).alias("ms")), list(keys))
    return rows.groupBy("key_group").transformWithStateInPandas(processor, f"{kinds}, seq long, status string", "Append", "EventTime")


def reduce_turns_sessions(events: DataFrame, time: str, keys: tuple[str, ...] = ("thread", "turn"), keep_ms: int = 3_600_000) -> DataFrame:
    """The batch twin of reduce_turns: within each run of events without a longer gap than keep_ms, the changes up to the first terminal status."""
    ms = F.unix_millis(F.col(time))
    order = Window.partitionBy(*keys).orderBy("seq")
    before = F.max("ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.coalesce(F.col("ms") - F.col("before") > keep_ms, F.lit(False)).cast("int")).over(order)
    rows = events.withColumn("ms", ms).withColumn("before", before).withColumn("run", run)
    within = Window.partitionBy(*keys, "run").orderBy("seq")
    ended = F.max(F.col("status").isin(*TERMINAL).cast("int")).over(within.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("ended", F.coalesce(ended, F.lit(0))).withColumn("was", F.lag("status").over(within))
    return rows.filter("ended = 0 and not (status <=> was)").select(*keys, "seq", "status")


def _last(rows: DataFrame, keys: list[str], seq: str, value: Column, time: str, keep_ms: int) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    kinds = ", ".join(f"{k} {types[k]}" for k in keys)
    processor = _Last(keep_ms, keys, kinds, [*keys, "seq", "value", "previous"])
    given = _grouped(rows.select(*keys, F.col(seq).cast("long").alias("seq"), value.alias("value"), time, F.unix_millis(F.col(time)).alias("ms")), keys)
    return given.groupBy("key_group").transformWithStateInPandas(processor, f"{kinds}, seq long, value string, previous string", "Append", "EventTime").select(*processor.names)


def dedupe(items: DataFrame, keys: list[str], seq: str, time: str, keep_ms: int) -> DataFrame:
    """keys, seq of rows of overlapping pages that no row of the same keys precedes within keep_ms; a repeat after a longer silence comes back. time is under a watermark."""
    return _last(items, keys, seq, F.lit("there"), time, keep_ms).select(*keys, "seq")


def dedupe_sessions(items: DataFrame, keys: list[str], seq: str, time: str, keep_ms: int) -> DataFrame:
    """The batch twin of dedupe, by gaps in time."""
    ms = F.unix_millis(F.col(time))
    gap = ms - F.lag(ms).over(Window.partitionBy(*keys).orderBy(ms, seq))
    return items.withColumn("gap", gap).filter(F.col("gap").isNull() | (F.col("gap") > keep_ms)).select(*keys, F.col(seq).cast("long").alias("seq"))


def model_changes(events: DataFrame, time: str, keep_ms: int) -> DataFrame:
    """events: stream, seq, model and time, under a watermark. stream, seq, model, previous of rows whose model is known and is not the last one known, which counts until keep_ms pass without a row of the stream."""
    out = _last(events, ["stream"], "seq", F.col("model"), time, keep_ms)
    return out.select("stream", "seq", F.col("value").alias("model"), "previous")


def model_changes_sessions(events: DataFrame, time: str, keep_ms: int) -> DataFrame:
    """The batch twin of model_changes."""
    ms = F.unix_millis(F.col(time))
    order = Window.partitionBy("stream").orderBy("ms", "seq")
    rows = events.select("stream", F.col("seq").cast("long").alias("seq"), "model", ms.alias("ms"))
    rows = rows.withColumn("gap", F.col("ms") - F.lag("ms").over(order)).withColumn("run", F.sum(F.coalesce(F.col("gap") > keep_ms, F.lit(False)).cast("int")).over(order))
    known = F.last("model", ignorenulls=True).over(Window.partitionBy("stream", "run").orderBy("ms", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("previous", known).filter("model is not null and not (model <=> previous)").select("stream", "seq", "model", "previous")


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def started(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a stateful stream into Parquet over all that is there now. Only this query gets the state store that timers need; the session's setting stays."""
    with _rocksdb(stream.sparkSession):
        return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def staged(rows: DataFrame, piece: Column, pieces: int, path: str) -> DataFrame:
    """rows as a stream of `pieces` batches: piece i (0 to pieces - 1) is written as the i-th file and read by the i-th batch."""
    for i in range(pieces):
        rows.filter(piece == i).coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
