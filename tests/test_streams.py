"""Streams against their batch twins; state that stays bounded; a projection that is stopped, replayed and shrunk."""

from __future__ import annotations

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from contractlake.streaming import state
from contractlake.streaming.projection import Projection

HOUR = 3_600_000


def events(spark, n, seed, keys=4, every=20):
    """Rows in time order, with silences in between."""
    r = random.Random(seed)
    rows, minute = [], 0
    for i in range(n):
        minute += r.choice([0, 1, every, 400])
        rows.append((r.randrange(keys), r.randrange(2), i, r.choice(["InProgress", "InProgress", "Waiting", "Completed", "Failed"]), r.choice(["m1", "m2", None]), minute))
    df = spark.createDataFrame(rows, "thread long, turn long, seq long, status string, model string, minute long")
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("minute") * 60)).withColumn("piece", F.floor(F.col("seq") * 6 / n))


def streamed(spark, rows, tmp, operator):
    stream = state.staged(rows, F.col("piece"), 6, str(tmp / "in")).withWatermark("ts", "1 minute")
    out = operator(stream)
    q = state.started(out, str(tmp / "out"), str(tmp / "state"))
    q.awaitTermination()
    return Counter(map(tuple, spark.read.schema(out.schema).parquet(str(tmp / "out")).collect())), [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]


OPERATORS = {
    "turns": (lambda d: state.reduce_turns(d, "ts", keep_ms=HOUR), lambda d: state.reduce_turns_sessions(d, "ts", keep_ms=HOUR)),
    "items": (lambda d: state.reduce_turns(d, "ts", ("thread", "turn", "model"), HOUR), lambda d: state.reduce_turns_sessions(d, "ts", ("thread", "turn", "model"), HOUR)),
    "dedupe": (lambda d: state.dedupe(d, ["thread", "status"], "seq", "ts", HOUR), lambda d: state.dedupe_sessions(d, ["thread", "status"], "seq", "ts", HOUR)),
    "models": (lambda d: state.model_changes(d.withColumnRenamed("thread", "stream"), "ts", HOUR), lambda d: state.model_changes_sessions(d.withColumnRenamed("thread", "stream"), "ts", HOUR)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_streams_equal_their_twins(spark, tmp_path, name):
    rows = events(spark, 150, 5)
    if name == "items":
        rows = rows.filter("model is not null")
    stream, twin = OPERATORS[name]
    got, _ = streamed(spark, rows, tmp_path, stream)
    assert got == Counter(map(tuple, twin(rows).collect()))


@pytest.mark.parametrize("name", ["turns", "dedupe", "models"])
def test_state_is_bounded(spark, tmp_path, name):
    """Each piece has keys of its own, a day behind those before: what is kept is that of about one piece."""
    rows = spark.range(240).select(F.col("id").alias("thread"), F.lit(0).cast("long").alias("turn"), F.col("id").alias("seq"), F.lit("InProgress").alias("status"), F.lit("m").alias("model"), F.floor(F.col("id") / 40).alias("piece"))
    rows = rows.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("piece") * 86_400))
    got, kept = streamed(spark, rows, tmp_path, OPERATORS[name][0])
    assert sum(got.values()) == 240 and max(kept) <= 200 and kept[-1] <= 100, kept


def test_calls_grow_with_groups_not_keys(spark):
    """Many keys of a batch are handled by few calls, whose state is read and written once a call."""
    calls = []

    class Listed:
        def __init__(self):
            self.rows = []

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            calls.append(len(rows))
            self.rows = rows

        def clear(self):
            self.rows = []

    class Handle:
        def getListState(self, *_):
            return Listed()

        def registerTimer(self, _):
            pass

    p = state._Last(HOUR, ["k"], "k bigint", ["k", "seq", "value", "previous"])
    p.init(Handle())
    rows = pd.DataFrame({"k": [*range(500), None], "seq": range(501), "value": ["a"] * 501, "ms": [5] * 501})
    out = next(p.handleInputRows((0,), iter([rows]), None))
    assert len(out) == 501 and calls == [501] and out["k"].tolist()[-1] is None and out["k"].tolist()[7] == 7
    again = next(p.handleInputRows((0,), iter([rows.assign(ms=6)]), None))
    assert len(again) == 0


def log(spark, rows):
    return spark.createDataFrame(rows, "rollout string, ordinal long, offset long, bytes long, item string, log_bytes long")


def test_projection(spark, tmp_path):
    first = log(spark, [("a", i, 10 * i, 10, f"a{i}", 10 * i + 10) for i in range(4)] + [("b", 0, 0, 5, "b0", 5), ("b", 0, 0, 5, "b0", 5)])
    p = Projection(spark, str(tmp_path / "p"), first.schema, compact_every=2)
    assert p.items().count() == 0 and p.errors().count() == 0
    p.put(first, 0)
    p.put(first, 0)
    assert sorted((r["rollout"], r["ordinal"]) for r in p.items().collect()) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0)]
    # replayed rows, a log that shrank, and one that leaves an item out
    p.put(log(spark, [("a", 3, 30, 10, "a3", 60), ("a", 4, 40, 10, "a4", 60), ("b", 0, 0, 3, "x", 3), ("c", 1, 4, 4, "c1", 8)]), 1)
    assert sorted((r["rollout"], r["code"], r["projected_offset"], r["log_bytes"]) for r in p.errors().collect()) == [("b", "ROLLOUT_LOG_SHRUNK", 5, 3), ("c", "ROLLOUT_LOG_GAP", None, 8)]
    p.put(log(spark, [("c", 0, 0, 4, "c0", 12), ("c", 1, 4, 4, "c1", 12), ("b", 1, 5, 5, "b1", 10)]), 2)
    assert p.runs() == ["c2"]
    # the last batch again, as after a crash
    p.put(log(spark, [("c", 0, 0, 4, "c0", 12), ("c", 1, 4, 4, "c1", 12), ("b", 1, 5, 5, "b1", 10)]), 2)
    p.put(log(spark, [("a", 5, 50, 10, "a5", 60)]), 3)
    p.vacuum()
    assert sorted(x.name for x in (tmp_path / "p" / "runs").iterdir()) == ["b3", "c2"]
    got = sorted((r["rollout"], r["ordinal"], r["item"]) for r in p.items().collect())
    assert got == [("a", i, f"a{i}") for i in range(6)] + [("b", 0, "b0"), ("b", 1, "b1"), ("c", 0, "c0"), ("c", 1, "c1")]
    assert sorted(map(tuple, p.positions().collect())) == [("a", 6, 60), ("b", 2, 10), ("c", 2, 8)]


def test_batches_of_the_log_are_many_files(spark, tmp_path, monkeypatch):
    from contractlake.jobs import queries as core
    from contractlake.operators import lineage

    from .oracle import same

    monkeypatch.setattr(lineage, "scratch", lambda s, name, n=iter(range(1000)): f"{tmp_path}/{name}-{next(n)}")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        same(spark, "/root/testdata/sf0.001", core.queries()["t1_incremental_projection"], core.oracle_sql()["t1_incremental_projection"])
    finally:
        for k in conf:
            spark.conf.unset(k)
    # four batches
    assert len(list(tmp_path.glob("log-*/part-*.parquet"))) > 4
