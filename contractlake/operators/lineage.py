"""Trees and closures over threads, rollouts and configuration edges, by joins in rounds of doubling."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; unset, in a temporary one for a local master, else in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        local = spark.sparkContext.master.startswith("local[")
        path = tempfile.mkdtemp(prefix="contractlake-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_contractlake"
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder."""
    target = scratch(df.sparkSession, "lineage")
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def roots(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """Root and depth of every node. A parent that is no node ends the chain at its child; nodes on a cycle have a null root.

    Pointer doubling: a round joins each node's ancestor with that one's own, so a chain of n nodes
    takes log2(n) rounds; only counts reach the driver.
    """
    known = nodes.select(F.col(node).alias("p")).distinct()
    start = nodes.select(F.col(node).alias("n"), F.col(parent).alias("p")).join(known.withColumn("there", F.lit(True)), "p", "left")
    up = F.when(F.col("there"), F.col("p"))
    now = written(start.select("n", up.alias("up"), F.when(up.isNull(), 0).otherwise(1).cast("long").alias("depth"), F.when(up.isNull(), F.col("n")).alias("root")))
    open_before = None
    while True:
        waiting = now.filter("root is null").count()
        # while a chain is open, each round reaches the root from some of its nodes; else only cycles are left
        if waiting in (0, open_before):
            break
        open_before = waiting
        a = now.select(F.col("n").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("root").alias("r2"))
        j = now.filter("root is null").join(a, "up")
        moved = j.select("n", F.when(F.col("r2").isNull(), F.col("up2")).alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), F.col("r2").alias("root"))
        now = written(now.filter("root is not null").unionByName(moved))
    return now.select(F.col("n").alias(node), F.col("root"), F.when(F.col("root").isNotNull(), F.col("depth")).alias("depth"))


def _threads(e: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Edges e (node, next) with their threads taken together: links (node, next, length, thread) between what is left, and members (thread, at, node); None where there is no thread.

    A thread is a run of nodes with one edge in and one out; `at` counts from the node before it. Each
    node finds the start of its thread by doubling, so a thread of n nodes takes log2(n) rounds. A ring
    of such nodes is cut at its least one.
    """
    outs = e.groupBy("node").agg(F.count("*").alias("outs"))
    ins = e.groupBy(F.col("next").alias("node")).agg(F.count("*").alias("ins"))
    inner = written(outs.filter("outs = 1").join(ins.filter("ins = 1"), "node").select("node"))
    if inner.isEmpty():
        return None
    before = e.select(F.col("next").alias("node"), F.col("node").alias("up")).join(inner, "node").join(inner.select(F.col("node").alias("up"), F.lit(True).alias("open")), "up", "left")
    now = written(before.select("node", "up", F.lit(1).cast("long").alias("at"), F.col("node").alias("thread"), F.least("node", "up").alias("least"), F.coalesce("open", F.lit(False)).alias("open")))
    left = None
    while True:
        state = now.filter("open").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "least").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == left:
            break
        left = (state["n"], state["h"])
        j = now.filter("open").join(now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("at").alias("at2"), F.col("thread").alias("thread2"), F.col("least").alias("least2"), F.col("open").alias("open2")), "up")
        moved = j.select("node", F.col("up2").alias("up"), (F.col("at") + F.col("at2")).alias("at"), F.col("thread2").alias("thread"), F.least("least", "least2").alias("least"), F.col("open2").alias("open"))
        now = written(now.filter("not open").unionByName(moved))
    if state["n"]:
        # only rings are open; without their least nodes they are threads
        cuts = now.filter("open and node = least").select("node")
        rings = now.filter("open").select("node")
        rest = _threads_of(e, written(inner.join(cuts, "node", "left_anti")), rings)
        now = written(now.filter("not open").select("node", "up", "at", "thread").unionByName(rest))
    members = now.select("thread", "at", "node", "up")
    ends = members.groupBy("thread").agg(F.max(F.struct("at", "node")).alias("last"), F.first("up").alias("node"))
    threads = ends.join(e.select(F.col("node").alias("tail"), "next"), F.col("last.node") == F.col("tail")).select("node", "next", (F.col("last.at") + 1).alias("length"), "thread")
    through = members.select("node")
    direct = e.join(through, "node", "left_anti").join(through.withColumnRenamed("node", "next"), "next", "left_anti")
    kind = e.schema["node"].dataType
    links = threads.unionByName(direct.select("node", "next", F.lit(1).cast("long").alias("length"), F.lit(None).cast(kind).alias("thread")))
    return written(links), written(members.select("thread", "at", "node"))


def _threads_of(e: DataFrame, inner: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, up, at, thread of those inner nodes that are among nodes, none of which is on a ring."""
    before = e.select(F.col("next").alias("node"), F.col("node").alias("up")).join(inner, "node").join(nodes, "node").join(inner.select(F.col("node").alias("up"), F.lit(True).alias("open")), "up", "left")
    now = written(before.select("node", "up", F.lit(1).cast("long").alias("at"), F.col("node").alias("thread"), F.coalesce("open", F.lit(False)).alias("open")))
    while not now.filter("open").isEmpty():
        j = now.filter("open").join(now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("at").alias("at2"), F.col("thread").alias("thread2"), F.col("open").alias("open2")), "up")
        now = written(now.filter("not open").unionByName(j.select("node", F.col("up2").alias("up"), (F.col("at") + F.col("at2")).alias("at"), F.col("thread2").alias("thread"), F.col("open2").alias("open"))))
    return now.drop("open")


def _and(df: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([*df.schema, *(T.StructField(name, kind) for name, kind in more.items())])


def _layers(step: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Links (node, next, length) layer by layer, and those left over (None: none). A node's layer is the most links on a way to it.

    A round takes the links of all nodes that no link left ends at. Cycles and what lies behind them are left over, and so is
    everything as soon as a round takes under a sixteenth of it: all rounds together read the links some sixteen times at most.
    """
    spark, taken, left = step.sparkSession, [], step
    while True:
        path = scratch(spark, "layer")
        ends = left.select(F.col("next").alias("node"), F.lit(True).alias("later")).distinct()
        left.join(ends, "node", "left").select(*step.columns, F.coalesce("later", F.lit(False)).alias("later")).write.partitionBy("later").parquet(path)
        parts = spark.read.schema(_and(step, later=T.BooleanType())).parquet(path)
        rows = {r["later"]: r["count"] for r in parts.groupBy("later").count().collect()}
        now, later = rows.get(False, 0), rows.get(True, 0)
        if now * 16 < now + later or now == 0:
            return taken, left if later else None
        taken.append(parts.filter("not later").drop("later"))
        left = parts.filter("later").drop("later")
        if later == 0:
            return taken, None


_REST, _THREAD = -1, -2


def _placed(layers: list[DataFrame], left: DataFrame | None, threads: DataFrame, path: str) -> DataFrame:
    """Write the layers' links with the layer that each leads to, one folder a layer, and return node, layer: 0 where no link ends, without a row; _REST for nodes of links left over.

    threads (node, thread) are written with the links as ways into the layer _THREAD.
    """
    spark = threads.sparkSession
    levels = spark.createDataFrame([], _and(threads.select("node"), layer=T.IntegerType()))
    links = None
    if layers:
        links = layers[0].withColumn("layer", F.lit(0))
        for n, each in enumerate(layers[1:], 1):
            links = links.unionByName(each.withColumn("layer", F.lit(n)))
        levels = links.groupBy(F.col("next").alias("node")).agg((F.max("layer") + 1).alias("layer"))
    if left is not None:
        rest = left.select("node").unionByName(left.select(F.col("next").alias("node"))).distinct()
        levels = levels.join(rest, "node", "left_anti").unionByName(rest.withColumn("layer", F.lit(_REST)))
    levels = written(levels)
    into = threads.join(levels, "node", "left").select("node", F.col("thread").alias("next"), F.lit(0).cast("long").alias("length"), F.lit(_THREAD).alias("to"), F.coalesce("layer", F.lit(0)).alias("layer"))
    if links is not None:
        into = into.unionByName(links.join(levels.select(F.col("node").alias("next"), F.col("layer").alias("to")), "next"))
    into.write.partitionBy("layer").parquet(path)
    return levels


def _relaxed(step: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pairs (start, node, hops) over links that may hold cycles: those that got shorter go on, round by round, until none does."""
    known = frontier = written(seeds)
    while True:
        longer = frontier.join(step, "node").groupBy("start", F.col("next").alias("node")).agg(F.min(F.col("hops") + F.col("length")).alias("hops"))
        better = longer.join(known.select("start", "node", F.col("hops").alias("best")), ["start", "node"], "left").filter("best is null or hops < best").drop("best")
        frontier = written(better)
        if frontier.isEmpty():
            return known
        known = written(known.unionByName(frontier).groupBy("start", "node").agg(F.min("hops").alias("hops")))


def closure(edges: DataFrame, starts: DataFrame, most_hops: int | None = None) -> DataFrame:
    """What each start reaches over directed edges (from_id, to_id), with the fewest hops (the start itself: 0). Cycles stop, as a pair is kept once.

    starts: id. Runs of nodes with one way in and one way out are first taken together as single links
    with a length (log2 of the longest run in rounds). The nodes left are put in layers, and pairs go through them
    layer by layer: when a layer's turn comes, all ways to its nodes are known, so that each pair is written once and never
    compared with those before. On and behind cycles pairs are relaxed until none gets shorter. Last the nodes inside the
    links come back. Where most_hops is given and something new lies beyond it, RuntimeError.
    """
    spark = edges.sparkSession
    e = written(edges.filter("from_id is not null and to_id is not null and from_id != to_id").select(F.col("from_id").alias("node"), F.col("to_id").alias("next")).distinct())
    seeds = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct().withColumn("hops", F.lit(0).cast("long"))
    found = _threads(e)
    if found is None:
        step, threads = e.withColumn("length", F.lit(1).cast("long")), e.select("node", F.col("next").alias("thread")).limit(0)
    else:
        links, members = found
        # a start inside a run reaches the rest of it and the run's end
        inside = written(seeds.join(members, "node").select("start", "thread", F.col("at").alias("from")))
        within = inside.join(members, "thread").filter(F.col("at") > F.col("from")).select("start", "node", (F.col("at") - F.col("from")).alias("hops"))
        out = inside.join(links.select("thread", "next", "length"), "thread").select("start", F.col("next").alias("node"), (F.col("length") - F.col("from")).alias("hops"))
        seeds = seeds.unionByName(out)
        step, threads = links.groupBy("node", "next").agg(F.min("length").alias("length")), links.filter("thread is not null").select("node", "thread")
    layers, left = _layers(step)
    placed, waiting, reached = (scratch(spark, name) for name in ("placed", "waiting", "reached"))
    levels = _placed(layers, left, threads, placed)
    seeds.join(levels, "node", "left").select("start", "node", "hops", F.coalesce("layer", F.lit(0)).alias("layer")).write.partitionBy("layer").parquet(waiting)
    due = lambda layer: spark.read.schema(_and(seeds, layer=T.IntegerType())).parquet(waiting).filter(F.col("layer") == layer).drop("layer")
    fewest = lambda pairs: pairs.groupBy("start", "node").agg(F.min("hops").alias("hops"))
    ways = spark.read.schema(_and(step, to=T.IntegerType(), layer=T.IntegerType())).parquet(placed)
    for n in range(len(layers) + 1):
        now = f"{reached}/layer={n}"
        fewest(due(n)).write.parquet(now)
        on = spark.read.schema(seeds.schema).parquet(now).join(ways.filter(F.col("layer") == n).drop("layer"), "node")
        on.select("start", F.col("next").alias("node"), (F.col("hops") + F.col("length")).alias("hops"), F.col("to").alias("layer")).write.partitionBy("layer").mode("append").parquet(waiting)
    known = spark.read.schema(seeds.schema).parquet(reached).select(*seeds.columns)
    entered = due(_THREAD)
    if left is not None:
        behind = _relaxed(left, fewest(due(_REST)))
        known = known.unionByName(behind)
        entered = entered.unionByName(behind.join(ways.filter(F.col("layer") == _REST), "node").select("start", F.col("next").alias("node"), "hops"))
    if found is not None:
        through = entered.withColumnRenamed("node", "thread").join(members, "thread").select("start", "node", (F.col("hops") + F.col("at")).alias("hops"))
        # a start inside a run that comes back to itself is known with 0
        known = known.unionByName(written(fewest(through.unionByName(within).filter("start != node"))))
    if most_hops is not None and not known.filter(F.col("hops") > most_hops).isEmpty():
        raise RuntimeError(f"a node lies over {most_hops} hops away")
    return known.withColumn("hops", F.col("hops").cast("int"))


def labelled_closure(edges: DataFrame, starts: DataFrame, moves: DataFrame, most_hops: int | None = None) -> DataFrame:
    """Reachability over labelled edges by the moves of an automaton: start, state, node, hops (the fewest).

    edges: from_id, to_id, label; starts: id, state; moves: state, label, to_state. A pair of state and node
    is a node of its own, so ways of different kinds that meet in a node are never merged.
    """
    both = edges.join(F.broadcast(moves), "label")
    pair = lambda state, node: F.struct(F.col(state).alias("state"), F.col(node).alias("node"))
    steps = both.select(pair("state", "from_id").alias("from_id"), pair("to_state", "to_id").alias("to_id"))
    out = closure(steps, starts.select(pair("state", "id").alias("id")), most_hops)
    return out.select(F.col("start.node").alias("start"), F.col("start.state").alias("from_state"), F.col("node.state").alias("state"), F.col("node.node").alias("node"), "hops")


def chains(links: DataFrame) -> DataFrame:
    """links: start, node, cut; at most one a start. All ancestors: start, node, hops, cut (the smallest on the way; null: none). A cycle ends before it comes back.

    A round joins each chain with the chains of its end, so a chain of n links takes log2(n) rounds;
    only counts reach the driver.
    """
    now = written(links.filter("node is not null and start != node").select("start", "node", F.lit(1).alias("hops"), "cut"))
    known = now.count()
    while True:
        after = now.select(F.col("start").alias("node"), F.col("node").alias("end"), F.col("hops").alias("more"), F.col("cut").alias("then"))
        longer = now.join(after, "node").filter(F.col("start") != F.col("end")).select("start", F.col("end").alias("node"), (F.col("hops") + F.col("more")).alias("hops"), F.least("cut", "then").alias("cut"))
        now = written(now.unionByName(longer).groupBy("start", "node").agg(F.min(F.struct("hops", "cut")).alias("m")).select("start", "node", "m.*"))
        reached = now.count()
        if reached == known:
            return now
        known = reached


def delete_safety(references: DataFrame, doomed: DataFrame) -> DataFrame:
    """references: rollout, base; doomed: set_id, rollout. Per set: the rollouts outside that refer into it, and whether it may go."""
    into = references.join(doomed.select("set_id", F.col("rollout").alias("base")), "base").select("set_id", "rollout")
    outside = into.join(doomed, ["set_id", "rollout"], "left_anti").groupBy("set_id").agg(F.array_sort(F.collect_set("rollout")).alias("blockers"))
    sets = doomed.select("set_id").distinct()
    empty = F.array().cast(references.select(F.array("rollout")).schema[0].dataType)
    return sets.join(outside, "set_id", "left").select("set_id", F.coalesce("blockers", empty).alias("blockers"), F.col("blockers").isNull().alias("safe"))
