"""Where a fork leaves its base's history: boundaries resolved to ordinals, over bases that are forks themselves.

Ordinals number a whole lineage: a fork's own items go on behind those that it took over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import chains, written


def turn_intervals(items: DataFrame) -> DataFrame:
    """items: rollout, ordinal, turn, ends (whether the item completes its turn). rollout, turn, first, last (ordinals), completed; items without a turn are in none."""
    return items.filter("turn is not null").groupBy("rollout", "turn").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.coalesce(F.bool_or("ends"), F.lit(False)).alias("completed"))


def latest_cuts(forks: DataFrame, items: DataFrame, width: int = 1024) -> DataFrame:
    """As-of search. forks: rollout, base, at; items: rollout, ordinal, at (never falling with the ordinal). rollout, cut: the ordinal behind the base's last item of at or before; where all its items are later, its first ordinal; null where it has none.

    Ordinals are searched in runs of `width`: first which run the moment falls into, by the runs' first
    moments, then within that run. So a base with many items and forks is one small row a run, then many keys.
    """
    run = F.floor(F.col("ordinal") / width)
    rows = items.select(F.col("rollout").alias("base"), "ordinal", F.col("at").alias("then"), run.alias("run"))
    runs = rows.groupBy("base", "run").agg(F.min("then").alias("since"), F.min("ordinal").alias("first"))
    asked = forks.select("rollout", "base", "at")
    known = asked.join(runs, "base")
    of = known.groupBy("rollout", "base", "at").agg(F.max(F.when(F.col("since") <= F.col("at"), F.col("run"))).alias("run"), F.min("first").alias("first"))
    last = of.join(rows, ["base", "run"]).filter("then <= at").groupBy("rollout").agg((F.max("ordinal") + 1).alias("behind"))
    return of.join(last, "rollout", "left").select("rollout", F.coalesce("behind", "first").alias("cut"))


def resolve_boundaries(forks: DataFrame, items: DataFrame) -> DataFrame:
    """rollout, base, boundary (latest, through_turn, before_turn), cut (ordinals of the base's history from it on are not taken; null: all), code.

    forks: rollout, base, at, last_turn, before_turn, at most one row each; items: rollout, ordinal, turn,
    ends, at. last_turn takes its turn over, before_turn ends in front of it; with neither the fork takes
    what its base had at the moment `at` (null: all). The turn is sought in the base and, nearest first, in the
    bases that it goes back to, and counts only as far as the histories in between took it over. code:
    BOUNDARY_CONFLICT where both are given, TURN_NOT_IN_HISTORY, TURN_NOT_COMPLETED (last_turn only: the turn
    has no end, or was cut before it). Such a fork takes nothing, so what goes back to it ends there. Rows without a
    base have neither boundary nor code.

    What a fork finds depends on the cuts of its bases; all are sought at once and again until no cut
    changes, which takes as many rounds as wrongly taken turns hang on each other, not as the chains are long.
    """
    through, before = F.col("last_turn").isNotNull(), F.col("before_turn").isNotNull()
    kind = F.when(through & before, "conflict").when(through, "through_turn").when(before, "before_turn").otherwise("latest")
    own = written(forks.filter("base is not null").select("rollout", "base", "at", kind.alias("boundary"), F.coalesce("last_turn", "before_turn").alias("turn")))
    latest = latest_cuts(own.filter("boundary = 'latest' and at is not null"), items)
    fixed = written(own.join(latest, "rollout", "left").select("rollout", "base", "boundary", "turn", "cut"))
    above = written(chains(fixed.select(F.col("rollout").alias("start"), F.col("base").alias("node"), F.lit(None).cast("long").alias("cut"))))
    turns = turn_intervals(items).withColumnRenamed("rollout", "node")
    asking = fixed.filter("boundary in ('through_turn', 'before_turn')").select(F.col("rollout").alias("start"), "base", "turn", "boundary")
    places = written(asking.join(above.select("start", "node", "hops"), "start").join(turns, ["node", "turn"]))

    def settle(paths: DataFrame | None) -> DataFrame:
        """Cuts and codes, given how far each base's history reaches into what lies above it; none known yet: everywhere."""
        p = places.withColumn("reach", F.lit(None).cast("long"))
        if paths is not None:
            p = places.join(paths.select(F.col("start").alias("base"), "node", F.col("cut").alias("reach"), F.lit(True).alias("there")), ["base", "node"], "left").filter("hops = 1 or there")
        p = p.filter("reach is null or first < reach")
        whole = F.col("completed") & (F.col("reach").isNull() | (F.col("last") < F.col("reach")))
        found = p.groupBy(F.col("start").alias("rollout")).agg(F.min_by(F.struct("first", "last", whole.alias("whole")), "hops").alias("t"))
        j = fixed.join(found, "rollout", "left")
        turn_bound = F.col("boundary").isin("through_turn", "before_turn")
        code = F.when(F.col("boundary") == "conflict", "BOUNDARY_CONFLICT").when(turn_bound & F.col("t").isNull(), "TURN_NOT_IN_HISTORY").when((F.col("boundary") == "through_turn") & ~F.col("t.whole"), "TURN_NOT_COMPLETED")
        cut = F.when(F.col("boundary") == "through_turn", F.col("t.last") + 1).when(F.col("boundary") == "before_turn", F.col("t.first")).otherwise(F.col("cut"))
        return written(j.select("rollout", "base", "boundary", F.when(code.isNull(), cut.cast("long")).alias("cut"), code.alias("code")))

    now = settle(None)
    while True:
        sound = now.filter("code is null").select(F.col("rollout").alias("start"), F.col("base").alias("node"), "cut")
        then = settle(chains(sound))
        old = now.select("rollout", F.col("cut").alias("c"), F.col("code").alias("e"))
        if then.join(old, "rollout").filter("not (cut <=> c) or not (code <=> e)").isEmpty():
            break
        now = then
    rest = forks.filter("base is null").select("rollout", "base", F.lit(None).cast("string").alias("boundary"), F.lit(None).cast("long").alias("cut"), F.lit(None).cast("string").alias("code"))
    return now.withColumn("boundary", F.nullif("boundary", F.lit("conflict"))).unionByName(rest)
