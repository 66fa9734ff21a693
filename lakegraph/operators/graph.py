"""Paths, neighbourhoods, merge chains and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakegraph.functions.columns import days_between, half_up
from lakegraph.plans.query import ends
from lakegraph.sources.sinks import stored as written


def best_paths(start: DataFrame, edges: DataFrame, hops: list[tuple[str, str]]) -> DataFrame:
    """``origin, node, hops, mean_confidence, path``: from each id of ``start`` over hops (kind, direction), the best path to each node.

    Best is the highest mean confidence, then the least path. Hops are few and unrolled; each is one join and one
    aggregation that keeps a row for each origin and node.
    """
    state = start.select(F.col("id").alias("origin"), F.col("id").alias("node"), F.lit(0.0).alias("total"), F.col("id").alias("path"))
    for kind, direction in hops:
        step = ends(edges.where(F.col("relationship_type") == kind), direction).select("near", "far", "confidence")
        longer = state.join(step, F.col("node") == F.col("near")).select("origin", F.col("far").alias("node"), (F.col("total") + F.col("confidence")).alias("total"), F.concat_ws(">", "path", "far").alias("path"))
        state = longer.groupBy("origin", "node").agg(F.min(F.struct((-F.col("total")).alias("minus"), "path")).alias("best")).select("origin", "node", (-F.col("best.minus")).alias("total"), "best.path")
    n = max(1, len(hops))
    return state.select("origin", "node", F.lit(len(hops)).alias("hops"), (F.col("total") / n).alias("mean_confidence"), "path")


def paths(start: DataFrame, edges: DataFrame, hops: list[tuple[str, str, DataFrame | None]]) -> DataFrame:
    """``origin, node, hops, mean_confidence, age_days, path``: the best path from each ``id`` of ``start`` to each node.

    A hop is (kind, direction ``out``, ``in`` or ``any``, targets or None); with targets (``id``) only they are reached, and
    targets that are empty reach nothing. Best is the highest mean confidence, then the least path. ``age_days`` is that of
    the newest edge. The best path is kept after every hop, so that a hub passes on one row for each origin.
    """
    state = start.select(F.col("id").alias("origin"), F.col("id").alias("node"), F.lit(0.0).alias("total"), F.lit(None).cast("long").alias("age_days"), F.col("id").alias("path"))
    for kind, direction, targets in hops:
        e = edges.where(F.col("relationship_type") == kind)
        out = e.select(F.col("source_id").alias("near"), F.col("target_id").alias("far"), "confidence", F.col("age_days").alias("age"))
        back = e.select(F.col("target_id").alias("near"), F.col("source_id").alias("far"), "confidence", F.col("age_days").alias("age"))
        step = {"out": out, "in": back, "any": out.unionByName(back)}[direction]
        if targets is not None:
            step = step.join(targets.select(F.col("id").alias("far")), "far", "left_semi")
        longer = state.join(step, F.col("node") == F.col("near")).select(
            "origin", F.col("far").alias("node"), (F.col("total") + F.col("confidence")).alias("total"), F.concat_ws(">", "path", "far").alias("path"), F.least("age_days", "age").cast("long").alias("age_days")
        )
        best = F.min(F.struct((-F.col("total")).alias("minus"), "path", "age_days")).alias("best")
        state = longer.groupBy("origin", "node").agg(best).select("origin", "node", (-F.col("best.minus")).alias("total"), "best.age_days", "best.path")
    return state.select("origin", "node", F.lit(len(hops)).alias("hops"), (F.col("total") / max(1, len(hops))).alias("mean_confidence"), "age_days", "path")


#: Edges at one node above which they are dealt out; each part gets the rows that stand at the node.
HUB_EDGES = 50_000
#: Origins are told apart by so many hash values, the bits of a long, where it is asked whether all of them have seen a node.
SLOTS = 64


def reached(start: DataFrame, edges: DataFrame, most: int | None = None, kinds: list[str] | None = None, direction: str = "out", hub: int = HUB_EDGES) -> DataFrame:
    """``origin, node, hops, mean_confidence, path``: all nodes that each ``id`` of ``start`` reaches in ``most`` hops (None: any number).

    Semi-naive: a round takes only pairs (origin, node) that the last one found, and keeps those that no round has had
    before, so that cycles end and a node has its fewest hops; of equally short paths the best has the highest mean
    confidence, then the least path. Each round's new pairs are written once. The origin itself is no result. A hub's
    edges are dealt out over several keys. Null ids start nowhere, edges with a null end lead nowhere; repeated edges and
    ids count once.
    """
    steps = edges if kinds is None else edges.where(F.col("relationship_type").isin(kinds))
    steps = ends(steps, direction).where("near is not null and far is not null and near <> far").groupBy("near", "far").agg(F.max("confidence").alias("confidence"))
    hubs = steps.groupBy("near").agg(F.count("*").alias("_n")).where(F.col("_n") > hub).select("near", F.ceil(F.col("_n") / hub).cast("int").alias("_parts"))
    hubs = written(hubs, "hubs")
    part = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("far"), F.col("_parts")).cast("int"))
    steps = written(steps.join(hubs, "near", "left").withColumn("_part", part).drop("_parts"), "steps")
    ids = written(start.select("id").where("id is not null").distinct(), "origins")
    front = ids.select(F.col("id").alias("origin"), F.col("id").alias("node"), F.lit(0.0).alias("total"), F.lit(0).alias("hops"), F.col("id").alias("path"))
    seen, found = front.select("origin", "node"), []
    slot = F.pmod(F.xxhash64("origin"), F.lit(SLOTS)).cast("int")
    slots = ids.select(F.col("id").alias("origin")).groupBy(slot.alias("_slot")).agg(F.count("*").alias("_all"))
    every = slots.agg(F.bit_or(F.expr("shiftleft(1L, _slot)")).alias("_every")).head()[0] or 0
    while most is None or len(found) < most:
        at = front.join(hubs.withColumnRenamed("near", "node"), "node", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0)))))
        # what all origins of a slot have seen leads none of them on: such steps go before paths are made and compared
        full = seen.groupBy(F.col("node").alias("far"), slot.alias("_slot")).agg(F.count("*").alias("_n")).join(F.broadcast(slots), "_slot").where("_n = _all")
        full = full.groupBy("far").agg(F.bit_or(F.expr("shiftleft(1L, _slot)")).alias("_full"))
        open_ = steps.join(full, "far", "left").where(F.coalesce("_full", F.lit(0)) != every).alias("s")
        at = at.alias("a")
        unseen = F.coalesce(F.col("s._full"), F.lit(0)).bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(a.origin), {SLOTS}) as int))")) == 0
        longer = at.join(open_, (F.col("a.node") == F.col("s.near")) & (F.col("a._part") == F.col("s._part")) & unseen)
        longer = longer.select("origin", F.col("far").alias("node"), (F.col("total") + F.col("confidence")).alias("total"), F.concat_ws(">", "path", "far").alias("path"))
        best = longer.groupBy("origin", "node").agg(F.min(F.struct((-F.col("total")).alias("minus"), "path")).alias("_best"))
        new = best.join(seen, ["origin", "node"], "left_anti").select("origin", "node", (-F.col("_best.minus")).alias("total"), F.lit(len(found) + 1).alias("hops"), "_best.path")
        front = written(new, f"reached-{len(found) + 1}")
        if front.isEmpty():
            break
        found.append(front)
        seen = seen.unionByName(front.select("origin", "node"))
    rows = found[0] if found else front.where(F.lit(False))
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.select("origin", "node", "hops", (F.col("total") / F.greatest(F.lit(1), F.col("hops"))).alias("mean_confidence"), "path")


def resolve_aliases(aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """``alias_type, alias_value, entity_id``: the unmerged entity of each alias, by confidence, then the newest (``created``)."""
    alive = entities.where("merged_into_id is null").select(F.col("id").alias("entity_id"))
    rows = aliases.join(alive, "entity_id", "left_semi")
    return rows.groupBy("alias_type", "alias_value").agg(F.max_by("entity_id", F.struct("confidence", "created")).alias("entity_id"))


def resolve_merges(entities: DataFrame, most: int = 10) -> DataFrame:
    """``id, final_id``: the end of each merge chain by pointer doubling; a cycle ends at its least id.

    Doubling goes on until no pointer moves. What still moves after ``most`` rounds and once all chains of so many
    entities would have ended is on a cycle or leads to one; the least id seen on the way is doubled along for that.
    Ids are unique; a chain may end at an id that is no entity.
    """
    start = entities.select("id", F.coalesce("merged_into_id", "id").alias("final_id"))
    pointers = written(start.withColumn("_least", F.col("final_id")), "merges")
    rounds = max(most, pointers.count().bit_length() + 1)
    for _ in range(rounds):
        nxt = pointers.select(F.col("id").alias("_mid"), F.col("final_id").alias("_end"), F.col("_least").alias("_low"))
        step = pointers.join(nxt, F.col("final_id") == F.col("_mid"), "left")
        moved = step.select("id", F.coalesce("_end", "final_id").alias("final_id"), F.least("_least", "_low").alias("_least"), (F.coalesce("_end", "final_id") != F.col("final_id")).alias("_moved"))
        new = written(moved, "merges")
        pointers = new.drop("_moved")
        if new.where("_moved").isEmpty():
            break
    # A pointer on a cycle may come to rest at its own place, so the end is looked at once more: only a root points to itself.
    first = start.select(F.col("id").alias("_mid"), (F.col("final_id") != F.col("id")).alias("_on"))
    low = pointers.select(F.col("id").alias("_at"), F.col("_least").alias("_low"))
    ended = pointers.join(first, F.col("final_id") == F.col("_mid"), "left").join(low, F.col("final_id") == F.col("_at"), "left")
    return ended.select("id", F.when(F.col("_on"), F.col("_low")).otherwise(F.col("final_id")).alias("final_id"))


def subgraph(center: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of the star around the centre ids, and edges among the star's nodes."""
    ids = center.select("id")
    star = edges.join(ids, F.col("source_id") == F.col("id"), "left_semi").unionByName(edges.join(ids, F.col("target_id") == F.col("id"), "left_semi")).distinct()
    nodes = star.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return edges.join(nodes, F.col("source_id") == F.col("id"), "left_semi").join(nodes, F.col("target_id") == F.col("id"), "left_semi")


def rank_score(as_of: Column, city: str, category: str) -> Column:
    """Graph rank of an entity row that has ``events, relationships, observed`` counts."""
    age = days_between(as_of, F.col("last_seen_at"))
    fresh = F.when(age <= 7, 12).when(age <= 30, 8).when(age <= 90, 4).otherwise(0)
    c = F.lower(F.trim(F.coalesce("city", F.lit(""))))
    place = F.when((c != "") & (F.contains(c, F.lit(city.lower())) | F.contains(F.lit(city.lower()), c)), 10).otherwise(0) if city else F.lit(0)
    name, cat = F.lower("name"), F.lower(F.coalesce("category", F.lit("")))
    kind = F.when(F.contains(name, F.lit(category.lower())) | F.contains(cat, F.lit(category.lower())), 8).otherwise(0) if category else F.lit(0)
    score = F.lit(35) + fresh + place + kind + F.least(F.lit(20), F.col("events") * 4) + F.least(F.lit(12), F.col("relationships") * 2) + F.least(F.lit(10), F.floor(F.col("observed") / 2)) + half_up(F.col("confidence") * 5)
    return F.least(F.lit(100), score).cast("long")


def with_counts(entities: DataFrame, events: DataFrame, edges: DataFrame, observations: DataFrame, few: bool = False) -> DataFrame:
    """Counts of events, outgoing edges and observations; each is aggregated before its join.

    With ``few`` (a page of entities), only rows of these entities are counted: their ids go to each side first.
    """
    wanted = entities.select(F.col("id").alias("_wanted"))

    def counted(df: DataFrame, key: str, name: str) -> DataFrame:
        df = df.join(F.broadcast(wanted), F.col(key) == F.col("_wanted"), "left_semi") if few else df
        return df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))

    out = entities
    for df, key, name in ((events, "entity_id", "events"), (edges, "source_id", "relationships"), (observations, "entity_id", "observed")):
        out = out.join(counted(df, key, name), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def latest(observations: DataFrame) -> DataFrame:
    """The newest observation of each entity and attribute; ties go to the greater id."""
    w = Window.partitionBy("entity_id", "attribute").orderBy(F.desc("observed_at"), F.desc("id"))
    return observations.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
