"""Entities: operations, rules, transitions and the order of states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archweave.graph import Graph
from archweave.operators.aggregate import G, in_order
from archweave.plans.fixpoint import Rounds, frontier


def operations(graph: Graph) -> DataFrame:
    return graph.components.filter("type = 'DomainOp' AND entity IS NOT NULL")


def business_rules(graph: Graph) -> DataFrame:
    """(entity, rule, first place) of distinct rules; domains do not matter."""
    pos = operations(graph).select(G, "entity", "ord", F.posexplode("business_rules").alias("p", "rule"))
    return pos.groupBy(G, "entity", "rule").agg(F.min(F.struct("ord", "p")).alias("at"))


def rule_lists(graph: Graph) -> DataFrame:
    return business_rules(graph).groupBy(G, "entity").agg(in_order("rule", "at").alias("rules"))


def transitions(graph: Graph) -> DataFrame:
    """Every state change with the operation that triggers it, repetitions and ``*`` kept, in document order."""
    rows = operations(graph).select(G, "entity", "ord", "operation_name", F.posexplode("state_changes").alias("p", "x"))
    return rows.select(G, "entity", "ord", "p", F.col("x.from").alias("from"), F.col("x.to").alias("to"), F.col("operation_name").alias("triggered_by"))


def state_order(graph: Graph) -> DataFrame:
    """(entity, state, place): chains from the roots first, then what is left by first appearance.

    A state's successor is its last one; roots are states left but never entered, by first appearance. A state belongs
    to the first root whose chain meets it and stands there by distance; states that no chain meets come last.
    """
    t = transitions(graph).withColumn("at", F.struct("ord", "p"))
    key = [G, "entity"]
    seen = t.select(*key, F.explode(F.array(F.struct("ord", "p", F.lit(0).alias("s"), F.col("from").alias("state")), F.struct("ord", "p", F.lit(1).alias("s"), F.col("to").alias("state")))).alias("x"))
    first = seen.select(*key, F.col("x.state").alias("state"), F.struct("x.ord", "x.p", "x.s").alias("at")).filter("state <> '*'").groupBy(*key, "state").agg(F.min("at").alias("first"))
    steps = t.filter(F.col("from") != "*").groupBy(*key, F.col("from").alias("state")).agg(F.max_by("to", "at").alias("next"), F.min("at").alias("first"))
    roots = steps.join(t.select(*key, F.col("to").alias("state")), [*key, "state"], "left_anti")
    index = F.row_number().over(Window.partitionBy(*key).orderBy("first")).cast("long")
    start = roots.select(*key, "state", index.alias("root"), F.lit(0).cast("long").alias("distance"))
    hop, _ = Rounds(graph.spark).save(steps.select(*key, "state", "next"))

    def step(new: DataFrame) -> DataFrame:
        return new.join(hop, [*key, "state"]).select(*key, F.col("next").alias("state"), "root", (F.col("distance") + 1).alias("distance"))

    walked = frontier(start, step, [*key, "state", "root"])
    met = walked.groupBy(*key, "state").agg(F.min(F.struct("root", "distance")).alias("by"))
    order = Window.partitionBy(*key).orderBy(F.col("by").isNull(), "by", "first")
    return first.join(met, [*key, "state"], "left").select(*key, "state", F.row_number().over(order).cast("long").alias("place"))


def states(graph: Graph) -> DataFrame:
    return state_order(graph).groupBy(G, "entity").agg(in_order("state", "place").alias("states"))


def entities(graph: Graph, domain: str | None = None) -> DataFrame:
    """(domain, entity) with operations by name; states, transitions and rules go by entity name alone, over all domains.

    An empty ``domain`` is no filter.
    """
    o = operations(graph)
    if domain:
        o = o.filter(F.col("domain") == domain)
    by_name = F.struct("operation_name", "ord")
    grouped = o.withColumn("by", by_name).groupBy(G, "domain", "entity").agg(in_order("operation_name", "by").alias("operations"), in_order("id", "by").alias("operation_ids"))
    moves = transitions(graph).withColumn("at", F.struct("ord", "p")).withColumn("move", F.struct("from", "to", "triggered_by")).groupBy(G, "entity").agg(in_order("move", "at").alias("transitions"))
    out = grouped.join(states(graph), [G, "entity"], "left").join(rule_lists(graph), [G, "entity"], "left").join(moves, [G, "entity"], "left")
    full = out.withColumns({"states": F.coalesce("states", F.array().cast("array<string>")), "rules": F.coalesce("rules", F.array().cast("array<string>"))})
    return full.withColumns({"has_states": F.size("states") > 0, "has_business_rules": F.size("rules") > 0, "first_operation_id": F.get("operation_ids", F.lit(0))}).withColumnRenamed("entity", "name")


def total_operations(graph: Graph) -> DataFrame:
    return operations(graph).groupBy(G).agg(F.count("*").alias("operations"))
