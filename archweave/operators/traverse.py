"""Traversal: closures, depths, flows and contraction, all set-based on the fixed-point kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archweave.graph import Graph, GraphError, link_key
from archweave.operators.aggregate import G, entry_points
from archweave.operators.flows import flow_external_links, flows  # noqa: F401  traversals too
from archweave.operators.select import search
from archweave.plans.fixpoint import Rounds, frontier, least_by_key


def _edges(graph: Graph) -> DataFrame:
    return graph.links.select(G, "ord", "source", "target")


def closure(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, id, depth): ids reachable from ``starts`` over directed (source, target), by least hops."""
    # every round joins the hops: they are written once, however much work it was to find them
    hop, _ = Rounds(edges.sparkSession).save(edges.select(G, F.col("source").alias("id"), "target").distinct())

    def step(new: DataFrame) -> DataFrame:
        return new.join(hop, [G, "id"]).select(G, F.col("target").alias("id"), (F.col("depth") + 1).alias("depth"))

    return frontier(starts.select(G, "id").distinct().withColumn("depth", F.lit(0).cast("long")), step, [G, "id"])


def both_ways(graph: Graph) -> DataFrame:
    e = _edges(graph)
    return e.select(G, "source", "target").union(e.select(G, F.col("target").alias("source"), F.col("source").alias("target")))


def reverse(graph: Graph) -> DataFrame:
    return _edges(graph).select(G, F.col("target").alias("source"), F.col("source").alias("target"))


def trace_flow(graph: Graph, id_: str) -> DataFrame:
    """All ids connected with a component, links taken both ways, with the hops to it; ids that dangle are met too."""
    start = graph.components.filter(F.col("id") == id_).select(G, "id")
    if start.isEmpty():
        raise GraphError("COMPONENT_NOT_FOUND", f"Component '{id_}' not found")
    return closure(start, both_ways(graph))


def links_within(graph: Graph, ids: DataFrame) -> DataFrame:
    """Keys of the links among connected ids, links to self left out: in a closure, one end inside means both."""
    inside = graph.links.filter("source <> target").join(ids.select(G, F.col("id").alias("source")), [G, "source"], "left_semi")
    return link_key(inside).select(G, "link_key").distinct()


def node_depths(graph: Graph) -> DataFrame:
    """Least hops from any entry point along links; what none reaches has no depth."""
    return closure(entry_points(graph), _edges(graph))


def search_with_flow(graph: Graph, query: str, *, all_on_empty: bool = False) -> DataFrame:
    """Ids connected with any match. A blank query gives all or nothing; another is searched as it is, blanks included."""
    if query.strip() == "":
        every = graph.components.select(G, "id").distinct().withColumn("matched", F.lit(True))
        return every if all_on_empty else every.limit(0)
    hits = search(graph, query).select(G, "id").distinct()
    met = closure(hits, both_ways(graph)).select(G, "id")
    return met.join(hits.withColumn("matched", F.lit(True)), [G, "id"], "left").na.fill(False, ["matched"])


def trace_around(graph: Graph, starts: DataFrame) -> DataFrame:
    """Ancestors of the starts and everything those lead to; starts need not exist."""
    up = closure(starts, reverse(graph))
    return closure(up, _edges(graph)).select(G, "id")


def edges_around(graph: Graph, ids: DataFrame) -> DataFrame:
    return graph.links.join(ids.select(G, F.col("id").alias("source")), [G, "source"], "left_semi").select(G, F.concat("source", F.lit("->"), "target").alias("edge")).distinct()


def search_nodes(graph: Graph, query: str) -> DataFrame:
    """As ``trace_around`` from all matches of the trimmed query; an empty one gives every node."""
    q = query.strip()
    if not q:
        return graph.components.select(G, "id").distinct()
    return trace_around(graph, search(graph, q).select(G, "id"))


def longest_depths(graph: Graph, *, most_walks: int | None = None) -> DataFrame:
    """Hops of the longest walk that leads to a node over distinct nodes; closing a cycle counts as a hop.

    Nodes are peeled layer by layer: one whose sources all lie in earlier layers has its layer as its depth. Nodes in
    or below cycles are left over; their walks are spelt out, with an error past ``most_walks`` if that is given.
    """
    rounds = Rounds(graph.spark)
    ids = graph.components.select(G, "id").distinct()
    edges, edges_at = rounds.save(_edges(graph).select(G, "source", "target").distinct())
    left, left_at = rounds.save(ids.union(edges.select(G, "source")).union(edges.select(G, "target")).distinct())
    layers, depth = [], 0
    while not left.isEmpty():
        layer = left.join(edges.select(G, F.col("target").alias("id")), [G, "id"], "left_anti")
        layer, at = rounds.save(layer.withColumn("depth", F.lit(depth).cast("long")))
        if layer.isEmpty():
            break
        layers.append(at)
        new_edges, new_edges_at = rounds.save(edges.join(layer.select(G, F.col("id").alias("source")), [G, "source"], "left_anti"))
        new_left, new_left_at = rounds.save(left.join(layer, [G, "id"], "left_anti"))
        rounds.drop(edges_at), rounds.drop(left_at)
        edges, edges_at, left, left_at, depth = new_edges, new_edges_at, new_left, new_left_at, depth + 1
    empty = graph.spark.createDataFrame([], f"{G} string, id string, depth bigint")
    done = rounds.load(layers, empty.select(G, "id", "depth")) if layers else empty
    if left.isEmpty():
        return done.join(ids, [G, "id"], "left_semi")
    back = _edges(graph).select(G, F.col("target").alias("at"), "source").distinct()
    known = done.withColumnRenamed("id", "source").withColumnRenamed("depth", "known")
    walks = left.select(G, "id", F.col("id").alias("at"), F.array("id").alias("nodes"))
    best = []
    while not walks.isEmpty():
        walks, _ = rounds.save(walks)
        if most_walks is not None and walks.count() > most_walks:
            raise RuntimeError(f"more than {most_walks} walks through cycles")
        on = walks.join(back, [G, "at"]).join(known, [G, "source"], "left")
        ends = on.filter(F.col("known").isNotNull() | F.array_contains("nodes", F.col("source")))
        found, at = rounds.save(ends.groupBy(G, "id").agg(F.max(F.size("nodes") + F.coalesce("known", F.lit(0))).cast("long").alias("depth")))
        best.append(at)
        walks = on.filter("known IS NULL").filter(~F.array_contains("nodes", F.col("source"))).select(G, "id", F.col("source").alias("at"), F.concat("nodes", F.array("source")).alias("nodes"))
    cyclic = rounds.load(best, found).groupBy(G, "id").agg(F.max("depth").alias("depth"))
    return done.unionByName(cyclic).join(ids, [G, "id"], "left_semi")


def filter_by_type(graph: Graph, visible: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of visible types, and links among them: direct ones as they are, and chains of hidden nodes contracted.

    A contracted link has the type of its last hop, on the path of least ordinals; there is one per pair of ends, which
    may repeat a direct link or end where it began.
    """
    nodes = graph.components.filter(F.col("type").isin(*visible))
    seen = nodes.select(G, "id").distinct()
    hidden = graph.components.filter(~F.col("type").isin(*visible)).select(G, "id").distinct()
    of = lambda ids, side: ids.withColumnRenamed("id", side)
    e = graph.links.select(G, "ord", "source", "target", "type")
    from_seen = e.join(of(seen, "source"), [G, "source"], "left_semi")
    direct = from_seen.join(of(seen, "target"), [G, "target"], "left_semi").withColumn("rewired", F.lit(False))
    start = from_seen.join(of(hidden, "target"), [G, "target"], "left_semi").select(G, F.col("source").alias("entry"), F.col("target").alias("id"), F.array("ord").alias("path"))
    inner = e.join(of(hidden, "source"), [G, "source"], "left_semi")
    hop, _ = Rounds(graph.spark).save(inner.join(of(hidden, "target"), [G, "target"], "left_semi").select(G, F.col("source").alias("id"), "target", "ord"))

    def step(new: DataFrame) -> DataFrame:
        return new.join(hop, [G, "id"]).select(G, "entry", F.col("target").alias("id"), F.concat("path", F.array("ord")).alias("path"))

    met = least_by_key(start, step, [G, "entry", "id"], "path")
    out = inner.join(of(seen, "target"), [G, "target"], "left_semi").select(G, F.col("source").alias("id"), "target", "ord", "type")
    ends = met.join(out, [G, "id"]).select(G, F.col("entry").alias("source"), "target", F.concat("path", F.array("ord")).alias("path"), "type")
    rewired = ends.groupBy(G, "source", "target").agg(F.min_by(F.struct("type"), "path")["type"].alias("type"), F.min("path")[0].alias("ord")).withColumn("rewired", F.lit(True))
    return nodes, direct.unionByName(rewired)


def prune_orphans(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that still have a link, and links both of whose ends stay."""
    touched = links.select(G, F.explode(F.array("source", "target")).alias("id")).distinct()
    kept = nodes.join(touched, [G, "id"], "left_semi")
    ids = kept.select(G, "id").distinct()
    both = links.join(ids.withColumnRenamed("id", "source"), [G, "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), [G, "target"], "left_semi")
    return kept, both


def external_nodes(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Outside systems as nodes, the first url of each, and one edge per link to them."""
    x = graph.external_links.select(G, "ord", "source", F.col("target.name").alias("name"), F.col("target.url").alias("url"), "type")
    nodes = x.groupBy(G, "name").agg(F.min_by("url", F.when(F.col("url").isNotNull(), F.col("ord"))).alias("url")).select(G, F.concat(F.lit("external:"), "name").alias("id"), "name", F.lit("external").alias("domain"), F.lit("External").alias("type"), "url")
    return nodes, x.select(G, "ord", "source", F.concat(F.lit("external:"), "name").alias("target"), "type")
