"""Two versions of a graph, side by side. Bags stay bags: rows that repeat are reported as often."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archweave.graph import Graph, link_key
from archweave.operators.aggregate import G, domain_map_edges

RAW = "map<string,string>"
#: Fields the viewer's comparison looks at, and no others.
VIEWED = ("name", "type", "domain", "module", "description", "source_location", "route", "api_type", "http_method", "path", "entity", "state_changes", "behavior", "signature", "event_name", "event_schema", "subscribed_events")


def diff_components(before: Graph, after: Graph) -> DataFrame:
    """(id, change, changed_fields): added and removed by id; modified where the JSON text of a field other than the id
    differs, a missing field differing from any. Fields come in the order of before, then the new ones of after."""
    a, b = (g.components.select(G, "id", F.col("raw").alias(x)) for g, x in ((before, "old"), (after, "new")))
    gone = a.join(b, [G, "id"], "left_anti").select(G, "id", F.lit("removed").alias("change"), F.lit(None).cast("array<string>").alias("changed_fields"))
    come = b.join(a, [G, "id"], "left_anti").select(G, "id", F.lit("added").alias("change"), F.lit(None).cast("array<string>").alias("changed_fields"))
    both = a.join(b, [G, "id"]).filter("old <> new")
    maps = both.select(G, "id", F.array_union(F.json_object_keys("old"), F.json_object_keys("new")).alias("keys"), F.from_json("old", RAW).alias("o"), F.from_json("new", RAW).alias("n"))
    fields = F.filter("keys", lambda k: (k != "id") & ~F.col("o")[k].eqNullSafe(F.col("n")[k]))
    changed = maps.select(G, "id", F.lit("modified").alias("change"), fields.alias("changed_fields")).filter(F.size("changed_fields") > 0)
    return come.union(gone).union(changed)


def diff_links(before: Graph, after: Graph) -> DataFrame:
    """(link_key, change): links added and removed by their key."""
    a, b = (link_key(g.links).select(G, "link_key") for g in (before, after))
    return b.join(a, [G, "link_key"], "left_anti").withColumn("change", F.lit("added")).union(a.join(b, [G, "link_key"], "left_anti").withColumn("change", F.lit("removed")))


def diff_stats(before: Graph, after: Graph) -> DataFrame:
    c = diff_components(before, after).select(G, F.concat(F.lit("components_"), "change").alias("what"))
    n = c.union(diff_links(before, after).select(G, F.concat(F.lit("links_"), "change").alias("what")))
    kinds = ("components_added", "components_removed", "components_modified", "links_added", "links_removed")
    counted = n.groupBy(G).agg(*(F.count_if(F.col("what") == k).alias(k) for k in kinds))
    every = before.graphs.select(G).union(after.graphs.select(G)).distinct()
    return every.join(counted, G, "left").na.fill(0)


def compare_nodes(before: Graph, after: Graph) -> DataFrame:
    """(id, status, changed_fields, domain, type) over the viewer's fields; domain and type are those of after, if there."""
    last = lambda g, x: g.components.groupBy(G, "id").agg(F.max_by(F.struct(*VIEWED), "ord").alias(x))
    both = last(before, "a").join(last(after, "b"), [G, "id"], "full")
    changed = F.array_compact(F.array(*(F.when(~F.col("a")[f].eqNullSafe(F.col("b")[f]), f) for f in VIEWED)))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(changed) > 0, "modified").otherwise("unchanged")
    shown = F.coalesce("b", "a")
    out = both.select(G, "id", status.alias("status"), changed.alias("changed_fields"), shown["domain"].alias("domain"), shown["type"].alias("type"), shown["name"].alias("name"))
    return out.withColumn("changed_fields", F.when(F.col("status") == "modified", F.col("changed_fields")).otherwise(F.array().cast("array<string>")))


def compare_edges(before: Graph, after: Graph) -> DataFrame:
    """(source, target, status) by pair of ends, the last link of a pair telling; ids do not matter."""
    last = lambda g, x: g.links.groupBy(G, "source", "target").agg(F.max_by(F.struct("type", "payload", "source_location"), "ord").alias(x))
    both = last(before, "a").join(last(after, "b"), [G, "source", "target"], "full")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified").otherwise("unchanged")
    return both.select(G, "source", "target", status.alias("status"))


def node_changes_by(before: Graph, after: Graph, column: str) -> DataFrame:
    """Statuses counted by ``domain`` or ``type``."""
    n = compare_nodes(before, after)
    return n.groupBy(G, column).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified", "unchanged")))


def connection_diff(before: Graph, after: Graph) -> DataFrame:
    """Connections between domains: added, removed, or unchanged with the counts of after, even where these changed."""
    keys = [G, "source_domain", "target_domain"]
    a = domain_map_edges(before).select(*keys, F.struct("api_count", "event_count").alias("a"))
    b = domain_map_edges(after).select(*keys, F.struct("api_count", "event_count").alias("b"))
    both = a.join(b, keys, "full")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("unchanged")
    shown = F.coalesce("b", "a")
    return both.select(*keys, status.alias("status"), shown["api_count"].alias("api_count"), shown["event_count"].alias("event_count"))


def change_items(before: Graph, after: Graph) -> DataFrame:
    """What the list of changes shows: added, removed, modified, in this order."""
    n = compare_nodes(before, after).filter("status <> 'unchanged'")
    place = F.when(F.col("status") == "added", 0).when(F.col("status") == "removed", 1).otherwise(2)
    return n.select(G, place.alias("place"), F.col("status").alias("change"), "id", "name", "domain", "type")
