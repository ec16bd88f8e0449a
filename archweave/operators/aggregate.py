"""Joins and aggregates. Aggregates combine before the shuffle; joins are equi-joins that adaptive execution may
broadcast by measured size or split where a key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archweave.functions import text as T
from archweave.graph import Graph
from archweave.operators.select import TYPE_ORDER
from archweave.schema import COMPONENT_TYPES, ENTRY_POINT_TYPES

G = "graph_id"


def in_order(value: str, order: str = "ord") -> Column:
    """Values as an array in order; ties by value."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"])


def first_seen(value: str, order: str = "ord") -> Column:
    """Distinct values by first appearance."""
    return F.array_distinct(in_order(value, order))


def _type_counts() -> list[Column]:
    return [F.count_if(F.col("type") == t).alias(t.lower()) for t in COMPONENT_TYPES]


def ends(graph: Graph) -> DataFrame:
    """Links with the components at both ends; a link that dangles drops out."""
    n = graph.nodes()
    s = n.select(G, *(F.col(c).alias(x) for c, x in (("id", "source"), ("domain", "source_domain"), ("name", "source_name"), ("type", "source_type"))))
    t = n.select(G, *(F.col(c).alias(x) for c, x in (("id", "target"), ("domain", "target_domain"), ("name", "target_name"), ("type", "target_type"))))
    return graph.links.select(G, "ord", "source", "target", "type").join(s, [G, "source"]).join(t, [G, "target"])


# Anti-joins


def entry_points(graph: Graph) -> DataFrame:
    """Components of an entry type that no link targets, a link to themselves included."""
    targets = graph.links.select(G, F.col("target").alias("id"))
    return graph.components.filter(F.col("type").isin(*ENTRY_POINT_TYPES)).join(targets, [G, "id"], "left_anti")


def orphans(graph: Graph, *, external: bool = False) -> DataFrame:
    """Components without a link; with ``external``, one to the outside counts as a link too."""
    touched = graph.links.select(G, F.explode(F.array("source", "target")).alias("id"))
    if external:
        touched = touched.union(graph.external_links.select(G, "source"))
    return graph.components.join(touched, [G, "id"], "left_anti")


def unused_domains(graph: Graph) -> DataFrame:
    return graph.domains.join(graph.components.select(G, F.col("domain").alias("name")), [G, "name"], "left_anti")


# Counts


def domains(graph: Graph) -> DataFrame:
    """Every declared domain with its components by type; domains that no one declared do not show."""
    counts = graph.components.groupBy(G, F.col("domain").alias("name")).agg(*_type_counts(), F.count("*").alias("total"))
    names = [t.lower() for t in COMPONENT_TYPES] + ["total"]
    return graph.domains.join(counts, [G, "name"], "left").select(G, "ord", "name", "description", "system_type", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def stats(graph: Graph) -> DataFrame:
    """Domains are those of components, entities distinct non-empty names, whatever their domain."""
    op = (F.col("type") == "DomainOp") & (F.col("entity") != "")
    c = graph.components.groupBy(G).agg(F.count("*").alias("components"), F.countDistinct("domain").alias("domains"), F.count_if(F.col("type") == "API").alias("apis"), F.countDistinct(F.when(op, F.col("entity"))).alias("entities"), F.count_if(F.col("type") == "Event").alias("events"))
    return _counted(graph, c, {"links": graph.links})


def _counted(graph: Graph, base: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per graph that appears anywhere, counts of absent tables nought."""
    out = base
    for name, df in tables.items():
        out = out.join(df.groupBy(G).agg(F.count("*").alias(name)), G, "full")
    return out.na.fill(0)


def builder_stats(graph: Graph) -> DataFrame:
    """By type, with links, links to the outside and declared domains."""
    c = graph.components.groupBy(G).agg(F.count("*").alias("components"), *_type_counts())
    return _counted(graph, c, {"links": graph.links, "external_links": graph.external_links, "domains": graph.domains})


def viewer_stats(graph: Graph) -> DataFrame:
    """Domains as declared; every entity name that is there counts, the empty one too."""
    op = F.col("type") == "DomainOp"
    c = graph.components.groupBy(G).agg(F.count("*").alias("nodes"), F.countDistinct(F.when(op, F.col("entity"))).alias("entities"), F.count_if(F.col("type") == "API").alias("apis"), F.count_if(F.col("type") == "Event").alias("events"))
    return _counted(graph, c, {"edges": graph.links, "domains": graph.domains})


def node_breakdown(graph: Graph) -> DataFrame:
    return graph.components.groupBy(G, "domain").agg(*_type_counts())


# Between domains


def cross_domain_links(graph: Graph, domain: str | None = None) -> DataFrame:
    """Distinct (target domain, link type) that leave a domain, a missing type being one; all domains unless named."""
    e = ends(graph).filter("source_domain <> target_domain")
    e = e if domain is None else e.filter(F.col("source_domain") == domain)
    return e.select(G, "source_domain", "target_domain", F.col("type").alias("link_type")).distinct()


def domain_connections(graph: Graph, domain: str | None = None) -> DataFrame:
    """Per domain, other domain and direction: links that end in an API, and in a handler; pairs with neither show too."""
    e = ends(graph).filter("source_domain <> target_domain")
    sides = F.explode(F.array(F.struct(F.col("source_domain").alias("domain"), F.col("target_domain").alias("other"), F.lit("outgoing").alias("direction")), F.struct(F.col("target_domain").alias("domain"), F.col("source_domain").alias("other"), F.lit("incoming").alias("direction"))))
    pairs = e.groupBy(G, "source_domain", "target_domain").agg(F.count_if(F.col("target_type") == "API").alias("api_count"), F.count_if(F.col("target_type") == "EventHandler").alias("event_count"))
    both = pairs.select(G, sides.alias("x"), "api_count", "event_count").select(G, "x.*", "api_count", "event_count")
    return both if domain is None else both.filter(F.col("domain") == domain)


def external_domains(graph: Graph) -> DataFrame:
    """Outside systems by name: the domains that use them, by first use, and how many links do."""
    x = graph.external_links.select(G, "ord", F.col("source").alias("id"), F.col("target.name").alias("name")).join(graph.nodes().select(G, "id", "domain"), [G, "id"])
    # first use per domain comes first, so that what is collected is one row per domain and system
    per = x.groupBy(G, "name", "domain").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
    return per.groupBy(G, "name").agg(in_order("domain").alias("source_domains"), F.sum("n").alias("connection_count"))


def domain_map_edges(graph: Graph, *, details: bool = False) -> DataFrame:
    """Edges between domains with counts and label; ``details`` adds each link behind them as an ordered array."""
    e = ends(graph).filter("source_domain <> target_domain")
    aggs = [F.count_if(F.col("target_type") == "API").alias("api_count"), F.count_if(F.col("target_type") == "EventHandler").alias("event_count")]
    if details:
        e = e.withColumn("detail", F.struct("source_name", "target_name", F.coalesce("type", F.lit("unknown")).alias("type"), "target_type"))
        aggs.append(in_order("detail").alias("connections"))
    out = e.groupBy(G, "source_domain", "target_domain").agg(*aggs)
    return out.withColumn("label", T.edge_label(F.col("api_count"), F.col("event_count")))


def domain_map_nodes(graph: Graph) -> DataFrame:
    """Domains with their components, by first appearance, and outside systems with their connections."""
    inner = graph.components.groupBy(G, F.col("domain").alias("id")).agg(F.count("*").alias("node_count"), F.min("ord").alias("ord")).withColumn("external", F.lit(False))
    outer = external_domains(graph).select(G, F.concat(F.lit("external:"), "name").alias("id"), F.col("connection_count").alias("node_count"), F.lit(None).cast("bigint").alias("ord"), F.lit(True).alias("external"))
    return inner.unionByName(outer)


def domain_map_external_edges(graph: Graph) -> DataFrame:
    x = graph.external_links.select(G, F.col("source").alias("id"), F.col("target.name").alias("name")).join(graph.nodes().select(G, "id", "domain"), [G, "id"])
    n = x.groupBy(G, F.col("domain").alias("source_domain"), F.concat(F.lit("external:"), "name").alias("target")).agg(F.count("*").alias("connection_count"))
    return n.withColumn("label", F.concat(F.col("connection_count").cast("string"), F.lit(" API")))


def connected_domains(graph: Graph, focus: str) -> DataFrame:
    """Domains that share an edge with the focus, outside systems not counted."""
    e = ends(graph).filter("source_domain <> target_domain").filter((F.col("source_domain") == focus) | (F.col("target_domain") == focus))
    return e.select(G, F.when(F.col("source_domain") == focus, F.col("target_domain")).otherwise(F.col("source_domain")).alias("domain")).distinct()


def focus_flags(graph: Graph, focus: str) -> DataFrame:
    """Domain nodes with ``dimmed``: neither the focus nor connected with it."""
    near = connected_domains(graph, focus).select(G, F.col("domain").alias("id"), F.lit(True).alias("near"))
    nodes = domain_map_nodes(graph).filter("NOT external").join(near, [G, "id"], "left")
    return nodes.select(G, "id", (~(F.coalesce("near", F.lit(False)) | (F.col("id") == focus))).alias("dimmed"))


def facets(graph: Graph) -> DataFrame:
    """(facet, value, n) over domains and types, outside systems as a type of their own."""
    by = lambda col: graph.components.groupBy(G, F.lit(col).alias("facet"), F.col(col).alias("value")).agg(F.count("*").alias("n"))
    outside = graph.external_links.groupBy(G).agg(F.countDistinct("target.name").alias("n")).select(G, F.lit("type").alias("facet"), F.lit("External").alias("value"), "n").filter("n > 0")
    return by("domain").union(by("type")).union(outside)


def node_degree(graph: Graph) -> DataFrame:
    """Links into and out of every component."""
    touched = graph.links.select(G, F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select(G, "x.*")
    d = touched.groupBy(G, "id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return graph.components.select(G, "id").distinct().join(d, [G, "id"], "left").na.fill(0)


def dry_run_summary(drafts: DataFrame) -> DataFrame:
    """``domain: type(n), …`` per domain of draft components (domain, type)."""
    n = drafts.groupBy("domain", "type").agg(F.count("*").alias("n"))
    parts = F.array_join(F.array_sort(F.collect_list(F.concat("type", F.lit("("), F.col("n").cast("string"), F.lit(")")))), ", ")
    return n.groupBy("domain").agg(F.concat(F.first("domain"), F.lit(": "), parts).alias("summary"))


def flow_facets(graph: Graph) -> DataFrame:
    """How many flows start at a screen, an API, a custom part."""
    e = entry_points(graph)
    return e.groupBy(G).agg(F.count_if(F.col("type") == "UI").alias("ui"), F.count_if(F.col("type") == "API").alias("api"), F.count_if(F.col("type") == "Custom").alias("jobs"), F.count("*").alias("flows"), F.countDistinct("domain").alias("domains"))


def palette(graph: Graph, size: int = 10) -> DataFrame:
    """A colour number per domain: its place in the sorted list, modulo the palette. One row per domain is sorted."""
    from pyspark.sql.window import Window

    d = graph.components.select(G, "domain").distinct()
    return d.select(G, "domain", ((F.row_number().over(Window.partitionBy(G).orderBy("domain")) - 1) % size).alias("colour"))


def overview(graph: Graph) -> DataFrame:
    """Cards of the declared domains: counts, entity names, entry strings, first repository."""
    from archweave.operators import select

    c = graph.components
    entity = c.filter("type = 'DomainOp' AND entity IS NOT NULL").groupBy(G, F.col("domain").alias("name")).agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    entry = select.entry_strings(graph).groupBy(G, F.col("domain").alias("name")).agg(in_order("entry").alias("entry_points"))
    repo = select.repositories(graph).withColumnRenamed("domain", "name")
    none = F.array().cast("array<string>")
    out = domains(graph).join(entity, [G, "name"], "left").join(entry, [G, "name"], "left").join(repo, [G, "name"], "left")
    return out.withColumn("entities", F.coalesce("entities", none)).withColumn("entry_points", F.coalesce("entry_points", none))


__all__ = [n for n in dir() if not n.startswith("_")] + ["TYPE_ORDER"]
