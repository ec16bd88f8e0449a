"""Events, who publishes and who handles them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archweave.graph import Graph
from archweave.operators.aggregate import G, in_order


def _events(graph: Graph) -> DataFrame:
    return graph.components.filter("type = 'Event'")


def _handlers(graph: Graph) -> DataFrame:
    return graph.components.filter("type = 'EventHandler'")


def subscriptions(graph: Graph, domain: str | None = None) -> DataFrame:
    """Events with each handler that subscribes to their event name, one row per pair; events without one stay."""
    e = _events(graph).select(G, F.col("ord").alias("event_ord"), F.col("id").alias("event_id"), "event_name", "domain")
    if domain:
        e = e.filter(F.col("domain") == domain)
    # subscribing twice is subscribing once
    h = _handlers(graph).select(G, F.explode(F.array_distinct("subscribed_events")).alias("event_name"), F.col("ord").alias("handler_ord"), F.col("id").alias("handler_id"), F.col("name").alias("handler_name"), F.col("domain").alias("handler_domain"))
    return e.join(h, [G, "event_name"], "left")


def published_events(graph: Graph, domain: str | None = None) -> DataFrame:
    """Per event its handlers in document order; an empty ``domain`` is no filter."""
    s = subscriptions(graph, domain).withColumn("h", F.when(F.col("handler_id").isNotNull(), F.struct("handler_id", "handler_name", "handler_domain")))
    out = s.groupBy(G, "event_ord", "event_id", "event_name", "domain").agg(in_order("h", "handler_ord").alias("handlers"))
    return out.withColumn("handlers", F.filter("handlers", lambda h: h.isNotNull()))


def handler_sources(graph: Graph, event: str | None = None) -> DataFrame:
    """Per handler and subscription the domain the event comes from; of events of one name the last one tells.

    ``event`` keeps handlers that subscribe to it, with all their subscriptions; an empty one is no filter.
    """
    h = _handlers(graph)
    if event:
        h = h.filter(F.array_contains("subscribed_events", event))
    known = _events(graph).groupBy(G, "event_name").agg(F.max_by("domain", "ord").alias("source_domain"))
    rows = h.select(G, "ord", "id", "name", "domain", F.posexplode("subscribed_events").alias("place", "event_name"))
    return rows.join(known, [G, "event_name"], "left").withColumn("source_known", F.col("source_domain").isNotNull())


def event_handlers(graph: Graph, event: str | None = None) -> DataFrame:
    s = handler_sources(graph, event).withColumn("s", F.struct("event_name", "source_domain", "source_known"))
    return s.groupBy(G, "ord", "id", "name", "domain").agg(in_order("s", "place").alias("subscriptions"))


def fuzzy_subscribers(graph: Graph) -> DataFrame:
    """Handlers per event where a subscription equals the event's name or is part of its id.

    Equality is an equi-join. For the containment every distinct substring of an event id, of a length that some
    subscription has, is joined for equality, so no event meets every handler.
    """
    e = _events(graph).select(G, F.col("id").alias("event_id"), F.col("name").alias("event_name"))
    h = _handlers(graph).select(G, F.explode(F.array_distinct("subscribed_events")).alias("part"), F.col("id").alias("handler_id"))
    lengths = h.groupBy(G).agg(F.collect_set(F.length("part")).alias("lengths"))
    cuts = F.array_distinct(F.flatten(F.transform("lengths", lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("event_id") - n + 1, F.lit(1))), lambda i: F.substring("event_id", i, n)))))
    parts = e.join(lengths, G).select(G, "event_id", "event_name", F.explode(F.array_union(cuts, F.array("event_name"))).alias("part"))
    return parts.join(h, [G, "part"]).select(G, "event_id", "event_name", "handler_id").distinct()


def domain_events(graph: Graph) -> DataFrame:
    """Events a domain publishes or consumes, by name."""
    out = _events(graph).select(G, "domain", "event_name", F.lit("published").alias("role"))
    took = _handlers(graph).select(G, "domain", F.explode("subscribed_events").alias("event_name"), F.lit("consumed").alias("role"))
    return out.union(took).distinct()
