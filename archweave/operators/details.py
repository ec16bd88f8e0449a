"""Everything one domain's page shows, as named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archweave.graph import Graph
from archweave.operators import aggregate as A
from archweave.operators import entities, events, select
from archweave.operators.aggregate import G


def domain_details(graph: Graph, domain: str) -> dict[str, DataFrame] | None:
    """Tables by part, or None for a domain that no one declared: breakdown, nodes by type, entities, events by name,
    links to other domains with a missing type called ``unknown``, connections, entry strings, repository."""
    declared = graph.domains.filter(F.col("name") == domain)
    if declared.isEmpty():
        return None
    here = F.col("domain") == domain
    links = A.cross_domain_links(graph, domain).withColumn("link_type", F.coalesce("link_type", F.lit("unknown")))
    return {
        "domain": declared,
        "breakdown": A.node_breakdown(graph).filter(here),
        "nodes": select.domain_nodes(graph).filter(here),
        "entities": entities.entities(graph, domain),
        "events": events.domain_events(graph).filter(here),
        "links": links.distinct(),
        "connections": A.domain_connections(graph, domain),
        "entry_points": select.entry_strings(graph).filter(here),
        "repository": select.repositories(graph).filter(here),
    }


def domain_links_known(graph: Graph) -> DataFrame:
    """Links between domains of all domains, as the pages show them."""
    return A.cross_domain_links(graph).select(G, "source_domain", "target_domain", F.coalesce("link_type", F.lit("unknown")).alias("link_type")).distinct()
