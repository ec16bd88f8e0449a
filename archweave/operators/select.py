"""Lookups, filters and projections. All are narrow: filters reach the scan and only named columns are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archweave.functions import text as T
from archweave.graph import Graph, GraphError

Predicate = Column | str


def _where(df: DataFrame, predicate: Predicate) -> DataFrame:
    return df.filter(F.expr(predicate) if isinstance(predicate, str) else predicate)


def find(graph: Graph, predicate: Predicate) -> DataFrame:
    """Per graph the first component in document order that satisfies a Column or SQL text."""
    hit = _where(graph.components, predicate)
    return hit.groupBy("graph_id").agg(F.min_by(F.struct(*hit.columns), "ord").alias("c")).select("c.*")


def find_all(graph: Graph, predicate: Predicate) -> DataFrame:
    return _where(graph.components, predicate)


def component_by_id(graph: Graph, id_: str) -> DataFrame:
    return find(graph, F.col("id") == id_)


def search(graph: Graph, query: str) -> DataFrame:
    """Name, domain or type contains the query, ignoring case; an empty query finds nothing."""
    if query == "":
        return graph.components.limit(0)
    q = F.lit(query.lower())
    return graph.components.filter(F.contains(F.lower("name"), q) | F.contains(F.lower("domain"), q) | F.contains(F.lower("type"), q))


def components_in_domain(graph: Graph, domain: str) -> DataFrame:
    return graph.components.filter(F.col("domain") == domain)


def components_by_type(graph: Graph, type_: str) -> DataFrame:
    return graph.components.filter(F.col("type") == type_)


def list_components(graph: Graph, domain: str | None = None, type_: str | None = None) -> DataFrame:
    """id, type, name, domain; the type in any case but a known one, the domain exact, an empty domain a filter too."""
    out = graph.components
    if type_ is not None:
        from archweave.schema import COMPONENT_TYPES

        known = {t.lower(): t for t in COMPONENT_TYPES}
        if type_.lower() not in known:
            raise GraphError("INVALID_COMPONENT_TYPE", f"Unknown component type: {type_}", list(COMPONENT_TYPES))
        out = out.filter(F.col("type") == known[type_.lower()])
    if domain is not None:
        out = out.filter(F.col("domain") == domain)
    return out.select("graph_id", "ord", "id", "type", "name", "domain")


def checklist(graph: Graph, type_: str | None = None) -> DataFrame:
    """As ``list_components`` for one type, which has to be known in any case but matches exactly: ``api`` finds nothing."""
    if type_ is not None:
        list_components(graph, type_=type_)
    out = graph.components if type_ is None else graph.components.filter(F.col("type") == type_)
    return out.select("graph_id", "ord", "id", "type", "name", "domain")


def operations_for(graph: Graph, entity: str) -> DataFrame:
    return graph.components.filter((F.col("type") == "DomainOp") & (F.col("entity") == entity))


def apis_at(graph: Graph, path: str, method: str | None = None) -> DataFrame:
    """APIs with a path and a method, at that path."""
    apis = graph.components.filter((F.col("type") == "API") & F.col("path").isNotNull() & F.col("http_method").isNotNull())
    hit = apis.filter(F.col("path") == path)
    return hit if method is None else hit.filter(F.col("http_method") == method.upper())


def api_at(graph: Graph, path: str, method: str | None = None) -> DataFrame:
    """The one API at a path; none or several is an error that names what there is."""
    hit = apis_at(graph, path, method)
    if (n := hit.limit(2).count()) == 1:
        return hit
    if n:
        raise GraphError("AMBIGUOUS_API_MATCH", f"Several APIs at {path}", [r["id"] for r in hit.select("id").limit(20).collect()])
    paths = graph.components.filter("type = 'API' AND path IS NOT NULL AND http_method IS NOT NULL").select("path").distinct().limit(20).collect()
    raise GraphError("COMPONENT_NOT_FOUND", f"No API at {path}", sorted(r["path"] for r in paths))


def _any_of(column: str, chosen: list[str] | None) -> Column:
    return F.col(column).isin(*chosen) if chosen else F.lit(True)


def filter_flows(flows: DataFrame, name: str = "", kind: str = "all", domains: list[str] | None = None) -> DataFrame:
    """Flows (entry_name, entry_type, entry_domain) by name part, kind (all, ui, api, jobs) and domains (none: all)."""
    types = {"ui": "UI", "api": "API", "jobs": "Custom"}
    by_kind = F.lit(True) if kind == "all" else F.col("entry_type") == types[kind]
    return flows.filter(F.contains(F.lower("entry_name"), F.lit(name.lower())) & by_kind & _any_of("entry_domain", domains))


def filter_events(events: DataFrame, name: str = "", domains: list[str] | None = None) -> DataFrame:
    return events.filter(F.contains(F.lower("event_name"), F.lit(name.lower())) & _any_of("domain", domains))


def filter_entities(entities: DataFrame, query: str = "", domain: str = "all") -> DataFrame:
    q = F.lit(query.lower())
    return entities.filter((F.contains(F.lower("name"), q) | F.contains(F.lower("domain"), q)) & (F.lit(True) if domain == "all" else F.col("domain") == domain))


def filter_domains(domains: DataFrame, query: str = "", system_type: str = "all") -> DataFrame:
    q = F.lit(query.lower())
    return domains.filter((F.contains(F.lower("name"), q) | F.contains(F.lower("description"), q)) & (F.lit(True) if system_type == "all" else F.col("system_type") == system_type))


def filter_changes(changes: DataFrame, change: str | None = None, domain: str | None = None, type_: str | None = None) -> DataFrame:
    for column, value in (("change", change), ("domain", domain), ("type", type_)):
        if value is not None:
            changes = changes.filter(F.col(column) == value)
    return changes


def step_nodes(components: DataFrame) -> DataFrame:
    """What a flow step shows; subscriptions for handlers only."""
    return components.select("graph_id", "id", "type", "name", "domain", "module", F.when(F.col("type") == "EventHandler", F.col("subscribed_events")).alias("subscribed_events"), "http_method", "path")


TYPE_ORDER = {"UI": 1, "API": 2, "UseCase": 3, "DomainOp": 4, "Event": 5, "EventHandler": 6, "Custom": 7}


def domain_nodes(graph: Graph) -> DataFrame:
    """Nodes of each domain with file:line, and their rank by type and document order."""
    place = F.create_map(*(F.lit(x) for kv in TYPE_ORDER.items() for x in kv))[F.col("type")]
    loc = F.col("source_location")
    return graph.components.select("graph_id", "domain", place.alias("type_rank"), "ord", "id", "type", "name", T.location_text(loc["file_path"], loc["line_number"]).alias("location"))


def entry_strings(graph: Graph) -> DataFrame:
    """Routes of UIs and paths of APIs by domain; links do not matter here."""
    shown = F.when(F.col("type") == "UI", F.col("route")).when(F.col("type") == "API", F.col("path"))
    return graph.components.select("graph_id", "domain", "ord", shown.alias("entry")).filter("entry IS NOT NULL")


def repositories(graph: Graph) -> DataFrame:
    """The first repository of each domain in document order that is not empty."""
    repo = F.col("source_location")["repository"]
    return graph.components.filter(repo != "").groupBy("graph_id", "domain").agg(F.min_by(repo, "ord").alias("repository"))
