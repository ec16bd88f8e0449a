"""The registered queries over the star-schema graph, and the DuckDB SQL that says what each has to return.

Every query runs over the whole projection. The SQL is written from the model, not from the operators: it builds the
same graph from the driver's tables (``PREFIX``) and states the result plainly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archweave.functions import text as T
from archweave.graph import Graph
from archweave.operators import aggregate as A
from archweave.operators import build, compare, entities, events, select, traverse, validate
from archweave.operators import declarations as D
from archweave.sources import star

K = star.KIND

PREFIX = f"""
WITH RECURSIVE C AS MATERIALIZED (
  SELECT CAST(c_custkey AS BIGINT) AS ord, 'ui:' || c_custkey AS id, 'UI' AS type, c_name AS name, n_name AS domain, c_mktsegment AS module, '/customers/' || c_custkey AS route, CAST(NULL AS VARCHAR) AS http_method, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS entity, CAST(NULL AS VARCHAR) AS operation_name, CAST(NULL AS VARCHAR) AS custom_type, CAST(NULL AS VARCHAR) AS event_name, 'customer/' || c_custkey AS file FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT {K} + o_orderkey, 'api:' || o_orderkey, 'API', 'Order ' || o_orderkey, n_name, o_orderpriority, NULL, CASE WHEN o_orderstatus = 'O' THEN 'POST' ELSE 'GET' END, '/orders/' || o_orderstatus, NULL, NULL, NULL, NULL, 'orders/' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT {2 * K} + p_partkey, 'op:' || p_partkey, 'DomainOp', p_name, p_type, p_brand, NULL, NULL, NULL, p_brand, p_name, NULL, NULL, 'part/' || p_partkey FROM part
  UNION ALL SELECT {3 * K} + user_id, 'usr:' || user_id, 'DomainOp', 'user ' || user_id, 'users', 'events', NULL, NULL, NULL, 'U' || (user_id % 50), 'act ' || user_id, NULL, NULL, 'events/' || user_id FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT {4 * K} + ascii(event_type) * 256 + ascii(substr(event_type, 2, 1)), 'ev:' || event_type, 'Event', event_type, 'events', 'stream', NULL, NULL, NULL, NULL, NULL, NULL, event_type, 'events/' || event_type FROM (SELECT DISTINCT event_type FROM events)
  UNION ALL SELECT {5 * K} + s_suppkey, 'eh:' || s_suppkey, 'EventHandler', s_name, n_name, 'suppliers', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'supplier/' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT {6 * K} + r_regionkey, 'cu:' || r_regionkey, 'Custom', r_name, 'regions', 'regions', NULL, NULL, NULL, NULL, NULL, CASE WHEN r_regionkey % 2 = 0 THEN 'Area' ELSE 'Zone' END, NULL, 'region/' || r_regionkey FROM region
), L AS MATERIALIZED (
  SELECT {K} + o_custkey * 1000000000 + o_orderkey AS ord, 'ui:' || o_custkey AS source, 'api:' || o_orderkey AS target, 'sync' AS type FROM orders
  UNION ALL SELECT {2 * K} + l_orderkey * 1000000000 + l_partkey, 'api:' || l_orderkey, 'op:' || l_partkey, CASE WHEN l_partkey % 7 <> 0 THEN 'sync' END FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
  UNION ALL SELECT {3 * K} + l_partkey * 1000000000 + l_suppkey, 'op:' || l_partkey, 'eh:' || l_suppkey, 'async' FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
  UNION ALL SELECT {4 * K} + CAST(r_regionkey AS BIGINT) * 1000000000 + s_suppkey, 'cu:' || r_regionkey, 'eh:' || s_suppkey, 'async' FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT {5 * K} + o_orderkey * 1000000000 + o_orderkey + 500000000, 'api:' || o_orderkey, 'op:' || (o_orderkey + 500000000), 'sync' FROM orders WHERE o_orderstatus = 'P'
), X AS (
  SELECT CAST(p_partkey AS BIGINT) AS ord, 'op:' || p_partkey AS source, p_type AS name, 'https://' || lower(replace(p_type, ' ', '-')) || '.example' AS url FROM part
), DM AS (
  SELECT CAST(n_nationkey AS BIGINT) AS ord, n_name AS name, 'Nation ' || n_nationkey AS description, 'domain' AS system_type FROM nation
  UNION ALL VALUES (1000, 'events', 'Event stream', 'other'), (1001, 'idle', 'Nothing here', 'other')
), S AS (
  SELECT {5 * K} + s_suppkey AS ord, 'eh:' || s_suppkey AS id, s_name AS name, n_name AS domain, CAST(i - 1 AS BIGINT) AS place, e[i] AS event_name
  FROM (SELECT *, CASE s_suppkey % 4 WHEN 0 THEN ['click', 'purchase'] WHEN 1 THEN ['view', 'refund'] WHEN 2 THEN ['signup', 'error', 'signup'] ELSE ['purchase'] END AS e FROM supplier JOIN nation ON s_nationkey = n_nationkey), range(1, len(e) + 1) AS r(i)
), M AS (
  SELECT 'U' || (user_id % 50) AS entity, {3 * K} + user_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '*') AS "from", event_type AS "to", 'act ' || user_id AS triggered_by FROM events
), E AS (
  SELECT L.ord, L.source, L.target, L.type, a.domain AS source_domain, b.domain AS target_domain, a.name AS source_name, b.name AS target_name, b.type AS target_type FROM L JOIN C a ON a.id = L.source JOIN C b ON b.id = L.target
), EP AS (
  SELECT * FROM C WHERE type IN ('UI', 'API', 'EventHandler', 'Custom') AND id NOT IN (SELECT target FROM L)
)"""

#: The graph after the changes of ``star.later``.
AFTER = """, C2 AS MATERIALIZED (
  SELECT ord, id, type, CASE WHEN type = 'UI' AND module = 'FURNITURE' THEN name || ' (moved)' ELSE name END AS name, CASE WHEN type = 'DomainOp' AND module = 'Brand#1' THEN 'moved' ELSE domain END AS domain, module FROM C WHERE NOT (type = 'API' AND path = '/orders/P')
), L2 AS MATERIALIZED (SELECT ord, source, target, CASE WHEN source LIKE 'op:%' THEN 'sync' ELSE type END AS type FROM L WHERE source NOT LIKE 'cu:%'
), E2 AS (SELECT L2.*, a.domain AS source_domain, b.domain AS target_domain, b.type AS target_type FROM L2 JOIN C2 a ON a.id = L2.source JOIN C2 b ON b.id = L2.target)"""

_COUNTS = "count(*) FILTER (target_type = 'API') AS api_count, count(*) FILTER (target_type = 'EventHandler') AS event_count"
_TYPES = ("UI", "API", "UseCase", "DomainOp", "Event", "EventHandler", "Custom")
_BY_TYPE = ", ".join(f"count(*) FILTER (type = '{t}') AS {t.lower()}" for t in _TYPES)

Build = Callable[[Graph], DataFrame]
_REGISTRY: dict[str, tuple[Build, str | None]] = {}


def query(name: str, sql: str | None) -> Callable[[Build], Build]:
    """Register a query on the star graph; ``sql`` follows PREFIX, None where SQL cannot say it."""

    def add(f: Build) -> Build:
        _REGISTRY[name] = (f, sql and PREFIX + sql)
        return f

    return add


def simple(name: str, f: Build, sql: str | None) -> None:
    query(name, sql)(f)


_FOUR = ("id", "type", "name", "domain")
simple("all_components", lambda g: g.components.select(*_FOUR), " SELECT id, type, name, domain FROM C")
simple("all_links", lambda g: g.links.select("source", "target", "type"), " SELECT source, target, type FROM L")
simple("all_external_links", lambda g: g.external_links.select("source", F.col("target.name").alias("name"), F.col("target.url").alias("url")), " SELECT source, name, url FROM X")
simple("entry_points", lambda g: A.entry_points(g).select(*_FOUR), " SELECT id, type, name, domain FROM EP")
simple("orphans", lambda g: A.orphans(g).select(*_FOUR), " SELECT id, type, name, domain FROM C WHERE id NOT IN (SELECT source FROM L UNION SELECT target FROM L)")
simple("orphans_with_external", lambda g: A.orphans(g, external=True).select(*_FOUR), " SELECT id, type, name, domain FROM C WHERE id NOT IN (SELECT source FROM L UNION SELECT target FROM L UNION SELECT source FROM X)")
simple("dangling_links", lambda g: validate.dangling_links(g).select("path", "message", "code"), " SELECT '/links/' || ord || '/source' AS path, 'Link references non-existent source: ' || source AS message, 'INVALID_LINK_SOURCE' AS code FROM L WHERE source NOT IN (SELECT id FROM C) UNION ALL SELECT '/links/' || ord || '/target', 'Link references non-existent target: ' || target, 'INVALID_LINK_TARGET' FROM L WHERE target NOT IN (SELECT id FROM C)")
simple("invalid_custom_types", lambda g: validate.unknown_custom_types(g).select("path", "message", "code"), " SELECT '/components/' || ord || '/customTypeName' AS path, 'Custom type ''' || custom_type || ''' is not defined in metadata.customTypes' AS message, 'INVALID_TYPE' AS code FROM C WHERE custom_type = 'Zone'")
simple("unused_domains", lambda g: A.unused_domains(g).select("name"), " SELECT name FROM DM WHERE name NOT IN (SELECT domain FROM C)")
simple("warnings", lambda g: validate.warnings(g).select("code", "message"), " SELECT 'ORPHAN_COMPONENT' AS code, 'Component ''' || id || ''' has no incoming or outgoing links' AS message FROM C WHERE id NOT IN (SELECT source FROM L UNION SELECT target FROM L UNION SELECT source FROM X) UNION ALL SELECT 'UNUSED_DOMAIN', 'Domain ''' || name || ''' is declared but has no components' FROM DM WHERE name NOT IN (SELECT domain FROM C)")
simple("validation_report", lambda g: validate.report(g).groupBy("level", "code").agg(F.count("*").alias("n")), " SELECT 'error' AS level, 'INVALID_LINK_TARGET' AS code, count(*) AS n FROM L WHERE target NOT IN (SELECT id FROM C) UNION ALL SELECT 'error', 'INVALID_TYPE', count(*) FROM C WHERE custom_type = 'Zone' UNION ALL SELECT 'warning', 'ORPHAN_COMPONENT', count(*) FROM C WHERE id NOT IN (SELECT source FROM L UNION SELECT target FROM L UNION SELECT source FROM X) HAVING count(*) > 0 UNION ALL SELECT 'warning', 'UNUSED_DOMAIN', count(*) FROM DM WHERE name NOT IN (SELECT domain FROM C)")
simple("find_first", lambda g: select.find(g, "type = 'API' AND path = '/orders/O'").select(*_FOUR), " SELECT id, type, name, domain FROM C WHERE type = 'API' AND path = '/orders/O' ORDER BY ord LIMIT 1")
simple("find_all", lambda g: select.find_all(g, F.col("module") == "BUILDING").select(*_FOUR), " SELECT id, type, name, domain FROM C WHERE module = 'BUILDING'")
simple("component_by_id", lambda g: select.component_by_id(g, "op:7").select(*_FOUR), " SELECT id, type, name, domain FROM C WHERE id = 'op:7'")
simple("search_components", lambda g: select.search(g, "ReD").select(*_FOUR), " SELECT id, type, name, domain FROM C WHERE contains(lower(name), 'red') OR contains(lower(domain), 'red') OR contains(lower(type), 'red')")
simple("components_by_domain_type", lambda g: select.list_components(g, "NATION_3", "api").select(*_FOUR), " SELECT id, type, name, domain FROM C WHERE domain = 'NATION_3' AND type = 'API'")
simple("component_checklist", lambda g: select.checklist(g, "DomainOp").select(*_FOUR), " SELECT id, type, name, domain FROM C WHERE type = 'DomainOp'")
simple("operations_for", lambda g: select.operations_for(g, "Brand#2").select("id", "operation_name"), " SELECT id, operation_name FROM C WHERE type = 'DomainOp' AND entity = 'Brand#2'")
simple("api_path_lookup", lambda g: select.apis_at(g, "/orders/F", "get").select("id", "http_method", "path"), " SELECT id, http_method, path FROM C WHERE type = 'API' AND path = '/orders/F' AND http_method = 'GET'")
simple("domain_nodes", lambda g: select.domain_nodes(g).select("domain", F.col("type_rank").cast("long").alias("type_rank"), "id", "location"), " SELECT domain, CAST(CASE type WHEN 'UI' THEN 1 WHEN 'API' THEN 2 WHEN 'DomainOp' THEN 4 WHEN 'Event' THEN 5 WHEN 'EventHandler' THEN 6 ELSE 7 END AS BIGINT) AS type_rank, id, file AS location FROM C")
simple("entry_strings", lambda g: select.entry_strings(g).groupBy("domain", "entry").agg(F.count("*").alias("n")), " SELECT domain, coalesce(route, path) AS entry, count(*) AS n FROM C WHERE coalesce(route, path) IS NOT NULL GROUP BY ALL")
simple("repositories", lambda g: select.repositories(g).select("domain", "repository"), " SELECT DISTINCT domain, 'shop' AS repository FROM C")
simple("domains_counts", lambda g: A.domains(g).drop("graph_id", "ord"), f" SELECT DM.name, description, system_type, {', '.join(f'count(C.id) FILTER (type = {chr(39)}{t}{chr(39)}) AS {t.lower()}' for t in _TYPES)}, count(C.id) AS total FROM DM LEFT JOIN C ON C.domain = DM.name GROUP BY ALL")
simple("graph_stats", lambda g: A.stats(g).drop("graph_id"), " SELECT (SELECT count(*) FROM C) AS components, (SELECT count(DISTINCT domain) FROM C) AS domains, (SELECT count(*) FROM C WHERE type = 'API') AS apis, (SELECT count(DISTINCT entity) FROM C WHERE type = 'DomainOp' AND entity <> '') AS entities, (SELECT count(*) FROM C WHERE type = 'Event') AS events, (SELECT count(*) FROM L) AS links")
simple("builder_stats", lambda g: A.builder_stats(g).drop("graph_id"), f" SELECT count(*) AS components, {_BY_TYPE}, (SELECT count(*) FROM L) AS links, (SELECT count(*) FROM X) AS external_links, (SELECT count(*) FROM DM) AS domains FROM C")
simple("viz_stats", lambda g: A.viewer_stats(g).drop("graph_id"), " SELECT count(*) AS nodes, count(DISTINCT entity) FILTER (type = 'DomainOp') AS entities, count(*) FILTER (type = 'API') AS apis, count(*) FILTER (type = 'Event') AS events, (SELECT count(*) FROM L) AS edges, (SELECT count(*) FROM DM) AS domains FROM C")
simple("node_breakdown", lambda g: A.node_breakdown(g).drop("graph_id"), f" SELECT domain, {_BY_TYPE} FROM C GROUP BY domain")
simple("cross_domain_links", lambda g: A.cross_domain_links(g).drop("graph_id"), " SELECT DISTINCT source_domain, target_domain, type AS link_type FROM E WHERE source_domain <> target_domain")
simple("domain_connections", lambda g: A.domain_connections(g).drop("graph_id"), f", P AS (SELECT source_domain, target_domain, {_COUNTS} FROM E WHERE source_domain <> target_domain GROUP BY ALL) SELECT source_domain AS domain, target_domain AS other, 'outgoing' AS direction, api_count, event_count FROM P UNION ALL SELECT target_domain, source_domain, 'incoming', api_count, event_count FROM P")
simple("external_domains", lambda g: A.external_domains(g).select("name", F.array_join("source_domains", ",").alias("source_domains"), "connection_count"), " SELECT name, string_agg(domain, ',' ORDER BY o) AS source_domains, CAST(sum(n) AS BIGINT) AS connection_count FROM (SELECT X.name, domain, min(X.ord) AS o, count(*) AS n FROM X JOIN C ON C.id = X.source GROUP BY ALL) GROUP BY name")
simple("domain_map_edges", lambda g: A.domain_map_edges(g).drop("graph_id"), f" SELECT *, CASE WHEN api_count > 0 AND event_count > 0 THEN api_count || ' API · ' || event_count || ' Event' WHEN api_count > 0 THEN api_count || ' API' WHEN event_count > 0 THEN event_count || ' Event' END AS label FROM (SELECT source_domain, target_domain, {_COUNTS} FROM E WHERE source_domain <> target_domain GROUP BY ALL)")
simple("domain_map_nodes", lambda g: A.domain_map_nodes(g).select("id", "node_count", "external"), " SELECT domain AS id, count(*) AS node_count, false AS external FROM C GROUP BY domain UNION ALL SELECT 'external:' || X.name, count(*), true FROM X JOIN C ON C.id = X.source GROUP BY X.name")
simple("domain_map_external_edges", lambda g: A.domain_map_external_edges(g).drop("graph_id"), " SELECT domain AS source_domain, 'external:' || X.name AS target, count(*) AS connection_count, count(*) || ' API' AS label FROM X JOIN C ON C.id = X.source GROUP BY ALL")
simple("connected_domains", lambda g: A.connected_domains(g, "NATION_1").select("domain"), " SELECT DISTINCT CASE WHEN source_domain = 'NATION_1' THEN target_domain ELSE source_domain END AS domain FROM E WHERE source_domain <> target_domain AND 'NATION_1' IN (source_domain, target_domain)")
simple("focus_flags", lambda g: A.focus_flags(g, "NATION_1").select("id", "dimmed"), ", N AS (SELECT CASE WHEN source_domain = 'NATION_1' THEN target_domain ELSE source_domain END AS d FROM E WHERE source_domain <> target_domain AND 'NATION_1' IN (source_domain, target_domain)) SELECT DISTINCT domain AS id, domain <> 'NATION_1' AND domain NOT IN (SELECT d FROM N) AS dimmed FROM C")
simple("full_graph_facets", lambda g: A.facets(g).drop("graph_id"), " SELECT 'domain' AS facet, domain AS value, count(*) AS n FROM C GROUP BY ALL UNION ALL SELECT 'type', type, count(*) FROM C GROUP BY ALL UNION ALL SELECT 'type', 'External', count(DISTINCT name) FROM X")
simple("node_degree", lambda g: A.node_degree(g).drop("graph_id"), " SELECT id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM C LEFT JOIN (SELECT target, count(*) AS i FROM L GROUP BY 1) ON target = id LEFT JOIN (SELECT source, count(*) AS o FROM L GROUP BY 1) ON source = id")
simple("dry_run_summary", lambda g: A.dry_run_summary(g.components).select("domain", "summary"), " SELECT domain, domain || ': ' || string_agg(type || '(' || n || ')', ', ' ORDER BY type) AS summary FROM (SELECT domain, type, count(*) AS n FROM C GROUP BY ALL) GROUP BY domain")
simple("flow_facets", lambda g: A.flow_facets(g).drop("graph_id"), " SELECT count(*) FILTER (type = 'UI') AS ui, count(*) FILTER (type = 'API') AS api, count(*) FILTER (type = 'Custom') AS jobs, count(*) AS flows, count(DISTINCT domain) AS domains FROM EP")
simple("palette", lambda g: A.palette(g).select("domain", F.col("colour").cast("long").alias("colour")), " SELECT domain, (row_number() OVER (ORDER BY domain) - 1) % 10 AS colour FROM (SELECT DISTINCT domain FROM C)")
simple("overview", lambda g: A.overview(g).select("name", "total", F.array_join("entities", ",").alias("entities"), F.size("entry_points").cast("long").alias("n_entries"), "repository"), " SELECT DM.name, count(C.id) AS total, coalesce(string_agg(DISTINCT entity, ',' ORDER BY entity) FILTER (type = 'DomainOp'), '') AS entities, count(coalesce(route, path)) AS n_entries, CASE WHEN count(C.id) > 0 THEN 'shop' END AS repository FROM DM LEFT JOIN C ON C.domain = DM.name GROUP BY DM.name")
simple("published_events", lambda g: events.published_events(g).select("event_id", "event_name", F.array_join(F.transform("handlers", lambda h: h["handler_id"]), ",").alias("handlers")), " SELECT C.id AS event_id, C.event_name, coalesce(string_agg(h.id, ',' ORDER BY h.ord), '') AS handlers FROM C LEFT JOIN (SELECT DISTINCT ord, id, event_name FROM S) h ON h.event_name = C.event_name WHERE C.type = 'Event' GROUP BY ALL")
simple("event_handlers_sources", lambda g: events.handler_sources(g).select("id", F.col("place").cast("long").alias("place"), "event_name", "source_domain", "source_known"), " SELECT S.id, S.place, S.event_name, C.domain AS source_domain, C.domain IS NOT NULL AS source_known FROM S LEFT JOIN C ON C.type = 'Event' AND C.event_name = S.event_name")
simple("event_handlers", lambda g: events.event_handlers(g, "view").select("id", F.array_join(F.transform("subscriptions", lambda s: s["event_name"]), ",").alias("subscriptions")), " SELECT id, string_agg(event_name, ',' ORDER BY place) AS subscriptions FROM S WHERE id IN (SELECT id FROM S WHERE event_name = 'view') GROUP BY id")
simple("fuzzy_event_subscribers", lambda g: events.fuzzy_subscribers(g).drop("graph_id"), " SELECT DISTINCT C.id AS event_id, C.name AS event_name, S.id AS handler_id FROM C JOIN S ON C.name = S.event_name OR contains(C.id, S.event_name) WHERE C.type = 'Event'")
simple("domain_events", lambda g: events.domain_events(g).drop("graph_id"), " SELECT DISTINCT domain, event_name, 'published' AS role FROM C WHERE type = 'Event' UNION SELECT domain, event_name, 'consumed' FROM S")
simple("entities", lambda g: entities.entities(g).select("domain", "name", F.array_join("operation_ids", ",").alias("operation_ids"), F.size("transitions").cast("long").alias("n_transitions"), "has_states", "has_business_rules", "first_operation_id").na.fill(-1), " SELECT domain, entity AS name, string_agg(id, ',' ORDER BY operation_name, ord) AS operation_ids, coalesce((SELECT count(*) FROM M WHERE M.entity = C.entity), 0) + CASE WHEN entity LIKE 'Brand%' THEN -1 ELSE 0 END AS n_transitions, entity LIKE 'U%' AS has_states, entity LIKE 'Brand%' AS has_business_rules, first(id ORDER BY operation_name, ord) AS first_operation_id FROM C WHERE type = 'DomainOp' GROUP BY ALL")
simple("entity_operations", lambda g: entities.operations(g).groupBy("domain", "entity").agg(F.count("*").alias("operations")), " SELECT domain, entity, count(*) AS operations FROM C WHERE type = 'DomainOp' GROUP BY ALL")
simple("business_rules", lambda g: entities.business_rules(g).select("entity", "rule"), " SELECT DISTINCT p_brand AS entity, unnest(['size ' || CAST(floor(p_size / 10) AS BIGINT), 'type ' || p_type]) AS rule FROM part")
simple("state_transitions", lambda g: entities.transitions(g).select("entity", "from", "to", "triggered_by", F.col("p").cast("long").alias("p")), ' SELECT entity, "from", "to", triggered_by, p FROM M')
simple(
    "state_order",
    lambda g: entities.state_order(g).select("entity", "state", "place"),
    """, V AS (SELECT entity, state, min((ord, p, s)) AS seen FROM (SELECT entity, ord, p, 0 AS s, "from" AS state FROM M UNION ALL SELECT entity, ord, p, 1, "to" FROM M) WHERE state <> '*' GROUP BY ALL),
    N AS (SELECT entity, "from" AS state, arg_max("to", (ord, p)) AS nxt, min((ord, p)) AS seen FROM M WHERE "from" <> '*' GROUP BY ALL),
    R AS (SELECT entity, state, row_number() OVER (PARTITION BY entity ORDER BY seen) AS root FROM N WHERE (entity, state) NOT IN (SELECT entity, "to" FROM M)),
    K AS (SELECT entity, state, root, CAST(0 AS BIGINT) AS d FROM R UNION SELECT K.entity, N.nxt, K.root, K.d + 1 FROM K JOIN N ON N.entity = K.entity AND N.state = K.state WHERE K.d < 50),
    B AS (SELECT entity, state, min((root, d)) AS at FROM K GROUP BY ALL)
    SELECT V.entity, V.state, row_number() OVER (PARTITION BY V.entity ORDER BY B.at IS NULL, B.at, V.seen) AS place FROM V LEFT JOIN B ON B.entity = V.entity AND B.state = V.state""",
)
simple("total_operations", lambda g: entities.total_operations(g).select("operations"), " SELECT count(*) AS operations FROM C WHERE type = 'DomainOp'")

_BOTH = "B AS (SELECT DISTINCT source AS a, target AS b FROM L UNION SELECT target, source FROM L)"
simple("trace_flow", lambda g: traverse.trace_flow(g, "ui:1").select("id"), f", {_BOTH}, R AS (SELECT 'ui:1' AS id UNION SELECT B.b FROM R JOIN B ON B.a = R.id) SELECT id FROM R")
simple("trace_flow_links", lambda g: traverse.links_within(g, traverse.trace_flow(g, "ui:1")).select("link_key"), f", {_BOTH}, R AS (SELECT 'ui:1' AS id UNION SELECT B.b FROM R JOIN B ON B.a = R.id) SELECT DISTINCT source || '->' || target AS link_key FROM L WHERE source <> target AND source IN (SELECT id FROM R)")
simple("search_with_flow", lambda g: traverse.search_with_flow(g, "Customer#00000000").select("id", "matched"), f", {_BOTH}, H AS (SELECT id FROM C WHERE contains(lower(name), 'customer#00000000')), R AS (SELECT id FROM H UNION SELECT B.b FROM R JOIN B ON B.a = R.id) SELECT id, id IN (SELECT id FROM H) AS matched FROM R")
simple("node_depths", lambda g: traverse.node_depths(g).select("id", "depth"), ", R AS (SELECT id, CAST(0 AS BIGINT) AS d FROM EP UNION SELECT L.target, R.d + 1 FROM R JOIN L ON L.source = R.id WHERE R.d < 20) SELECT id, min(d) AS depth FROM R GROUP BY id")
simple("longest_depths", lambda g: traverse.longest_depths(g).select("id", "depth"), ", R AS (SELECT id, CAST(0 AS BIGINT) AS d FROM C UNION SELECT L.target, R.d + 1 FROM R JOIN L ON L.source = R.id WHERE R.d < 20) SELECT id, max(d) AS depth FROM R WHERE id IN (SELECT id FROM C) GROUP BY id")
simple("viz_trace", lambda g: traverse.trace_around(g, select.component_by_id(g, "op:7").select("graph_id", "id")).select("id"), ", U AS (SELECT 'op:7' AS id UNION SELECT L.source FROM U JOIN L ON L.target = U.id), R AS (SELECT id FROM U UNION SELECT L.target FROM R JOIN L ON L.source = R.id) SELECT id FROM R")
simple("viz_search", lambda g: traverse.search_nodes(g, "  AFRICA ").select("id"), ", U AS (SELECT id FROM C WHERE contains(lower(name), 'africa') OR contains(lower(domain), 'africa') UNION SELECT L.source FROM U JOIN L ON L.target = U.id), R AS (SELECT id FROM U UNION SELECT L.target FROM R JOIN L ON L.source = R.id) SELECT id FROM R")
_FLOW = ", F AS (SELECT id AS entry, id, CAST([] AS BIGINT[]) AS path, [id] AS nodes FROM EP UNION ALL SELECT F.entry, L.target, list_append(F.path, L.ord), list_append(F.nodes, L.target) FROM F JOIN L ON L.source = F.id JOIN C ON C.id = L.target WHERE NOT list_contains(F.nodes, L.target)), BEST AS (SELECT entry, id, min(path) AS path FROM F GROUP BY ALL)"
simple("flows_steps", lambda g: traverse.flows(g).select("entry", "id", "depth", "step", "link_type"), _FLOW + ", FT AS (SELECT source, arg_min_null(type, ord) AS link_type FROM L GROUP BY source) SELECT entry, id, CAST(len(path) AS BIGINT) AS depth, row_number() OVER (PARTITION BY entry ORDER BY path) AS step, link_type FROM BEST LEFT JOIN FT ON FT.source = BEST.id")
simple("flow_external_links", lambda g: traverse.flow_external_links(g).groupBy("external_name").agg(F.count("*").alias("n"), F.countDistinct("entry").alias("flows")), _FLOW + " SELECT X.name AS external_name, count(*) AS n, count(DISTINCT entry) AS flows FROM BEST JOIN X ON X.source = BEST.id GROUP BY X.name")
_REWIRE = ", V AS (SELECT id FROM C WHERE type IN ('UI', 'DomainOp', 'Custom')), H AS (SELECT id FROM C WHERE type NOT IN ('UI', 'DomainOp', 'Custom')), W AS (SELECT L.source AS entry, L.target AS id, [L.ord] AS path, [L.target] AS nodes FROM L JOIN V ON V.id = L.source JOIN H ON H.id = L.target UNION ALL SELECT W.entry, L.target, list_append(W.path, L.ord), list_append(W.nodes, L.target) FROM W JOIN L ON L.source = W.id JOIN H ON H.id = L.target WHERE NOT list_contains(W.nodes, L.target)), Z AS (SELECT entry AS source, L.target, arg_min_null(L.type, list_append(path, L.ord)) AS type FROM W JOIN L ON L.source = W.id JOIN V ON V.id = L.target GROUP BY ALL), ALLE AS (SELECT L.source, L.target, L.type, false AS rewired FROM L JOIN V a ON a.id = L.source JOIN V b ON b.id = L.target UNION ALL SELECT source, target, type, true FROM Z)"
simple("type_filter_rewire", lambda g: traverse.filter_by_type(g, ["UI", "DomainOp", "Custom"])[1].select("source", "target", "type", "rewired"), _REWIRE + " SELECT source, target, type, rewired FROM ALLE")
simple("type_filter_pruned", lambda g: traverse.prune_orphans(*traverse.filter_by_type(g, ["UI", "DomainOp", "Custom"]))[0].select("id", "type"), _REWIRE + " SELECT id, type FROM C WHERE type IN ('UI', 'DomainOp', 'Custom') AND id IN (SELECT source FROM ALLE UNION SELECT target FROM ALLE)")
simple("external_nodes", lambda g: traverse.external_nodes(g)[0].drop("graph_id"), " SELECT 'external:' || name AS id, name, 'external' AS domain, 'External' AS type, first(url ORDER BY ord) AS url FROM X GROUP BY name")

simple("diff_components", lambda g: compare.diff_components(g, star.later(g)).select("id", "change", F.array_join("changed_fields", ",").alias("changed_fields")), AFTER + " SELECT C.id, CASE WHEN C2.id IS NULL THEN 'removed' ELSE 'modified' END AS change, CASE WHEN C2.id IS NOT NULL THEN CASE WHEN C.name <> C2.name THEN 'name' ELSE 'domain' END END AS changed_fields FROM C LEFT JOIN C2 ON C2.id = C.id WHERE C2.id IS NULL OR C.name <> C2.name OR C.domain <> C2.domain")
simple("diff_links", lambda g: compare.diff_links(g, star.later(g)).select("link_key", "change"), " SELECT source || '->' || target AS link_key, 'removed' AS change FROM L WHERE source LIKE 'cu:%'")
simple("diff_stats", lambda g: compare.diff_stats(g, star.later(g)).drop("graph_id"), AFTER + " SELECT CAST(0 AS BIGINT) AS components_added, (SELECT count(*) FROM C WHERE id NOT IN (SELECT id FROM C2)) AS components_removed, (SELECT count(*) FROM C JOIN C2 ON C.id = C2.id WHERE C.name <> C2.name OR C.domain <> C2.domain) AS components_modified, CAST(0 AS BIGINT) AS links_added, (SELECT count(*) FROM L WHERE source LIKE 'cu:%') AS links_removed")
simple("compare_nodes", lambda g: compare.compare_nodes(g, star.later(g)).select("id", "status", F.array_join("changed_fields", ",").alias("changed_fields"), "domain", "type"), AFTER + " SELECT C.id, CASE WHEN C2.id IS NULL THEN 'removed' WHEN C.name <> C2.name OR C.domain <> C2.domain THEN 'modified' ELSE 'unchanged' END AS status, CASE WHEN C.name <> C2.name THEN 'name' WHEN C.domain <> C2.domain THEN 'domain' ELSE '' END AS changed_fields, coalesce(C2.domain, C.domain) AS domain, C.type FROM C LEFT JOIN C2 ON C2.id = C.id")
simple("compare_edges", lambda g: compare.compare_edges(g, star.later(g)).select("source", "target", "status"), AFTER + " SELECT L.source, L.target, CASE WHEN L2.ord IS NULL THEN 'removed' WHEN L.type IS DISTINCT FROM L2.type THEN 'modified' ELSE 'unchanged' END AS status FROM L LEFT JOIN L2 ON L2.source = L.source AND L2.target = L.target")
simple("compare_by_type", lambda g: compare.node_changes_by(g, star.later(g), "type").drop("graph_id"), AFTER + " SELECT C.type, CAST(0 AS BIGINT) AS added, count(*) FILTER (C2.id IS NULL) AS removed, count(*) FILTER (C.name <> C2.name OR C.domain <> C2.domain) AS modified, count(*) FILTER (C.name = C2.name AND C.domain = C2.domain) AS unchanged FROM C LEFT JOIN C2 ON C2.id = C.id GROUP BY C.type")
simple("connection_diff", lambda g: compare.connection_diff(g, star.later(g)).drop("graph_id"), AFTER + f", PA AS (SELECT source_domain, target_domain, {_COUNTS} FROM E WHERE source_domain <> target_domain GROUP BY ALL), PB AS (SELECT source_domain, target_domain, {_COUNTS} FROM E2 WHERE source_domain <> target_domain GROUP BY ALL) SELECT coalesce(PB.source_domain, PA.source_domain) AS source_domain, coalesce(PB.target_domain, PA.target_domain) AS target_domain, CASE WHEN PA.source_domain IS NULL THEN 'added' WHEN PB.source_domain IS NULL THEN 'removed' ELSE 'unchanged' END AS status, coalesce(PB.api_count, PA.api_count) AS api_count, coalesce(PB.event_count, PA.event_count) AS event_count FROM PA FULL JOIN PB ON PA.source_domain = PB.source_domain AND PA.target_domain = PB.target_domain")
simple("change_items", lambda g: select.filter_changes(compare.change_items(g, star.later(g)), change="modified", type_="UI").select("id", "name", "domain"), AFTER + " SELECT C2.id, C2.name, C2.domain FROM C2 JOIN C ON C.id = C2.id WHERE C2.type = 'UI' AND C2.name <> C.name")

simple("components_in_domain", lambda g: select.components_in_domain(g, "NATION_3").select(*_FOUR), " SELECT id, type, name, domain FROM C WHERE domain = 'NATION_3'")
simple("components_by_type", lambda g: select.components_by_type(g, "EventHandler").select(*_FOUR), " SELECT id, type, name, domain FROM C WHERE type = 'EventHandler'")
simple("entity_filter", lambda g: select.filter_entities(entities.entities(g), "brand#1", "all").select("domain", "name"), " SELECT DISTINCT domain, entity AS name FROM C WHERE type = 'DomainOp' AND (contains(lower(entity), 'brand#1') OR contains(lower(domain), 'brand#1'))")
simple("domain_filter", lambda g: select.filter_domains(g.domains, "NATION", "domain").select("name", "description"), " SELECT name, description FROM DM WHERE (contains(lower(name), 'nation') OR contains(lower(description), 'nation')) AND system_type = 'domain'")
simple("event_filter", lambda g: select.filter_events(events.published_events(g), "c", ["events"]).select("event_id", "event_name"), " SELECT id AS event_id, event_name FROM C WHERE type = 'Event' AND contains(lower(event_name), 'c') AND domain = 'events'")
simple("flow_filter", lambda g: select.filter_flows(A.entry_points(g).select(F.col("id").alias("entry"), F.col("name").alias("entry_name"), F.col("type").alias("entry_type"), F.col("domain").alias("entry_domain")), "customer", "ui", ["NATION_3", "NATION_4"]).select("entry", "entry_name"), " SELECT id AS entry, name AS entry_name FROM EP WHERE type = 'UI' AND contains(lower(name), 'customer') AND domain IN ('NATION_3', 'NATION_4')")
simple("step_nodes", lambda g: select.step_nodes(g.components).select("id", F.array_join("subscribed_events", ",").alias("subscribed_events"), "http_method", "path"), " SELECT C.id, string_agg(S.event_name, ',' ORDER BY S.place) AS subscribed_events, C.http_method, C.path FROM C LEFT JOIN S ON S.id = C.id GROUP BY C.id, C.http_method, C.path")
simple("canonical_types", lambda g: g.components.select("id", T.canonical_type(F.upper("type")).alias("canonical"), T.valid_http_method(F.lower("http_method")).alias("valid_method"), T.edge_kind(F.col("type")).alias("kind")), " SELECT id, type AS canonical, CASE WHEN http_method IS NOT NULL THEN true END AS valid_method, CASE WHEN type = 'Event' THEN 'event' ELSE 'default' END AS kind FROM C")
simple("parsed_pairs", lambda g: g.components.select("id", T.key_value(F.col("id")).alias("kv"), T.state_pair(F.col("id")).alias("pair"), T.comma_list(F.concat(F.lit(" ,"), "id", F.lit(" , "), "type")).alias("listed")).select("id", "kv.key", "kv.value", F.col("pair.from").alias("first"), F.col("pair.to").alias("last"), F.array_join("listed", "|").alias("listed")), " SELECT id, split_part(id, ':', 1) AS key, substr(id, instr(id, ':') + 1) AS value, split_part(id, ':', 1) AS first, split_part(id, ':', 2) AS last, id || '|' || type AS listed FROM C")
simple("code_urls", lambda g: g.components.select("id", T.code_url("https://code.example/", "org", F.col("source_location.repository"), "main", F.col("source_location.file_path"), F.lit(7)).alias("url"), T.pluralize(F.length("id") % 3, "entry", "entries").alias("word"), T.id_name(T.component_id(F.col("domain"), F.col("module"), F.col("type"), F.lit("One Name"))).alias("id_name")), " SELECT id, 'https://code.example/org/shop/blob/main/' || file || '#L7' AS url, CASE WHEN length(id) % 3 = 1 THEN 'entry' ELSE 'entries' END AS word, CASE WHEN contains(domain || module, ':') THEN NULL ELSE 'one-name' END AS id_name FROM C")


@query("near_matches", """, Q(query_id, q_name, q_type) AS (VALUES ('a', 'small rings', 'DomainOp'), ('b', 'Africa', 'API'), ('c', 'Supplier#00000001', NULL)),
P AS (SELECT query_id, ord, id, CASE WHEN least(length(name), length(q_name)) = 0 THEN 0.0 ELSE 1 - CAST(levenshtein(lower(q_name), lower(name)) AS DOUBLE) / greatest(length(name), length(q_name)) END AS score, CASE WHEN lower(q_name) = lower(name) AND q_type <> type THEN 'type' END AS mismatch FROM C, Q)
SELECT query_id, rank, id, round(score, 6) AS score, mismatch FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM P WHERE score >= 0.6 OR mismatch IS NOT NULL) WHERE rank <= 10""")
def near_matches(g: Graph) -> DataFrame:
    q = g.spark.createDataFrame([("a", "small rings", "DomainOp"), ("b", "Africa", "API"), ("c", "Supplier#00000001", None)], "query_id string, name string, type string")
    return build.near_matches(g.components, q).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"), "mismatch")


@query("slug_ids", " SELECT id, domain || ':' || module || ':' || lower(type) || ':' || regexp_replace(lower(name), '\\s+', '-', 'g') AS slug FROM C")
def slug_ids(g: Graph) -> DataFrame:
    return g.components.select("id", T.component_id(F.col("domain"), F.col("module"), F.col("type"), F.col("name")).alias("slug"))


@query("string_transforms", " SELECT p_partkey, upper(CASE WHEN starts_with(x, 'small-') THEN substr(x, 7) ELSE x END) AS shouted, array_to_string([upper(w[1]) || w[2:] for w in string_split(x, '-')], '') AS pascal, CASE WHEN length(p_name) <= 8 THEN p_name ELSE substr(p_name, 1, 6) || '...' END AS short FROM (SELECT *, replace(p_name, ' ', '-') AS x FROM part)")
def string_transforms(g: Graph) -> DataFrame:
    ops = g.components.filter("startswith(id, 'op:')")
    kebab = F.regexp_replace("name", " ", "-")
    return ops.select(F.substring("id", 4, 20).cast("long").alias("p_partkey"), T.transformed(kebab, {"toUpperCase": True, "stripPrefix": "small-"}).alias("shouted"), T.transformed(kebab, {"kebabToPascal": True}).alias("pascal"), T.truncate(F.col("name"), 8).alias("short"))


def declarations_of(g: Graph) -> DataFrame:
    """Parts as classes of a code base: brand folders, type as decorator, widgets extending a base."""
    c = F.col
    d = g.components.filter("startswith(id, 'op:')")
    none = lambda t: F.lit(None).cast(t)
    deco = F.array(F.struct(F.initcap("domain").alias("name"), F.lit("kit").alias("source"), F.array(F.concat(F.lit("/"), c("name"))).alias("args"), F.map_from_arrays(F.array(F.lit("kind")), F.array(c("module"))).alias("named_args")))
    return d.select(
        F.concat(F.lit("src/"), F.lower(F.regexp_replace("module", "#", "")), F.lit("/"), F.substring("id", 4, 20), F.lit(".ts")).alias("file"), "ord", F.lit("class").alias("kind"), T.transformed(F.regexp_replace("name", " ", "-"), {"kebabToPascal": True}).alias("name"), F.lit(1).alias("line"), none("string").alias("parent_class"), deco.alias("decorators"),
        F.array(F.lower("domain")).alias("jsdoc_tags"), F.when(F.endswith("name", F.lit("widget")), "Base").alias("extends"), none("array<struct<text:string,base:string,type_args:array<string>>>").alias("implements"), none("array<struct<name:string,is_static:boolean,literal_kind:string,literal:string>>").alias("properties"),
        none("array<struct<name:string,type:string>>").alias("parameters"), none("array<struct<name:string,type:string>>").alias("ctor_parameters"), none("string").alias("return_type"),
    )


MODULES = [
    {"name": "first", "path": "src/brand1*/**", "api": {"find": "classes", "where": {"extendsClass": {"name": "Base"}}}, "event": {"find": "classes", "where": {"and": [{"hasDecorator": {"name": ["Promo", "Large"], "from": "kit"}}, {"nameMatches": {"pattern": "^(Red|Small)"}}]}}},
    {"name": "rest", "path": ["src/**/*.ts"], "ui": {"find": "classes", "where": {"or": [{"nameEndsWith": {"suffix": "Ring"}}, {"hasJSDoc": {"tag": "economy"}}]}}, "useCase": {"notUsed": True}},
]


@query("declaration_predicates", """, DD AS (SELECT p_partkey, 'src/' || lower(replace(p_brand, '#', '')) || '/' || p_partkey || '.ts' AS file, array_to_string([upper(w[1]) || w[2:] for w in string_split(p_name, ' ')], '') AS name, p_name, p_type, starts_with(p_brand, 'Brand#1') AS one FROM part)
SELECT file, name, 'api' AS type, 'first' AS domain FROM DD WHERE one AND ends_with(p_name, 'widget') UNION ALL SELECT file, name, 'event', 'first' FROM DD WHERE one AND p_type IN ('PROMO', 'LARGE') AND (starts_with(name, 'Red') OR starts_with(name, 'Small')) UNION ALL SELECT file, name, 'ui', 'rest' FROM DD WHERE NOT one AND (ends_with(name, 'Ring') OR p_type = 'ECONOMY')""")
def declaration_predicates(g: Graph) -> DataFrame:
    return D.extract_components(declarations_of(g), MODULES).select("file", "name", "type", "domain")


@query("declaration_rules", " SELECT 'src/' || lower(replace(p_brand, '#', '')) || '/' || p_partkey || '.ts' AS file, replace(p_brand, '#', '') AS folder, '/' || p_name AS route, p_brand AS kind, CASE p_type WHEN 'PROMO' THEN 'offer' ELSE upper(p_type[1]) || lower(p_type[2:]) END AS deco FROM part")
def declaration_rules(g: Graph) -> DataFrame:
    d = declarations_of(g)
    return d.select(
        "file", F.initcap(D.extracted({"fromFilePath": {"pattern": "^src/([^/]+)/", "capture": 1}})).alias("folder"), D.extracted({"fromDecoratorArg": {"position": 0}}).alias("route"), D.extracted({"fromDecoratorArg": {"name": "kind"}}).alias("kind"), D.extracted({"fromDecoratorName": {"mapping": {"Promo": "offer"}}}).alias("deco")
    )


@query("glob_module_match", " SELECT 'src/' || lower(replace(p_brand, '#', '')) || '/' || p_partkey || '.ts' AS file, CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'first' ELSE 'rest' END AS module FROM part")
def glob_module_match(g: Graph) -> DataFrame:
    return D.module_of(declarations_of(g), MODULES)


@query("deduplicated_rules", " SELECT p_partkey, array_to_string([x for x in ['size ' || CAST(floor(p_size / 10) AS BIGINT), 'type ' || p_type] if x <> 'type PROMO'], ',') AS fresh FROM part")
def deduplicated_rules(g: Graph) -> DataFrame:
    ops = g.components.filter("startswith(id, 'op:')")
    return ops.select(F.substring("id", 4, 20).cast("long").alias("p_partkey"), F.array_join(T.new_only(F.col("business_rules"), F.array(F.lit("type PROMO"))), ",").alias("fresh"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(f: Build) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(star.graph(spark, sf_dir))

    return {name: bound(f) for name, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql}
