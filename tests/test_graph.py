"""Operators on small graphs, and against small models on random ones."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archweave.functions import text as T
from archweave.graph import Graph, GraphError
from archweave.operators import aggregate as A
from archweave.operators import build, compare, declarations, entities, events, select, traverse, validate
from archweave.operators import flows as flows_of
from archweave.plans.fixpoint import Rounds
from archweave.sources import documents
from archweave.streaming.counters import link_counts, link_stream
from tests.graphs import document, graph, link, node


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


@pytest.fixture(scope="module")
def shop(spark):
    return graph(
        spark,
        [
            node("UI", "page"), node("API", "api"), node("UseCase", "use"), node("DomainOp", "begin", entity="Order", stateChanges=[{"from": "Placed", "to": "Confirmed"}, {"from": "*", "to": "Cancelled"}], businessRules=["r1", "r2"]),
            node("DomainOp", "ship", "shipping", entity="Order", stateChanges=[{"from": "Draft", "to": "Placed"}, {"from": "Confirmed", "to": "Shipped"}], businessRules=["r2", "r3"]), node("Event", "placed", eventName="OrderPlaced"),
            node("EventHandler", "on", "shipping", subscribedEvents=["OrderPlaced", "Ghost", "OrderPlaced"]), node("Custom", "cron", "nowhere"), node("UseCase", "alone"),
        ],
        [link("page", "api", type="sync"), link("api", "use", type="async"), link("use", "begin"), link("begin", "placed"), link("placed", "on", type="async"), link("on", "ship"), link("ship", "missing", id="L1"), link("use", "use")],
        external=[{"source": "cron", "target": {"name": "Stripe", "url": "http://s"}}, {"source": "ship", "target": {"name": "Stripe"}}, {"source": "ghost", "target": {"name": "Nope"}}],
        domains={"orders": {"description": "o", "systemType": "domain"}, "shipping": {"description": "s", "systemType": "bff"}, "idle": {"description": "i", "systemType": "other"}},
    )


def test_lookups(shop):
    assert ids(select.search(shop, "SHIP")) == ["on", "ship"] and select.search(shop, "").count() == 0 and select.search(shop, "%").count() == 0
    assert select.find(shop, "type = 'UseCase'").first()["id"] == "use"
    assert ids(select.list_components(shop, type_="usecase")) == ["alone", "use"] and select.checklist(shop, "usecase").count() == 0
    assert select.list_components(shop, domain="").count() == 0
    with pytest.raises(GraphError) as e:
        select.list_components(shop, type_="nope")
    assert e.value.code == "INVALID_COMPONENT_TYPE"
    assert select.api_at(shop, "/p", "get").first()["id"] == "api"
    with pytest.raises(GraphError):
        select.api_at(shop, "/none")


def test_three_kinds_of_orphans_and_warnings(shop):
    assert ids(A.orphans(shop)) == ["alone", "cron"] and ids(A.orphans(shop, external=True)) == ["alone"]
    w = {(r["code"], r["component_id"] or r["domain_name"]) for r in validate.warnings(shop).collect()}
    assert w == {("ORPHAN_COMPONENT", "alone"), ("UNUSED_DOMAIN", "idle")} and not validate.is_consistent(shop)


def test_validation(shop):
    got = [(r["path"], r["code"]) for r in validate.validate(shop).collect()]
    assert sorted(got) == [("/components/7/customTypeName", "INVALID_TYPE"), ("/links/6/target", "INVALID_LINK_TARGET")]


def test_stats_differ_by_kind(shop):
    s, b, v = (f(shop).first() for f in (A.stats, A.builder_stats, A.viewer_stats))
    assert (s["domains"], b["domains"], v["domains"]) == (3, 3, 3) and s["entities"] == 1 and s["links"] == 8 and b["external_links"] == 3
    d = {r["name"]: r for r in A.domains(shop).collect()}
    assert set(d) == {"orders", "shipping", "idle"} and d["idle"]["total"] == 0 and d["orders"]["domainop"] == 1


def test_between_domains(shop):
    assert [(r["source_domain"], r["target_domain"], r["link_type"]) for r in A.cross_domain_links(shop, "orders").collect()] == [("orders", "shipping", "async")]
    assert {(r["domain"], r["direction"], r["event_count"]) for r in A.domain_connections(shop).collect()} == {("orders", "outgoing", 1), ("shipping", "incoming", 1)}
    x = A.external_domains(shop).first()
    assert (x["name"], x["source_domains"], x["connection_count"]) == ("Stripe", ["shipping", "nowhere"], 2) or x["source_domains"] == ["nowhere", "shipping"]
    assert A.domain_map_edges(shop, details=True).first()["label"] == "1 Event"


def test_events(shop):
    assert [h["handler_id"] for h in events.published_events(shop).first()["handlers"]] == ["on"]
    s = events.event_handlers(shop).first()["subscriptions"]
    assert [(x["event_name"], x["source_known"]) for x in s] == [("OrderPlaced", True), ("Ghost", False), ("OrderPlaced", True)]
    assert events.published_events(shop, "shipping").count() == 0 and events.published_events(shop, "").count() == 1


def test_state_order_and_entities(shop):
    assert entities.states(shop).first()["states"] == ["Draft", "Placed", "Confirmed", "Shipped", "Cancelled"]
    e = {r["domain"]: r for r in entities.entities(shop).collect()}
    assert e["orders"]["rules"] == e["shipping"]["rules"] == ["r1", "r2", "r3"] and e["orders"]["first_operation_id"] == "begin" and len(e["orders"]["transitions"]) == 4
    assert entities.entities(shop, "orders").count() == 1


def state_model(changes):
    nxt, order, froms, tos = {}, [], [], set()
    for a, b in changes:
        for s in (a, b):
            if s != "*" and s not in order:
                order.append(s)
        if a != "*":
            nxt[a] = b
            if a not in froms:
                froms.append(a)
        tos.add(b)
    out = []
    for root in (f for f in froms if f not in tos):
        s = root
        while s is not None and s not in out:
            out.append(s)
            s = nxt.get(s)
    return out + [s for s in order if s not in out]


def test_state_order_random(spark):
    rng, nodes, want = random.Random(4), [], {}
    for i in range(40):
        changes = [(rng.choice("*abcdef"), rng.choice("abcdef")) for _ in range(rng.randrange(1, 8))]
        nodes.append(node("DomainOp", f"op{i}", entity=f"e{i}", stateChanges=[{"from": a, "to": b} for a, b in changes]))
        want[f"e{i}"] = state_model(changes)
    assert {r["entity"]: r["states"] for r in entities.states(graph(spark, nodes)).collect()} == want


def test_flows(shop):
    steps = traverse.flows(shop).filter("entry = 'page'").orderBy("step").collect()
    assert [(r["id"], r["depth"], r["link_type"]) for r in steps] == [("page", 0, "sync"), ("api", 1, "async"), ("use", 2, None), ("begin", 3, None), ("placed", 4, "async"), ("on", 5, None), ("ship", 6, None)]


def test_trace_and_search(shop):
    assert "missing" in ids(traverse.trace_flow(shop, "ship")) and "alone" not in ids(traverse.trace_flow(shop, "ship"))
    keys = ids(traverse.links_within(shop, traverse.trace_flow(shop, "on")), "link_key")
    assert "L1" in keys and "use->use" not in keys
    with pytest.raises(GraphError):
        traverse.trace_flow(shop, "nobody")
    assert traverse.search_with_flow(shop, "  ").count() == 0 and traverse.search_with_flow(shop, " ", all_on_empty=True).count() == 9
    assert traverse.search_with_flow(shop, "page ").count() == 0 and ids(traverse.search_nodes(shop, " alone ")) == ["alone"]


def random_graph(rng, n=9, m=14):
    types = ["UI", "API", "UseCase", "DomainOp", "Event", "EventHandler", "Custom"]
    nodes = [node(rng.choice(types), f"n{i}", rng.choice("ab")) for i in range(n)]
    links = [link(f"n{rng.randrange(n + 1)}", f"n{rng.randrange(n + 1)}", **({"type": t} if (t := rng.choice(["sync", "async", None])) else {})) for _ in range(m)]
    return nodes, links


def flow_model(nodes, links):
    out, known = {}, {c["id"] for c in nodes}
    for c in nodes:
        if c["type"] in ("UI", "API", "EventHandler", "Custom") and all(x["target"] != c["id"] for x in links):
            seen, steps = set(), []

            def walk(i, d):
                if i in seen:
                    return
                seen.add(i)
                if i not in known:
                    return
                steps.append((i, d))
                for x in links:
                    if x["source"] == i:
                        walk(x["target"], d + 1)

            walk(c["id"], 0)
            out[c["id"]] = steps
    return out


def depth_model(i, links, seen):
    if i in seen:
        return 0
    back = [x["source"] for x in links if x["target"] == i]
    return max(depth_model(s, links, seen | {i}) for s in back) + 1 if back else 0


def rewire_model(nodes, links, visible):
    seen = {c["id"] for c in nodes if c["type"] in visible}
    hidden = {c["id"] for c in nodes} - seen
    out = [(x["source"], x["target"], x.get("type"), False) for x in links if x["source"] in seen and x["target"] in seen]
    pairs = {}

    def walk(start, i, met):
        for x in links:
            if x["source"] == i:
                if x["target"] in seen:
                    pairs.setdefault((start, x["target"]), x.get("type"))
                elif x["target"] in hidden and x["target"] not in met:
                    met.add(x["target"])
                    walk(start, x["target"], met)

    for s in sorted(seen):
        met = set()
        for x in links:
            if x["source"] == s and x["target"] in hidden and x["target"] not in met:
                met.add(x["target"])
                walk(s, x["target"], met)
    return sorted(map(str, out + [(a, b, t, True) for (a, b), t in pairs.items()]))


def test_traversal_random(spark):
    """Twelve graphs as one bundle: every operator answers for all of them at once."""
    rng = random.Random(11)
    made = {f"g{i}": random_graph(rng) for i in range(12)}
    g = documents.parse(spark.createDataFrame([(k, document(*v)) for k, v in made.items()], "graph_id string, value string"))
    flows = {}
    for r in traverse.flows(g).orderBy("step").collect():
        flows.setdefault((r["graph_id"], r["entry"]), []).append((r["id"], r["depth"]))
    assert flows == {(k, e): s for k, v in made.items() for e, s in flow_model(*v).items()}
    depths = {(r["graph_id"], r["id"]): r["depth"] for r in traverse.longest_depths(g).collect()}
    assert depths == {(k, c["id"]): depth_model(c["id"], links, frozenset()) for k, (nodes, links) in made.items() for c in nodes}
    visible = ["UI", "DomainOp", "Event"]
    rewired = {}
    for r in traverse.filter_by_type(g, visible)[1].collect():
        rewired.setdefault(r["graph_id"], []).append(str((r["source"], r["target"], r["type"], r["rewired"])))
    assert {k: sorted(v) for k, v in rewired.items()} == {k: m for k, v in made.items() if (m := rewire_model(*v, visible))}
    least = {(r["graph_id"], r["id"]): r["depth"] for r in traverse.node_depths(g).collect()}
    for k, (_, links) in made.items():
        for (gid, i), d in least.items():
            if gid == k:
                assert all(least[k, x["target"]] <= d + 1 for x in links if x["source"] == i)


def test_diffs(spark, shop):
    before = graph(spark, [node("UI", "a"), node("UI", "b"), node("DomainOp", "c", businessRules=["x"])], [link("a", "b"), link("b", "c", id="k", type="sync"), link("a", "c", type="sync")])
    after = graph(spark, [node("UI", "a", route="/y"), node("DomainOp", "c", businessRules=["y"]), node("UI", "d")], [link("a", "b"), link("b", "c", id="k2", type="sync"), link("a", "c", type="async")])
    got = {r["id"]: (r["change"], r["changed_fields"]) for r in compare.diff_components(before, after).collect()}
    assert got == {"a": ("modified", ["route"]), "b": ("removed", None), "c": ("modified", ["businessRules"]), "d": ("added", None)}
    assert {(r["link_key"], r["change"]) for r in compare.diff_links(before, after).collect()} == {("k", "removed"), ("k2", "added")}
    assert {r["id"]: r["status"] for r in compare.compare_nodes(before, after).collect()} == {"a": "modified", "b": "removed", "c": "unchanged", "d": "added"}
    assert {(r["source"], r["target"]): r["status"] for r in compare.compare_edges(before, after).collect()} == {("a", "b"): "unchanged", ("b", "c"): "unchanged", ("a", "c"): "modified"}
    assert compare.diff_stats(shop, shop).first()["components_modified"] == 0


def test_near_matches(spark):
    g = graph(spark, [node("UseCase", "OrderService"), node("UseCase", "PaymentService"), node("Event", "OrderPlaced"), node("UseCase", "ShippingService", "shipping")])
    q = spark.createDataFrame([("t", "Ordr Service", None, None), ("m", "orderplaced", "API", None), ("d", "shippingservice", "UseCase", "orders"), ("e", "", None, None)], "query_id string, name string, type string, domain string")
    got = {}
    for r in build.near_matches(g.components, q, limit=1).collect():
        got[r["query_id"]] = (r["id"], r["mismatch"])
    assert got == {"t": ("OrderService", None), "m": ("OrderPlaced", "type"), "d": ("ShippingService", "domain")}
    assert [round(r[0], 3) for r in spark.createDataFrame([("", ""), ("a", ""), ("ab", "AC")], "a string, b string").select(T.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5]


def test_builder_round_trip(spark, tmp_path):
    b = build.Builder.new(spark, [{"repository": "r"}], {"orders": {"description": "d", "system_type": "domain"}})
    rows = spark.createDataFrame([(0, "UI", "Home Page", "orders", "web", "/home"), (1, "DomainOp", "Place  Order", "orders", "core", None)], "ord long, type string, name string, domain string, module string, route string")
    b = b.add_components(rows.withColumn("operation_name", F.expr("if(ord = 1, name, null)")).withColumn("source_location", F.expr("named_struct('repository','r','file_path','f','line_number',1,'end_line_number',null,'method_name',null,'url',null)")))
    assert ids(b.graph.components) == ["orders:core:domainop:place-order", "orders:web:ui:home-page"]
    b = b.link(spark.createDataFrame([("orders:web:ui:home-page", "orders:core:domainop:place-order", "sync")], "source string, target string, type string"))
    b = b.enrich(spark.createDataFrame([("orders:core:domainop:place-order", "Order", ["r1", "r1"])], "id string, entity string, business_rules array<string>"))
    b = b.enrich(spark.createDataFrame([("orders:core:domainop:place-order", ["r1", "r2"])], "id string, business_rules array<string>"))
    assert b.graph.components.filter("entity = 'Order'").first()["business_rules"] == ["r1", "r1", "r2"]
    for bad, code in ((rows.filter("ord = 0"), "DUPLICATE_COMPONENT"), (rows.withColumn("domain", F.lit("x")), "DOMAIN_NOT_FOUND")):
        with pytest.raises(GraphError) as e:
            b.add_components(bad)
        assert e.value.code == code
    with pytest.raises(GraphError) as e:
        b.link(spark.createDataFrame([("orders:web:ui:home-pag", "x")], "source string, target string"))
    assert e.value.code == "COMPONENT_NOT_FOUND" and e.value.suggestions == ["orders:web:ui:home-page"]
    with pytest.raises(GraphError):
        b.add_domains(spark.createDataFrame([("orders", "d", "domain")], "name string, description string, system_type string"))
    open_ = b.link(spark.createDataFrame([("orders:web:ui:home-page", "later")], "source string, target string"))
    with pytest.raises(GraphError, match="Validation failed"):
        open_.build()
    documents.write_graphs(b.build(), f"file://{tmp_path}/out", drop_empty=True)
    back = documents.read_graphs(spark, f"file://{tmp_path}/out/*.txt")
    assert ids(back.components) == ids(b.graph.components) and back.links.first()["type"] == "sync" and back.domains.first()["system_type"] == "domain"


def test_custom_types(spark):
    b = build.Builder.new(spark, [{"repository": "r"}], {"d": {"description": "d", "system_type": "other"}})
    b = b.define_custom_types(spark.createDataFrame([("job", None, {"when": ("string", None)}, None)], "name string, description string, required map<string,struct<type:string,description:string>>, optional map<string,struct<type:string,description:string>>"))
    kind = "type string, name string, domain string, module string, custom_type_name string, props map<string,string>"
    with pytest.raises(GraphError) as e:
        b.add_components(spark.createDataFrame([("Custom", "x", "d", "m", "job", {})], kind), properties="props")
    assert e.value.code == "MISSING_REQUIRED_PROPERTIES"
    ok = b.add_components(spark.createDataFrame([("Custom", "x", "d", "m", "job", {"when": "noon", "id": "mine"})], kind), properties="props")
    assert ids(ok.graph.components) == ["mine"]
    with pytest.raises(GraphError):
        b.add_components(spark.createDataFrame([("Custom", "x", "d", "m", "nope", {})], kind), properties="props")


def test_schema_errors(spark):
    bad = json.loads(document([node("UI", "a"), {"id": "", "type": "API", "apiType": "REST"}, node("UseCase", "u", extra=1)], [{"source": "a"}, link("a", "b", type="maybe")]))
    bad["version"] = "1"
    docs = spark.createDataFrame([("ok", document([node("UI", "a")])), ("bad", json.dumps(bad)), ("none", "not json")], "graph_id string, value string")
    got = {}
    for r in documents.schema_errors(docs).collect():
        got.setdefault(r["graph_id"], set()).add((r["path"], r["message"]))
    assert "ok" not in got and got["none"] == {("", "must be a JSON object")}
    want = {("/version", "must match pattern"), ("/components/1", "must have required property 'httpMethod'"), ("/components/1", "id must NOT have fewer than 1 characters"), ("/components/2", "must NOT have additional properties"), ("/links/0", "must have required property 'target'"), ("/links/1", "type must be equal to one of the allowed values")}
    assert want <= got["bad"] and not any(p == "/components/0" for p, _ in got["bad"])


def test_text_functions(spark):
    df = spark.createDataFrame([("order-placed-event", "OrderPlacedHandler", "a:b", "k:v:w", " x , ,y")], "a string, b string, c string, d string, e string")
    r = df.select(
        T.transformed(F.col("a"), {"kebabToPascal": True, "stripSuffix": "-event"}).alias("p"), T.transformed(F.col("b"), {"pascalToKebab": True, "stripSuffix": "Handler"}).alias("k"), T.state_pair(F.col("c")).alias("s"), T.state_pair(F.col("d")).alias("n"), T.key_value(F.col("d")).alias("kv"),
        T.comma_list(F.col("e")).alias("l"), T.transformed(F.col("a"), {"stripSuffix": ""}).alias("z"),
    ).first()
    assert (r["p"], r["k"], tuple(r["s"]), r["n"], tuple(r["kv"]), r["l"], r["z"]) == ("OrderPlaced", "order-placed", ("a", "b"), None, ("k", "v:w"), ["x", "y"], "")


@pytest.mark.parametrize(("glob", "yes", "no"), [("src/**/*.ts", ["src/a.ts", "src/a/b.ts"], ["src/a.js", "x/src/a.ts", "src/.h/a.ts"]), ("src/*.{ts,js}", ["src/a.ts", "src/a.js"], ["src/a/b.ts"]), ("a?[bc]", ["axb"], ["axd", "a/b"]), ("lib/**", ["lib/a", "lib/a/b"], ["lib"])])
def test_globs(spark, glob, yes, no):
    rx = T.glob_regex(glob)
    got = [r["f"] for r in spark.createDataFrame([(f,) for f in yes + no], "f string").filter(F.col("f").rlike(rx)).collect()]
    assert sorted(got) == sorted(yes)


def test_declarations(spark):
    from archweave.schema import DECLARATIONS

    deco = [("UseCase", "kit", ["/x"], {"kind": "k"})]
    rows = [
        ("src/a.ts", 0, "class", "AService", 1, None, deco, ["core"], "Base<T>", [("Handles<X | Y>", "Handles", ["X | Y"])], [], None, None, None), ("src/a.ts", 1, "method", "run", 2, "AService", [], [], None, None, None, [("p", "Cmd"), ("q", None)], None, None),
        ("src/b.ts", 2, "class", "Base", 1, None, [], [], "AService", None, [("route", False, "string", "order-route"), ("n", True, "number", "3")], None, None, None), ("lib/c.ts", 3, "function", "f", 1, None, [], [], None, None, None, None, None, None),
    ]
    d = spark.createDataFrame(rows, DECLARATIONS)
    modules = [{"name": "m", "path": "src/**", "useCase": {"find": "classes", "where": {"hasDecorator": {"name": "UseCase", "from": "kit"}}}, "api": {"find": "methods", "where": {"inClassWith": {"hasJSDoc": {"tag": "core"}}}}, "customTypes": {"x": {"find": "classes", "where": {"or": []}}}}]
    assert {(r["type"], r["name"], r["domain"]) for r in declarations.extract_components(d, modules).collect()} == {("useCase", "AService", "m"), ("api", "run", "m")}
    assert {(r["name"], r["value"]) for r in declarations.property_values(d, "route", transform={"kebabToPascal": True}).collect()} == {("AService", "OrderRoute"), ("Base", "OrderRoute")}
    assert {(r["name"], tuple(r["types"])) for r in declarations.generic_args(d, "Handles", 0).collect()} == {("AService", ("X", "Y")), ("Base", ("X", "Y"))}
    run = d.filter("name = 'run'").select(declarations.extracted({"fromParameterType": {"position": 1}}).alias("t"), declarations.extracted({"fromClassName": {"transform": {"stripSuffix": "Service"}}}).alias("c"), declarations.extracted({"fromMethodSignature": {}}).alias("s")).first()
    assert (run["t"], run["c"], run["s"]["return_type"]) == ("unknown", "A", "unknown")
    with pytest.raises(GraphError, match="lacks rules"):
        declarations.resolve_modules(modules, dict)
    assert declarations.resolve_modules([{"name": "m", "path": "p", "extends": "base"}], lambda s: declarations.CONVENTIONS)[0]["ui"]
    assert declarations.config_errors({"modules": modules}) == [] and declarations.config_errors({}) and declarations.config_errors({"modules": [{"name": "m", "path": "p", "ui": {"find": "rows", "where": {"huh": 1}, "extract": {}}}]})


def test_streaming_counts(spark, tmp_path):
    from archweave.schema import LINKS

    rows = spark.createDataFrame([("g", 0, None, "a", "b", "sync", None, None), ("g", 1, None, "a", "c", None, None, None)], LINKS).withColumn("seen_at", F.to_timestamp(F.lit("2024-01-01 00:10:00")))
    rows.write.parquet(f"{tmp_path}/in")
    q = link_counts(link_stream(spark, f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["type"], r["n"]) for r in spark.table("counts").collect()) == [("sync", 1), ("unknown", 1)]


def test_flows_blocks(spark, monkeypatch):
    """Small blocks, slices without rows and blocks too wide for one task give the flows that whole ones give, and no path is kept."""
    rng = random.Random(5)
    made = {f"g{i}": random_graph(rng) for i in range(6)}
    g = documents.parse(spark.createDataFrame([(k, document(*v)) for k, v in made.items()], "graph_id string, value string"))
    want = {(k, e, i, d, n) for k, v in made.items() for e, s in flow_model(*v).items() for n, (i, d) in enumerate(s, 1)}
    got = lambda df: {(r["graph_id"], r["entry"], r["id"], r["depth"], r["step"]) for r in df.collect()}
    monkeypatch.setattr(flows_of, "ENTRIES", 2)
    small = flows_of.flows(g)
    assert got(small) == want and "array<bigint>" not in small._jdf.queryExecution().toString()
    assert got(flows_of.flows(g, most_links=3)) == want
    of = g.components.select("graph_id", "id").distinct().filter("id IN ('n1', 'n4')").withColumn("carried", F.array("id"))
    for most in (3, 10**6):
        some = flows_of.flows(g, of, most_links=most)
        assert got(some) == {w for w in want if w[2] in ("n1", "n4")} and all(r["carried"] == [r["id"]] for r in some.collect())


def test_flows_read_without_shuffle(spark, monkeypatch, tmp_path):
    """What flows are walked over is all that is left on disk when they are read, and reading shuffles nothing."""
    rng = random.Random(6)
    made = {f"g{i}": random_graph(rng) for i in range(8)}
    g = documents.parse(spark.createDataFrame([(k, document(*v)) for k, v in made.items()], "graph_id string, value string"))
    want = {(k, e, i, d, n) for k, v in made.items() for e, s in flow_model(*v).items() for n, (i, d) in enumerate(s, 1)}
    monkeypatch.setattr(flows_of, "ENTRIES", 2)
    monkeypatch.setattr(flows_of, "LEAST_ENTRIES", 1)
    monkeypatch.setattr(flows_of, "SLICES", 2)
    monkeypatch.setattr(flows_of, "Rounds", lambda spark: at_root(spark, tmp_path))
    flows = flows_of.flows(g)
    assert "Exchange" not in flows._jdf.queryExecution().executedPlan().toString().split("Location")[0]
    assert len(list(tmp_path.glob("*"))) == 2  # packed blocks, and the empty list of those too wide
    assert {(r["graph_id"], r["entry"], r["id"], r["depth"], r["step"]) for r in flows.collect()} == want


def test_flows_links_read_once_a_slice(spark, monkeypatch, tmp_path):
    """Nodes and entry points come of one pass over links for each slice; a walk steps on nodes that lead on only."""
    rng = random.Random(7)
    made = {f"g{i}": random_graph(rng) for i in range(4)}
    g = documents.parse(spark.createDataFrame([(k, document(*v)) for k, v in made.items()], "graph_id string, value string"))
    want = {(k, e, i, d, n) for k, v in made.items() for e, s in flow_model(*v).items() for n, (i, d) in enumerate(s, 1)}
    read = spark.sparkContext.accumulator(0)
    n = g.links.count()
    counted = F.udf(lambda x: (read.add(1), x)[1]).asNondeterministic()
    seen = Graph(g.components, g.links.withColumn("source", counted("source")), *(getattr(g, x) for x in ("external_links", "domains", "custom_types", "graphs")))
    got = {(r["graph_id"], r["entry"], r["id"], r["depth"], r["step"]) for r in flows_of.flows(seen).collect()}
    assert got == want and read.value <= flows_of.SLICES * n


def test_flows_large_parts():
    """No link is lost where nodes times targets of a part pass 32 bits."""
    n, rng = 400_000, random.Random(3)
    own = {"graph_id": pa.array(["g"]).take(pa.array([0] * n)), "id": pa.array([f"n{i}" for i in range(n)])}
    none = pa.nulls(n, pa.string())
    here = pa.RecordBatch.from_pydict({"graph_id": own["graph_id"], "role": pa.array([flows_of.COMPONENT] * n, pa.int32()), "id": own["id"], "ord": pa.nulls(n, pa.int64()), "target": none, "type": none})
    links = pa.RecordBatch.from_pydict({"graph_id": own["graph_id"], "role": pa.array([flows_of.LINK] * n, pa.int32()), "id": own["id"], "ord": pa.array(range(n)), "target": pa.array([f"t{rng.randrange(n)}" for _ in range(n)]), "type": none})
    assert sum(x for b in flows_of._group(iter([here, links])) for x in b["n_targets"].to_pylist()) == n


def at_root(spark, root):
    rounds = Rounds(spark)
    rounds.root = f"file://{root}"
    return rounds
