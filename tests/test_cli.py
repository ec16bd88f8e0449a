"""Commands on a graph file, from an empty folder to a finished graph."""

import json

import pytest

from archweave.cli import main
from archweave.operators.details import domain_details
from archweave.sources.documents import read_graphs


def test_build_and_ask(spark, tmp_path):
    path = tmp_path / "sub" / "graph.json"
    run = lambda *argv: main(["--graph", str(path), *argv], spark)
    assert run("orphans")["error"]["code"] == "GRAPH_NOT_FOUND"
    assert run("init", "--source", "repo", "--domain", "orders=Order things")["success"]
    assert run("init", "--source", "repo", "--domain", "orders=x")["error"]["code"] == "GRAPH_EXISTS"
    assert run("add-domain", "idle", "Nothing")["success"] and run("add-source", "other", "--commit", "c1")["success"]
    assert run("add-component", "api", "Place", "orders", "web", "repo", "a.ts", "--api-type", "REST", "--http-method", "POST", "--path", "/orders", "--line", "3")["success"]
    assert run("add-component", "DomainOp", "Begin", "orders", "core", "repo", "b.ts", "--operation-name", "begin")["success"]
    assert run("define-custom-type", "job", "--required", "when:string")["success"]
    assert run("add-component", "Custom", "Nightly", "orders", "core", "repo", "c.ts", "--custom-type", "job")["error"]["code"] == "MISSING_REQUIRED_PROPERTIES"
    assert run("add-component", "Custom", "Nightly", "orders", "core", "repo", "c.ts", "--custom-type", "job", "--property", "when:noon")["success"]
    api, op, job = "orders:web:api:place", "orders:core:domainop:begin", "orders:core:custom:nightly"
    assert run("link-http", "/orders", op, "--method", "post", "--type", "sync")["success"] and run("link-external", job, "Stripe")["success"]
    assert run("enrich", op, "--entity", "Order", "--state-change", "Draft:Placed", "--business-rule", "r")["success"]
    assert run("enrich", op, "--state-change", "x")["error"]["code"] == "INVALID_STATE_CHANGE"
    assert run("trace", api)["data"] == {"componentIds": [api, op], "linkIds": [f"{api}->{op}"]}
    assert run("trace", "orders:web:api:plac")["error"]["suggestions"] == [api]
    assert [r["id"] for r in run("search", "BEGIN")["data"]] == [op]
    assert [r["id"] for r in run("entry-points")["data"]] == [api, job] and run("orphans")["data"] == [{"id": job}]
    assert run("component-checklist", "--type", "api")["data"]["total"] == 0 and len(run("components", "--type", "api")["data"]) == 1
    assert run("component-summary")["data"]["components"] == 3 and run("check-consistency")["data"]["warnings"][0]["code"] == "UNUSED_DOMAIN"
    v = run("validate")["data"]
    assert v["valid"] and not v["errors"] and {d["name"]: d["total"] for d in run("domains")["data"]} == {"orders": 3, "idle": 0}
    assert run("finalize", "--output", str(tmp_path / "out.json"))["success"]
    out = json.loads((tmp_path / "out.json").read_text())
    assert [s["repository"] for s in out["metadata"]["sources"]] == ["repo", "other"] and out["components"][2]["when"] == "noon"
    g = read_graphs(spark, (tmp_path / "out.json").as_uri())
    assert domain_details(g, "nope") is None and domain_details(g, "orders")["entities"].first()["states"] == ["Draft", "Placed"]
    with pytest.raises(SystemExit):
        run("nope")
