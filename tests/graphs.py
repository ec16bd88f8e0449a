"""Graphs for tests, spelt as documents."""

import json

from archweave.sources.documents import parse

PLACE = {"repository": "r", "filePath": "f"}


def node(type_, name, domain="orders", **more):
    own = {"UI": {"route": "/x"}, "API": {"apiType": "REST", "httpMethod": "GET", "path": "/p"}, "DomainOp": {"operationName": name}, "Event": {"eventName": name}, "EventHandler": {"subscribedEvents": []}, "Custom": {"customTypeName": "job"}}.get(type_, {})
    return {"id": name, "type": type_, "name": name, "domain": domain, "module": "m", "sourceLocation": PLACE} | own | more


def link(a, b, **more):
    return {"source": a, "target": b} | more


def document(nodes=(), links=(), external=None, domains=None, types=None):
    meta = {"domains": domains or {"orders": {"description": "d", "systemType": "domain"}}}
    if types is not None:
        meta["customTypes"] = types
    out = {"version": "1.0", "metadata": meta, "components": list(nodes), "links": list(links)}
    return json.dumps(out | ({"externalLinks": external} if external is not None else {}))


def graph(spark, *args, **kw):
    return parse(spark.createDataFrame([("g", document(*args, **kw))], "graph_id string, value string"))
