"""Commands on a graph file: what a shell user asks or builds, one JSON envelope per call.

    python -m archweave.cli --graph graph.json search order
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archweave import schema
from archweave.graph import Graph, GraphError
from archweave.operators import aggregate as A
from archweave.operators import build, declarations, select, traverse, validate
from archweave.sources import documents

NODE = ("id", "type", "name", "domain")
OPTIONS = {"route": "route", "api_type": "api_type", "http_method": "http_method", "path": "path", "operation_name": "operation_name", "entity": "entity", "event_name": "event_name", "event_schema": "event_schema", "custom_type": "custom_type_name", "description": "description"}


def load(spark: SparkSession, path: Path) -> Graph:
    if not path.exists():
        raise GraphError("GRAPH_NOT_FOUND", f"Graph not found at {path}", ["Run init first"])
    return documents.read_graphs(spark, path.resolve().as_uri())


def store(graph: Graph, path: Path, *, drop_empty: bool = False) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(json.loads(documents.to_documents(graph, drop_empty=drop_empty).first()["value"]), indent=2))


def builder(graph: Graph) -> build.Builder:
    return build.Builder.resume(graph, graph.graphs.first()["graph_id"])


def rows(df: DataFrame, *columns: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.select(*columns).collect()]


def trace(graph: Graph, id_: str) -> dict:
    try:
        met = traverse.trace_flow(graph, id_)
    except GraphError as e:
        name = id_.split(":")[3] if id_.count(":") == 3 else id_
        raise GraphError(e.code, str(e), build.suggestions(graph.components, name)) from None
    return {"componentIds": [r["id"] for r in met.orderBy("depth", "id").collect()], "linkIds": sorted(r["link_key"] for r in traverse.links_within(graph, met).collect())}


def extraction(spark: SparkSession, config: Path, table: str) -> list[dict]:
    """Draft components of a declarations table under a JSON config; the table is what a parser wrote."""
    told = json.loads(config.read_text())
    if wrong := declarations.config_errors(told):
        raise GraphError("INVALID_CONFIG", "; ".join(wrong))
    drafts = declarations.extract_components(spark.read.schema(schema.DECLARATIONS).parquet(table), told["modules"])
    return rows(drafts.orderBy("file", "place", "ord"), "type", "name", "file", "line", "domain")


def change(spark: SparkSession, a: argparse.Namespace) -> dict:
    b = builder(load(spark, a.graph))
    one = lambda **values: spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'map<string,string>' if isinstance(v, dict) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    given = lambda **values: one(**{k: v for k, v in values.items() if v is not None})
    if a.command == "add-domain":
        b = b.add_domains(one(name=a.name, description=a.description, system_type=a.system_type))
    elif a.command == "add-source":
        b = b.add_source(a.repository, a.commit)
    elif a.command == "define-custom-type":
        spec = lambda xs: {p[0]: (p[1], p[2] if len(p) > 2 else None) for p in (x.split(":", 2) for x in xs)}
        kind = "map<string,struct<type:string,description:string>>"
        b = b.define_custom_types(spark.createDataFrame([(a.name, a.description, spec(a.required), spec(a.optional))], f"name string, description string, required {kind}, optional {kind}"))
    elif a.command == "add-component":
        known = {t.lower(): t for t in schema.COMPONENT_TYPES}
        values = {c: getattr(a, o) for o, c in OPTIONS.items()} | {"type": known.get(a.type.lower(), a.type), "name": a.name, "domain": a.domain, "module": a.module}
        if a.subscribed_events is not None:
            values["subscribed_events"] = [x.strip() for x in a.subscribed_events.split(",") if x.strip()]
        row = given(**values, **({"props": dict(x.split(":", 1) for x in a.property)} if a.property else {}))
        row = row.withColumn("source_location", F.struct(F.lit(a.repository).alias("repository"), F.lit(a.file).alias("file_path"), F.lit(a.line).cast("int").alias("line_number"), *(F.lit(None).cast(t).alias(c) for c, t in (("end_line_number", "int"), ("method_name", "string"), ("url", "string")))))
        b = b.add_components(row, properties="props" if a.property else None)
    elif a.command == "link":
        b = b.link(given(source=a.source, target=a.target, type=a.type))
    elif a.command == "link-http":
        b = b.link(given(source=select.api_at(b.graph, a.path, a.method).first()["id"], target=a.target, type=a.type))
    elif a.command == "link-external":
        target = F.struct(*(F.lit(getattr(a, f"target_{c}")).cast("string").alias(c) for c in ("name", "domain", "repository", "url")))
        b = b.link_external(given(source=a.source, type=a.type).withColumn("target", target))
    else:
        moves = [x.split(":") for x in a.state_change]
        if any(len(m) != 2 for m in moves):
            raise GraphError("INVALID_STATE_CHANGE", "State changes are from:to")
        row = given(id=a.id, entity=a.entity, business_rules=a.business_rule or None)
        if moves:
            row = row.withColumn("state_changes", F.array(*(F.struct(F.lit(x).alias("from"), F.lit(y).alias("to"), F.lit(None).cast("string").alias("trigger")) for x, y in moves)))
        b = b.enrich(row)
    store(b.graph, a.graph)
    return {"graph": str(a.graph)}


def answer(spark: SparkSession, a: argparse.Namespace) -> object:
    if a.command == "init":
        if a.graph.exists():
            raise GraphError("GRAPH_EXISTS", f"Graph exists at {a.graph}")
        own = dict(x.split("=", 1) for x in a.domain)
        store(build.Builder.new(spark, [{"repository": r} for r in a.source], {n: {"description": d, "system_type": "domain"} for n, d in own.items()}).graph, a.graph)
        return {"graph": str(a.graph)}
    if a.command == "extract":
        return extraction(spark, a.config, a.declarations)
    if a.command in CHANGES:
        return change(spark, a)
    g = load(spark, a.graph)
    if a.command == "entry-points":
        return rows(A.entry_points(g).orderBy("ord"), *NODE)
    if a.command == "domains":
        return rows(A.domains(g).orderBy("ord").drop("graph_id", "ord"), "*")
    if a.command == "orphans":
        return rows(A.orphans(g).orderBy("ord"), "id")
    if a.command == "components":
        return rows(select.list_components(g, a.domain, a.type).orderBy("ord"), *NODE)
    if a.command == "component-checklist":
        found = rows(select.checklist(g, a.type).orderBy("ord"), *NODE)
        return {"total": len(found), "components": found}
    if a.command == "search":
        return rows(select.search(g, a.query).orderBy("ord"), *NODE)
    if a.command == "trace":
        return trace(g, a.id)
    if a.command == "component-summary":
        return rows(A.builder_stats(g).drop("graph_id"), "*")[0]
    if a.command == "check-consistency":
        found = rows(validate.warnings(g), "code", "message")
        return {"consistent": not found, "warnings": found}
    if a.command == "validate":
        errors = rows(validate.validate(g), "path", "message", "code")
        return {"valid": not errors, "errors": errors, "warnings": rows(validate.warnings(g), "code", "message")}
    store(builder(g).build(), a.output or a.graph, drop_empty=True)
    return {"graph": str(a.output or a.graph)}


CHANGES = ("add-domain", "add-source", "define-custom-type", "add-component", "link", "link-http", "link-external", "enrich")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="archweave")
    p.add_argument("--graph", type=Path, default=Path("graph.json"))
    sub = p.add_subparsers(dest="command", required=True)
    made = {n: sub.add_parser(n) for n in ("init", "extract", "entry-points", "domains", "orphans", "components", "component-checklist", "component-summary", "check-consistency", "validate", "finalize", "search", "trace", *CHANGES)}
    for name, args in {"search": ["query"], "trace": ["id"], "link": ["source", "target"], "link-http": ["path", "target"], "link-external": ["source", "target_name"], "enrich": ["id"], "add-domain": ["name", "description"], "add-source": ["repository"], "define-custom-type": ["name"], "add-component": ["type", "name", "domain", "module", "repository", "file"]}.items():
        for x in args:
            made[name].add_argument(x)
    for name, options in {
        "components": ["domain", "type"], "component-checklist": ["type"], "link": ["type"], "link-http": ["type", "method"], "link-external": ["type", "target_domain", "target_repository", "target_url"], "enrich": ["entity"], "add-source": ["commit"],
        "define-custom-type": ["description"], "add-component": [*OPTIONS, "subscribed_events", "line"],
    }.items():
        for x in options:
            made[name].add_argument("--" + x.replace("_", "-"), dest=x)
    made["add-domain"].add_argument("--system-type", dest="system_type", default="domain", choices=schema.SYSTEM_TYPES)
    for name, many in {"init": ["source", "domain"], "enrich": ["state_change", "business_rule"], "define-custom-type": ["required", "optional"], "add-component": ["property"]}.items():
        for x in many:
            made[name].add_argument("--" + x.replace("_", "-"), dest=x, action="append", default=[])
    made["finalize"].add_argument("--output", type=Path)
    made["extract"].add_argument("config", type=Path)
    made["extract"].add_argument("declarations")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        return {"success": True, "data": answer(spark, a), "warnings": []}
    except GraphError as e:
        return documents.failure(e)


if __name__ == "__main__":
    out = main()
    print(json.dumps(out))
    sys.exit(not out["success"])
