"""Graph documents as JSON: read one or many at once, check them against the model, write them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archweave import schema
from archweave.graph import Graph, GraphError
from archweave.operators.build import component_json, json_value

_J_LOCATION = "struct<repository:string,filePath:string,lineNumber:int,endLineNumber:int,methodName:string,url:string>"
_J_SIGNATURE = "struct<parameters:array<struct<name:string,type:string,description:string>>,returnType:string>"
_DOCUMENT = "version string, metadata string, components array<string>, links array<string>, externalLinks array<string>"
_LINK = f"id string, source string, target string, type string, payload string, sourceLocation {_J_LOCATION}"
_EXTERNAL = f"id string, source string, target struct<name:string,domain:string,repository:string,url:string>, type string, description string, sourceLocation {_J_LOCATION}"
_PROPERTIES = "map<string,struct<type:string,description:string>>"


def _j_type(column: str, kind: str) -> str:
    return {"source_location": _J_LOCATION, "signature": _J_SIGNATURE}.get(column, kind)


_COMPONENT = ", ".join(f"{k} {_j_type(c, t)}" for c, t, k in schema.COMPONENT_FIELDS)


def _location(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(c["repository"].alias("repository"), c["filePath"].alias("file_path"), c["lineNumber"].alias("line_number"), c["endLineNumber"].alias("end_line_number"), c["methodName"].alias("method_name"), c["url"].alias("url")))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(graph_id, value): whole files, a file's path being the graph's id."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("graph_id"), "value")


def parse(docs: DataFrame) -> Graph:
    """A Graph from (graph_id, value); array places become ``ord``. Text that is no JSON gives no rows."""
    d = docs.select("graph_id", F.from_json("value", _DOCUMENT).alias("d")).select("graph_id", "d.*").filter("components IS NOT NULL OR links IS NOT NULL OR version IS NOT NULL")
    each = lambda col: d.select("graph_id", F.posexplode(col).alias("ord", "raw"))
    c = each("components").select("graph_id", F.col("ord").cast("bigint").alias("ord"), "raw", F.from_json("raw", _COMPONENT).alias("c"))
    own = {"source_location": _location(F.col("c.sourceLocation")), "signature": F.when(F.col("c.signature").isNotNull(), F.struct(F.col("c.signature.parameters").alias("parameters"), F.col("c.signature.returnType").alias("return_type")))}
    components = c.select("graph_id", "ord", *(own.get(x, F.col(f"c.{k}")).alias(x) for x, _, k in schema.COMPONENT_FIELDS), "raw")
    link = each("links").select("graph_id", F.col("ord").cast("bigint").alias("ord"), F.from_json("raw", _LINK).alias("x"))
    links = link.select("graph_id", "ord", "x.id", "x.source", "x.target", "x.type", "x.payload", _location(F.col("x.sourceLocation")).alias("source_location"))
    ext = each("externalLinks").select("graph_id", F.col("ord").cast("bigint").alias("ord"), F.from_json("raw", _EXTERNAL).alias("x"))
    external = ext.select("graph_id", "ord", "x.id", "x.source", "x.target", "x.type", "x.description", _location(F.col("x.sourceLocation")).alias("source_location"))
    # key order is meaningful, which a map does not keep
    meta = d.select("graph_id", F.get_json_object("metadata", "$.domains").alias("domains"), F.get_json_object("metadata", "$.customTypes").alias("types"))
    named = meta.select("graph_id", F.posexplode(F.json_object_keys("domains")).alias("ord", "name"), F.from_json("domains", "map<string,struct<description:string,systemType:string>>").alias("m"))
    domains = named.select("graph_id", F.col("ord").cast("bigint").alias("ord"), "name", F.col("m")[F.col("name")]["description"].alias("description"), F.col("m")[F.col("name")]["systemType"].alias("system_type"))
    typed = meta.select("graph_id", F.posexplode(F.json_object_keys("types")).alias("ord", "name"), F.from_json("types", f"map<string,struct<description:string,requiredProperties:{_PROPERTIES},optionalProperties:{_PROPERTIES}>>").alias("m"))
    t = F.col("m")[F.col("name")]
    custom = typed.select("graph_id", F.col("ord").cast("bigint").alias("ord"), "name", t["description"].alias("description"), t["requiredProperties"].alias("required"), t["optionalProperties"].alias("optional"))
    return Graph(components, links, external, domains, custom, d.select("graph_id", "version", "metadata"))


_REQUIRED = {"UI": ["route"], "UseCase": [], "DomainOp": ["operationName"], "Event": ["eventName"], "EventHandler": ["subscribedEvents"], "Custom": ["customTypeName"]}
_REQUIRED_API = {"REST": ["httpMethod", "path"], "GraphQL": ["operationName"], "other": []}
_BASE = ["id", "type", "name", "domain", "module", "sourceLocation"]
_OPTIONAL = {"DomainOp": ["entity", "signature", "behavior", "stateChanges", "businessRules"], "Event": ["eventSchema"]}


def schema_errors(docs: DataFrame) -> DataFrame:
    """(graph_id, path, message): what a document lacks against the model; none for a document that holds to it."""
    d = docs.select("graph_id", F.from_json("value", _DOCUMENT, {"mode": "PERMISSIVE"}).alias("d"), F.from_json("value", "map<string,string>").alias("m"))
    say = lambda path, text, bad: F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(text).alias("message")))
    top = F.array_compact(F.array(
        say("", "must be a JSON object", F.col("m").isNull()), *(say("", f"must have required property '{k}'", F.col("m").isNotNull() & F.col("m")[k].isNull()) for k in ("version", "metadata", "components", "links")),
        say("/version", "must match pattern", ~F.col("m")["version"].rlike(r"^[0-9]+\.[0-9]+$")), say("/components", "must be array", F.col("m")["components"].isNotNull() & ~F.col("m")["components"].rlike(r"^\s*\[")), say("/links", "must be array", F.col("m")["links"].isNotNull() & ~F.col("m")["links"].rlike(r"^\s*\[")),
        say("/metadata", "must have required property 'domains'", F.col("m")["metadata"].isNotNull() & F.get_json_object(F.col("m")["metadata"], "$.domains").isNull()),
        say("/metadata/domains", "must NOT have fewer than 1 properties", F.size(F.json_object_keys(F.get_json_object(F.col("m")["metadata"], "$.domains"))) == 0),
    ))
    whole = d.select("graph_id", F.explode(top).alias("e")).select("graph_id", "e.*")
    c = d.select("graph_id", F.posexplode("d.components").alias("i", "raw")).select("graph_id", "i", F.from_json("raw", "map<string,string>").alias("m"), F.json_object_keys("raw").alias("keys"))
    m, kind = F.col("m"), F.col("m")["type"]
    at = F.concat(F.lit("/components/"), F.col("i").cast("string"))
    told = lambda bad, text: F.when(bad, F.struct(at.alias("path"), (text if isinstance(text, Column) else F.lit(text)).alias("message")))
    lacks = lambda k: m[k].isNull()
    checks = [told(m.isNull(), "must be object"), *(told(m.isNotNull() & lacks(k), f"must have required property '{k}'") for k in _BASE), *(told(m[k] == "", f"{k} must NOT have fewer than 1 characters") for k in ("id", "name", "domain", "module")), told(~kind.isin(*schema.COMPONENT_TYPES), "type must be equal to one of the allowed values")]
    checks += [told((kind == t) & lacks(k), f"must have required property '{k}'") for t, ks in _REQUIRED.items() for k in ks]
    checks += [told((kind == "API") & lacks("apiType"), "must have required property 'apiType'"), told((kind == "API") & ~m["apiType"].isin(*schema.API_TYPES), "apiType must be equal to one of the allowed values"), told((kind == "API") & ~m["httpMethod"].isin(*schema.HTTP_METHODS), "httpMethod must be equal to one of the allowed values")]
    checks += [told((kind == "API") & (m["apiType"] == t) & lacks(k), f"must have required property '{k}'") for t, ks in _REQUIRED_API.items() for k in ks]
    allowed = {t: [*_BASE, "description", *ks, *_OPTIONAL.get(t, [])] for t, ks in _REQUIRED.items() if t != "Custom"} | {"API": [*_BASE, "description", "apiType", "httpMethod", "path", "operationName"]}
    checks += [told((kind == t) & (F.size(F.array_except("keys", F.array(*map(F.lit, ks)))) > 0), "must NOT have additional properties") for t, ks in allowed.items()]
    line = F.get_json_object(m["sourceLocation"], "$.lineNumber").cast("double")
    checks += [told(m["sourceLocation"].isNotNull() & F.get_json_object(m["sourceLocation"], f"$.{k}").isNull(), f"sourceLocation must have required property '{k}'") for k in ("repository", "filePath")] + [told((line < 1) | (line != F.floor(line)), "lineNumber must be an integer >= 1")]
    parts = c.select("graph_id", F.explode(F.array_compact(F.array(*checks))).alias("e")).select("graph_id", "e.*")
    out = whole.union(parts)
    for key, place in (("links", "/links/"), ("externalLinks", "/externalLinks/")):
        x = d.select("graph_id", F.posexplode(f"d.{key}").alias("i", "raw")).select("graph_id", F.concat(F.lit(place), F.col("i").cast("string")).alias("path"), F.from_json("raw", "map<string,string>").alias("m"))
        bad = [F.when(F.col("m")[k].isNull() | (F.col("m")[k] == ""), F.lit(f"must have required property '{k}'")) for k in ("source", "target")] + [F.when(~F.col("m")["type"].isin(*schema.LINK_TYPES), F.lit("type must be equal to one of the allowed values"))]
        if key == "externalLinks":
            bad.append(F.when(F.col("m")["target"].isNotNull() & F.coalesce(F.get_json_object(F.col("m")["target"], "$.name") == "", F.lit(True)), F.lit("target must have required property 'name'")))
        out = out.union(x.select("graph_id", "path", F.explode(F.array_compact(F.array(*bad))).alias("message")))
    return out


def read_graphs(spark: SparkSession, path: str, *, check: bool = True) -> Graph:
    """Graphs of all files at a path or glob; with ``check``, documents against the model are an error that says why."""
    docs = documents(spark, path)
    if check:
        wrong = [f"{r['path'] or '/'}: {r['message']}" for r in schema_errors(docs).collect()]
        if wrong:
            raise GraphError("GRAPH_CORRUPTED", "Invalid graph document:\n" + "\n".join(wrong))
    return parse(docs)


def to_documents(graph: Graph, *, drop_empty: bool = False) -> DataFrame:
    """(graph_id, value): one JSON document per graph. ``drop_empty`` leaves out empty custom types and outside links.

    A document is one value, so a graph has to fit a row here; tables are the format for larger ones.
    """
    G = "graph_id"
    gather = lambda df, text: df.select(G, "ord", text.alias("j")).groupBy(G).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "j"))), lambda s: s["j"]), ",").alias("j"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    entry = lambda body: F.concat(quoted(F.col("name")), F.lit(":"), body)
    link = F.to_json(F.struct("id", "source", "target", "type", F.from_json("payload", "struct<type:string,schema:string>").alias("payload"), json_value("source_location").alias("sourceLocation")))
    ext = F.to_json(F.struct("id", "source", "target", "type", "description", json_value("source_location").alias("sourceLocation")))
    domain = entry(F.to_json(F.struct("description", F.col("system_type").alias("systemType"))))
    ctype = entry(F.to_json(F.struct("description", F.col("required").alias("requiredProperties"), F.col("optional").alias("optionalProperties"))))
    out = graph.graphs.select(G, "version", F.get_json_object("metadata", "$.sources").alias("s"))
    for name, df in (("c", gather(graph.components, F.coalesce("raw", component_json(None)))), ("l", gather(graph.links, link)), ("x", gather(graph.external_links, ext)), ("d", gather(graph.domains, domain)), ("t", gather(graph.custom_types, ctype))):
        out = out.join(df.withColumnRenamed("j", name), G, "left")
    part = lambda c: F.coalesce(c, F.lit(""))
    optional = lambda c, before, after: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit(before), c, F.lit(after))) if drop_empty else F.concat(F.lit(before), part(c), F.lit(after))
    text = F.concat(F.lit('{"version":'), quoted(F.col("version")), F.lit(',"metadata":{'), F.coalesce(F.concat(F.lit('"sources":'), "s", F.lit(",")), F.lit("")), F.lit('"domains":{'), part("d"), F.lit("}"), optional("t", ',"customTypes":{', "}"), F.lit('},"components":['), part("c"), F.lit('],"links":['), part("l"), F.lit("]"), optional("x", ',"externalLinks":[', "]"), F.lit("}"))
    return out.select(G, text.alias("value"))


def write_graphs(graph: Graph, path: str, *, drop_empty: bool = False) -> None:
    to_documents(graph, drop_empty=drop_empty).select("value").write.text(path)


def envelope(rows: DataFrame) -> dict:
    """A result as command lines show it."""
    return {"success": True, "data": [r.asDict(recursive=True) for r in rows.toLocalIterator()], "warnings": []}


def failure(error: GraphError) -> dict:
    return {"success": False, "error": {"code": error.code, "message": str(error), "suggestions": error.suggestions}}
