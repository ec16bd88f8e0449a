"""Checks of a graph: links that dangle, unknown custom types, and what merely looks wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archweave.graph import Graph
from archweave.operators.aggregate import G, orphans, unused_domains


def _error(path: Column, message: Column, code: str) -> list[Column]:
    return [F.col(G), path.alias("path"), message.alias("message"), F.lit(code).alias("code")]


def dangling_links(graph: Graph) -> DataFrame:
    ids = graph.components.select(G, "id").distinct()
    out = []
    for side in ("source", "target"):
        lost = graph.links.join(ids.withColumnRenamed("id", side), [G, side], "left_anti")
        place = F.concat(F.lit("/links/"), F.col("ord").cast("string"), F.lit(f"/{side}"))
        out.append(lost.select(*_error(place, F.concat(F.lit(f"Link references non-existent {side}: "), F.col(side)), f"INVALID_LINK_{side.upper()}")))
    return out[0].union(out[1])


def unknown_custom_types(graph: Graph) -> DataFrame:
    custom = graph.components.filter("type = 'Custom'")
    lost = custom.join(graph.custom_types.select(G, F.col("name").alias("custom_type_name")), [G, "custom_type_name"], "left_anti")
    place = F.concat(F.lit("/components/"), F.col("ord").cast("string"), F.lit("/customTypeName"))
    return lost.select(*_error(place, F.concat(F.lit("Custom type '"), F.col("custom_type_name"), F.lit("' is not defined in metadata.customTypes")), "INVALID_TYPE"))


def validate(graph: Graph) -> DataFrame:
    """Errors as (path, message, code); a graph without rows is valid."""
    return dangling_links(graph).union(unknown_custom_types(graph))


def warnings(graph: Graph) -> DataFrame:
    """(code, message, component_id, domain_name): components without any link, declared domains without components."""
    alone = orphans(graph, external=True).select(G, F.lit("ORPHAN_COMPONENT").alias("code"), F.concat(F.lit("Component '"), F.col("id"), F.lit("' has no incoming or outgoing links")).alias("message"), F.col("id").alias("component_id"), F.lit(None).cast("string").alias("domain_name"))
    unused = unused_domains(graph).select(G, F.lit("UNUSED_DOMAIN").alias("code"), F.concat(F.lit("Domain '"), F.col("name"), F.lit("' is declared but has no components")).alias("message"), F.lit(None).cast("string").alias("component_id"), F.col("name").alias("domain_name"))
    return alone.unionByName(unused)


def report(graph: Graph) -> DataFrame:
    """Errors and warnings together."""
    errors = validate(graph).select(G, F.lit("error").alias("level"), "code", "message")
    return errors.unionByName(warnings(graph).select(G, F.lit("warning").alias("level"), "code", "message"))


def is_consistent(graph: Graph) -> bool:
    return warnings(graph).isEmpty()
