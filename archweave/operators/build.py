"""Building graphs in batches: each call takes a table of new rows, checks it as a set and returns a new Graph."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archweave import schema
from archweave.functions import text as T
from archweave.graph import Graph, GraphError
from archweave.operators import validate as V
from archweave.operators.aggregate import G

SHOWN = 20
MOST_SUGGESTIONS = 3


def grams(name: Column, threshold: float) -> Column:
    """Keys that two names share wherever their similarity reaches the threshold.

    Names at most (1 - threshold) of the longer one's signs apart share, of the m signs and the m - 1 pairs of signs of
    the longer one, at least m - (1 - threshold) m and m - 1 - 2 (1 - threshold) m. Where the second number is above
    nought they meet by pairs of signs; shorter names, and all if it never is, meet by signs as well.
    """
    rest = 1 - 2 * (1 - threshold)
    signs = F.filter(F.split(name, ""), lambda x: x != "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(2)))
    if rest <= 0:
        return F.array_distinct(signs)
    # the small surplus keeps a threshold's rounding from losing a pair at the edge
    short = F.length(name) * rest <= 1 + 1e-9
    return F.array_distinct(F.when(short, F.concat(signs, pairs)).otherwise(pairs))


def near_matches(components: DataFrame, queries: DataFrame, *, threshold: float = 0.6, limit: int = 10) -> DataFrame:
    """Fuzzy lookup of ``queries`` (query_id, name, type?, domain?) by the similarity of names, ``limit`` best each.

    Queries and components meet by the signs or pairs of signs that similar names cannot but share, an equi-join, and
    only those that meet are scored. A row is a match by score; ``mismatch`` says where a name that is equal but for
    case has another type or, failing that, domain. The threshold has to be above nought: at nought all is alike.
    """
    if not 0 < threshold <= 1:
        raise GraphError("INVALID_THRESHOLD", f"Threshold has to be above 0 and at most 1: {threshold}")
    q = queries.select("query_id", F.col("name").alias("q_name"), *(F.col(c).alias(f"q_{c}") if c in queries.columns else F.lit(None).cast("string").alias(f"q_{c}") for c in ("type", "domain"))).filter("q_name <> ''")
    c = components.select(G, "ord", "id", "name", "type", "domain").filter("name <> ''")
    keyed = lambda df, name: df.withColumn("gram", F.explode(grams(F.lower(name), threshold)))
    fits = F.least(F.length("q_name"), F.length("name")) >= F.greatest(F.length("q_name"), F.length("name")) * (threshold - 1e-9)
    met = keyed(q, "q_name").join(keyed(c, "name"), "gram").filter(fits).drop("gram").distinct()
    same = F.lower("q_name") == F.lower("name")
    kind = F.when(same & F.col("q_type").isNotNull() & (F.col("q_type") != F.col("type")), "type").when(same & F.col("q_domain").isNotNull() & (F.col("q_domain") != F.col("domain")), "domain")
    scored = met.withColumns({"score": T.similarity(F.col("q_name"), F.col("name")), "mismatch": kind}).filter(F.col("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query_id", "rank", G, "id", "name", "type", "domain", "score", "mismatch")


def suggestions(components: DataFrame, name: str) -> list[str]:
    q = components.sparkSession.createDataFrame([("q", name)], "query_id string, name string")
    return [r["id"] for r in near_matches(components, q, limit=MOST_SUGGESTIONS).orderBy("rank").collect()]


def not_found(graph: Graph, id_: str) -> GraphError:
    """The error for a missing component: an id of another shape than four parts is the error then."""
    parts = id_.split(":")
    if len(parts) != 4:
        return GraphError("INVALID_COMPONENT_ID", f"Invalid component id: {id_}")
    return GraphError("COMPONENT_NOT_FOUND", f"Component '{id_}' not found", suggestions(graph.components, parts[3]))


def _refuse(rows: DataFrame, column: str, code: str, text: str) -> None:
    found = [r[0] for r in rows.select(column).limit(SHOWN).collect()]
    if found:
        raise GraphError(code, f"{text}: {', '.join(map(str, found))}")


def _full(df: DataFrame, ddl: str, spark: SparkSession, *more: str) -> DataFrame:
    """Columns of a table in its types, absent ones null, and ``more`` as they are."""
    fields = spark.createDataFrame([], ddl).schema.fields
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields), *more)


@dataclass(frozen=True)
class Builder:
    graph: Graph
    sources: tuple[Mapping[str, str], ...]
    graph_id: str = "graph"

    @classmethod
    def new(cls, spark: SparkSession, sources: list[Mapping[str, str]], domains: Mapping[str, Mapping[str, str]], *, graph_id: str = "graph") -> Builder:
        if not sources:
            raise GraphError("MISSING_SOURCES", "At least one source is required")
        if not domains:
            raise GraphError("MISSING_DOMAINS", "At least one domain is required")
        g = Graph.empty(spark)
        own = spark.createDataFrame([(graph_id, i, n, d["description"], d["system_type"]) for i, (n, d) in enumerate(domains.items())], schema.DOMAINS)
        return cls(replace(g, domains=own), (), graph_id)._sourced(tuple(sources))

    @classmethod
    def resume(cls, graph: Graph, graph_id: str) -> Builder:
        """Go on with a graph that was read, which has to name its sources."""
        row = graph.graphs.filter(F.col("graph_id") == graph_id).select("metadata").first()
        sources = json.loads(row["metadata"] or "{}").get("sources") if row else None
        if not sources:
            raise GraphError("MISSING_SOURCES", "At least one source is required")
        return cls(graph.only(graph_id), tuple(sources), graph_id)

    def _sourced(self, sources: tuple[Mapping[str, str], ...]) -> Builder:
        """Sources are given one by one and are few; they live in the graph's metadata."""
        told = [{k: s[k] for k in ("repository", "commit", "extractedAt") if s.get(k)} for s in sources]
        row = self.spark.createDataFrame([(self.graph_id, "1.0", json.dumps({"sources": told}))], schema.GRAPHS)
        return replace(self._with(graphs=row), sources=sources)

    @property
    def spark(self) -> SparkSession:
        return self.graph.spark

    def _with(self, **tables: DataFrame) -> Builder:
        return replace(self, graph=replace(self.graph, **tables))

    def _numbered(self, df: DataFrame, table: DataFrame) -> DataFrame:
        """Rows get places after those there are; a batch with its own ``ord`` keeps that order."""
        top = table.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
        place = F.col("ord") if "ord" in df.columns else F.monotonically_increasing_id()
        return df.withColumn("ord", place + top).withColumn(G, F.lit(self.graph_id))

    def add_source(self, repository: str, commit: str | None = None) -> Builder:
        return self._sourced((*self.sources, {"repository": repository, "commit": commit or ""}))

    def add_domains(self, rows: DataFrame) -> Builder:
        """(name, description, system_type); a name that is there, or twice in the batch, is refused."""
        _refuse(rows.filter(~F.col("system_type").isin(*schema.SYSTEM_TYPES)), "system_type", "INVALID_SYSTEM_TYPE", "Unknown system types")
        both = rows.select("name").union(self.graph.domains.select("name"))
        _refuse(both.groupBy("name").count().filter("count > 1"), "name", "DUPLICATE_DOMAIN", "Domains exist")
        return self._with(domains=self.graph.domains.unionByName(_full(self._numbered(rows, self.graph.domains), schema.DOMAINS, self.spark)))

    def define_custom_types(self, rows: DataFrame) -> Builder:
        both = rows.select("name").union(self.graph.custom_types.select("name"))
        _refuse(both.groupBy("name").count().filter("count > 1"), "name", "CUSTOM_TYPE_ALREADY_DEFINED", "Custom types exist")
        return self._with(custom_types=self.graph.custom_types.unionByName(_full(self._numbered(rows, self.graph.custom_types), schema.CUSTOM_TYPES, self.spark)))

    def add_components(self, rows: DataFrame, *, properties: str | None = None) -> Builder:
        """Components of any type. Ids are made from domain, module, type and name; ``properties`` names a
        map<string,string> column with the own properties of custom components, which may overwrite even id and type."""
        g = self.graph
        rows = rows.withColumn("id", T.component_id(F.col("domain"), F.col("module"), F.col("type"), F.col("name")))
        _refuse(rows.filter(~F.col("type").isin(*schema.COMPONENT_TYPES)), "type", "INVALID_COMPONENT_TYPE", "Unknown component types")
        _refuse(rows.join(g.domains.select(F.col("name").alias("domain")), "domain", "left_anti"), "domain", "DOMAIN_NOT_FOUND", "Domains do not exist")
        if "custom_type_name" in rows.columns:
            custom = rows.filter("type = 'Custom'")
            _refuse(custom.join(g.custom_types.select(F.col("name").alias("custom_type_name")), "custom_type_name", "left_anti"), "custom_type_name", "CUSTOM_TYPE_NOT_FOUND", "Custom types do not exist")
            given = F.map_keys(F.col(properties)) if properties else F.array().cast("array<string>")
            needed = custom.join(g.custom_types.select(F.col("name").alias("custom_type_name"), F.map_keys("required").alias("needed")), "custom_type_name")
            missing = needed.select("id", F.array_except(F.coalesce("needed", F.array().cast("array<string>")), F.coalesce(given, F.array().cast("array<string>"))).alias("missing"))
            _refuse(missing.filter(F.size("missing") > 0), "id", "MISSING_REQUIRED_PROPERTIES", "Required properties are missing")
        if properties:
            for field in ("id", "type"):
                rows = rows.withColumn(field, F.coalesce(F.col(properties)[field], F.col(field)))
        _refuse(rows.select("id").union(g.components.select("id")).groupBy("id").count().filter("count > 1"), "id", "DUPLICATE_COMPONENT", "Components exist")
        full = _full(self._numbered(rows, g.components), schema.COMPONENTS, self.spark, *([properties] if properties else []))
        full = full.withColumn("raw", component_json(F.col(properties) if properties else None)).select(g.components.columns)
        return self._with(components=g.components.unionByName(full))

    def link(self, rows: DataFrame) -> Builder:
        """(source, target, type?, id?): the source has to exist, the target may come later; nothing is merged."""
        lost = rows.join(self.graph.components.select(F.col("id").alias("source")), "source", "left_anti").select("source").limit(1).collect()
        if lost:
            raise not_found(self.graph, lost[0]["source"])
        return self._with(links=self.graph.links.unionByName(_full(self._numbered(rows, self.graph.links), schema.LINKS, self.spark)))

    def link_external(self, rows: DataFrame) -> Builder:
        lost = rows.join(self.graph.components.select(F.col("id").alias("source")), "source", "left_anti").select("source").limit(1).collect()
        if lost:
            raise not_found(self.graph, lost[0]["source"])
        return self._with(external_links=self.graph.external_links.unionByName(_full(self._numbered(rows, self.graph.external_links), schema.EXTERNAL_LINKS, self.spark)))

    def enrich(self, patches: DataFrame) -> Builder:
        """(id, entity?, signature?, state_changes?, business_rules?, behavior?) on operations: entity and signature
        overwrite, the rest adds what is new. One row per id."""
        c = self.graph.components
        lost = patches.join(c.select("id"), "id", "left_anti").select("id").limit(1).collect()
        if lost:
            raise not_found(self.graph, lost[0]["id"])
        _refuse(c.filter("type <> 'DomainOp'").join(patches.select("id"), "id", "left_semi"), "id", "INVALID_ENRICHMENT_TARGET", "Only operations can be enriched")
        p = _full(patches.withColumn(G, F.lit(self.graph_id)), schema.COMPONENTS, self.spark).select("id", F.struct("entity", "signature", "state_changes", "business_rules", "behavior").alias("p"))
        # an absent list stays absent unless the patch brings one
        more = lambda old, new: F.when(new.isNull(), old).otherwise(F.concat(F.coalesce(old, F.array().cast("array<string>")), T.new_only(new, F.coalesce(old, F.array().cast("array<string>")))))
        none = F.array().cast(schema.CHANGES)
        changes = F.when(F.col("p.state_changes").isNull(), F.col("state_changes")).otherwise(F.concat(F.coalesce("state_changes", none), T.new_only(F.col("p.state_changes"), F.coalesce("state_changes", none))))
        behavior = F.when(F.col("p.behavior").isNull(), F.col("behavior")).otherwise(F.struct(*(more(F.col(f"behavior.{k}"), F.col(f"p.behavior.{k}")).alias(k) for k in ("reads", "validates", "modifies", "emits"))))
        new = {"entity": F.coalesce("p.entity", "entity"), "signature": F.coalesce("p.signature", "signature"), "state_changes": changes, "business_rules": more(F.col("business_rules"), F.col("p.business_rules")), "behavior": behavior}
        out = c.join(p, "id", "left").withColumns(new).select(c.columns)
        return self._with(components=out.withColumn("raw", F.when(F.col("type") == "DomainOp", component_json(None)).otherwise(F.col("raw"))))

    def validate(self) -> DataFrame:
        return V.validate(self.graph)

    def build(self) -> Graph:
        """The graph, if it has no errors; else one error that tells them all."""
        errors = [r["message"] for r in self.validate().select("message").collect()]
        if errors:
            raise GraphError("BUILD_VALIDATION", "Validation failed: " + "; ".join(errors))
        return self.graph


def component_json(properties: Column | None) -> Column:
    """A component as JSON with the document's own key names, absent fields left out."""
    named = F.struct(*(json_value(c).alias(k) for c, _, k in schema.COMPONENT_FIELDS))
    text = F.to_json(named)
    if properties is None:
        return text
    more = F.to_json(properties)
    return F.when(F.size(properties) > 0, F.concat(F.regexp_replace(text, r"\}$", ","), F.substring(more, F.lit(2), F.length(more)))).otherwise(text)


def json_value(column: str) -> Column:
    """A column with its nested fields under the document's key names."""
    c = F.col(column)
    if column == "source_location":
        return F.when(c.isNotNull(), F.struct(c["repository"].alias("repository"), c["file_path"].alias("filePath"), c["line_number"].alias("lineNumber"), c["end_line_number"].alias("endLineNumber"), c["method_name"].alias("methodName"), c["url"].alias("url")))
    if column == "signature":
        return F.when(c.isNotNull(), F.struct(c["parameters"].alias("parameters"), c["return_type"].alias("returnType")))
    return c
