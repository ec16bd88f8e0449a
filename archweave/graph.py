"""A graph bundle: six lazy DataFrames that share ``graph_id``, so one job answers for many graphs at once."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archweave import schema

TABLES = ("components", "links", "external_links", "domains", "custom_types", "graphs")


class GraphError(ValueError):
    """What a caller asked for cannot be: ``code`` says what, ``suggestions`` what might have been meant."""

    def __init__(self, code: str, message: str, suggestions: list[str] | None = None):
        super().__init__(message)
        self.code, self.suggestions = code, suggestions or []


@dataclass(frozen=True)
class Graph:
    components: DataFrame
    links: DataFrame
    external_links: DataFrame
    domains: DataFrame
    custom_types: DataFrame
    graphs: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.components.sparkSession

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        ddl = (schema.COMPONENTS, schema.LINKS, schema.EXTERNAL_LINKS, schema.DOMAINS, schema.CUSTOM_TYPES, schema.GRAPHS)
        return cls(*(spark.createDataFrame([], d) for d in ddl))

    def only(self, graph_id: str) -> Graph:
        return replace(self, **{t: getattr(self, t).filter(F.col("graph_id") == graph_id) for t in TABLES})

    def create_views(self, prefix: str = "") -> None:
        """Temp views, so that plain SQL works on the tables."""
        for t in TABLES:
            getattr(self, t).createOrReplaceTempView(prefix + t)

    def nodes(self) -> DataFrame:
        """The narrow side of most joins; of components that share an id, the last one stands."""
        last = self.components.groupBy("graph_id", "id").agg(F.max_by(F.struct("name", "type", "domain", "ord"), "ord").alias("c"))
        return last.select("graph_id", "id", "c.*")


def link_key(df: DataFrame) -> DataFrame:
    """A link goes by its id, or else by ``source->target``."""
    return df.withColumn("link_key", F.coalesce("id", F.concat("source", F.lit("->"), "target")))
