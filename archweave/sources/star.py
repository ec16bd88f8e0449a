"""A star schema of shops as an architecture graph: the projection that the correctness queries run on.

Customers are screens, orders APIs, parts operations, suppliers handlers, event types events, regions custom parts,
users operations with state changes. ``ord`` is computed from kind and keys, so no global numbering is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archweave import schema
from archweave.graph import Graph

KIND = 10**18
UNKNOWN_EVENT = "refund"


def _components(df: DataFrame, **columns: Column | str | None) -> DataFrame:
    kinds = {c: t for c, t, _ in schema.COMPONENT_FIELDS}
    own = {c: columns.get(c) for c in kinds}
    picked = [(F.lit(None) if v is None else v).cast(kinds[c]).alias(c) for c, v in own.items()]
    df = df.select(F.lit("star").alias("graph_id"), columns["ord"].cast("bigint").alias("ord"), *picked)
    return df.withColumn("raw", F.to_json(F.struct(*(c for c in kinds))))


def _location(table: str, key: Column) -> Column:
    none = lambda t: F.lit(None).cast(t)
    return F.struct(F.lit("shop").alias("repository"), F.concat(F.lit(f"{table}/"), key.cast("string")).alias("file_path"), none("int").alias("line_number"), none("int").alias("end_line_number"), none("string").alias("method_name"), none("string").alias("url"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    c, lit = F.col, F.lit
    key = lambda prefix, column: F.concat(lit(f"{prefix}:"), c(column).cast("string"))
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    customer, orders, part, supplier = t("customer"), t("orders"), t("part"), t("supplier")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    events = t("events").select("event_id", "ts", "user_id", "event_type")
    region = t("region")

    people = customer.join(nation, c("c_nationkey") == c("n_nationkey"))
    ui = _components(people, ord=c("c_custkey"), id=key("ui", "c_custkey"), type=lit("UI"), name=c("c_name"), domain=c("n_name"), module=c("c_mktsegment"), route=F.concat(lit("/customers/"), c("c_custkey")), source_location=_location("customer", c("c_custkey")))
    placed = orders.join(people.select("c_custkey", "n_name"), c("o_custkey") == c("c_custkey"))
    api = _components(
        placed, ord=lit(KIND) + c("o_orderkey"), id=key("api", "o_orderkey"), type=lit("API"), name=F.concat(lit("Order "), c("o_orderkey")), domain=c("n_name"), module=c("o_orderpriority"), api_type=lit("REST"),
        http_method=F.when(c("o_orderstatus") == "O", "POST").otherwise("GET"), path=F.concat(lit("/orders/"), c("o_orderstatus")), source_location=_location("orders", c("o_orderkey")),
    )
    rules = F.array(F.concat(lit("size "), F.floor(c("p_size") / 10).cast("string")), F.concat(lit("type "), c("p_type")))
    op = _components(part, ord=lit(2 * KIND) + c("p_partkey"), id=key("op", "p_partkey"), type=lit("DomainOp"), name=c("p_name"), domain=c("p_type"), module=c("p_brand"), operation_name=c("p_name"), entity=c("p_brand"), business_rules=rules, source_location=_location("part", c("p_partkey")))
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moves = events.withColumn("n", F.row_number().over(by_user)).withColumn("from", F.coalesce(F.lag("event_type").over(by_user), lit("*")))
    change = F.struct("n", F.struct("from", c("event_type").alias("to"), lit(None).cast("string").alias("trigger")).alias("x"))
    users = moves.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(change)), lambda s: s["x"]).alias("changes"))
    user = _components(users, ord=lit(3 * KIND) + c("user_id"), id=key("usr", "user_id"), type=lit("DomainOp"), name=F.concat(lit("user "), c("user_id")), domain=lit("users"), module=lit("events"), operation_name=F.concat(lit("act "), c("user_id")), entity=F.concat(lit("U"), c("user_id") % 50), state_changes=c("changes"), source_location=_location("events", c("user_id")))
    kinds = events.select("event_type").distinct()
    event = _components(kinds, ord=lit(4 * KIND) + F.ascii("event_type") * 256 + F.ascii(F.substring("event_type", 2, 1)), id=key("ev", "event_type"), type=lit("Event"), name=c("event_type"), domain=lit("events"), module=lit("stream"), event_name=c("event_type"), source_location=_location("events", c("event_type")))
    wanted = F.element_at(F.array(*(F.array(*map(lit, x)) for x in (("click", "purchase"), ("view", UNKNOWN_EVENT), ("signup", "error", "signup"), ("purchase",)))), (c("s_suppkey") % 4 + 1).cast("int"))
    sellers = supplier.join(nation, c("s_nationkey") == c("n_nationkey"))
    handler = _components(sellers, ord=lit(5 * KIND) + c("s_suppkey"), id=key("eh", "s_suppkey"), type=lit("EventHandler"), name=c("s_name"), domain=c("n_name"), module=lit("suppliers"), subscribed_events=wanted, source_location=_location("supplier", c("s_suppkey")))
    custom = _components(region, ord=lit(6 * KIND) + c("r_regionkey"), id=key("cu", "r_regionkey"), type=lit("Custom"), name=c("r_name"), domain=lit("regions"), module=lit("regions"), custom_type_name=F.when(c("r_regionkey") % 2 == 0, "Area").otherwise("Zone"), source_location=_location("region", c("r_regionkey")))
    components = ui.unionByName(api).unionByName(op).unionByName(user).unionByName(event).unionByName(handler).unionByName(custom)

    def links(df: DataFrame, kind: int, a: str, x: str, b: str, y: str, type_: Column) -> DataFrame:
        ord_ = lit(kind * KIND) + c(x).cast("bigint") * 10**9 + c(y)
        return df.select(lit("star").alias("graph_id"), ord_.cast("bigint").alias("ord"), lit(None).cast("string").alias("id"), key(a, x).alias("source"), key(b, y).alias("target"), type_.alias("type"), lit(None).cast("string").alias("payload"), lit(None).cast(schema.LOCATION).alias("source_location"))

    some = F.when(c("l_partkey") % 7 != 0, "sync")
    sold = lines.select("l_orderkey", "l_partkey").distinct()
    made = lines.select("l_partkey", "l_suppkey").distinct()
    near = sellers.join(region, c("n_regionkey") == c("r_regionkey"))
    gone = orders.filter("o_orderstatus = 'P'").withColumn("gone", c("o_orderkey") + 5 * 10**8)
    all_links = (
        links(orders, 1, "ui", "o_custkey", "api", "o_orderkey", lit("sync"))
        .unionByName(links(sold, 2, "api", "l_orderkey", "op", "l_partkey", some))
        .unionByName(links(made, 3, "op", "l_partkey", "eh", "l_suppkey", lit("async")))
        .unionByName(links(near, 4, "cu", "r_regionkey", "eh", "s_suppkey", lit("async")))
        .unionByName(links(gone, 5, "api", "o_orderkey", "op", "gone", lit("sync")))
    )
    target = F.struct(c("p_type").alias("name"), lit(None).cast("string").alias("domain"), lit(None).cast("string").alias("repository"), F.concat(lit("https://"), F.lower(F.regexp_replace("p_type", " ", "-")), lit(".example")).alias("url"))
    external = part.select(lit("star").alias("graph_id"), c("p_partkey").alias("ord"), lit(None).cast("string").alias("id"), key("op", "p_partkey").alias("source"), target.alias("target"), lit("async").alias("type"), lit(None).cast("string").alias("description"), lit(None).cast(schema.LOCATION).alias("source_location"))
    domains = nation.select(lit("star").alias("graph_id"), c("n_nationkey").cast("bigint").alias("ord"), c("n_name").alias("name"), F.concat(lit("Nation "), c("n_nationkey")).alias("description"), lit("domain").alias("system_type"))
    more = spark.createDataFrame([("star", 1000, "events", "Event stream", "other"), ("star", 1001, "idle", "Nothing here", "other")], schema.DOMAINS)
    types = spark.createDataFrame([("star", 0, "Area", "A region", {}, {})], schema.CUSTOM_TYPES)
    graphs = spark.createDataFrame([("star", "1.0", "{}")], schema.GRAPHS)
    return Graph(components, all_links, external, domains.unionByName(more), types, graphs)


def later(g: Graph) -> Graph:
    """The "after" of the comparison queries: APIs of pending orders gone, UIs of furniture buyers renamed, one part type moved."""
    c = F.col
    kept = g.components.filter("NOT (type = 'API' AND path = '/orders/P')")
    renamed = (c("type") == "UI") & (c("module") == "FURNITURE")
    kept = kept.withColumn("name", F.when(renamed, F.concat(c("name"), F.lit(" (moved)"))).otherwise(c("name"))).withColumn("domain", F.when((c("type") == "DomainOp") & (c("module") == "Brand#1"), F.lit("moved")).otherwise(c("domain")))
    kept = kept.withColumn("raw", F.to_json(F.struct(*(x for x, _, _ in schema.COMPONENT_FIELDS))))
    links = g.links.filter("NOT startswith(source, 'cu:')").withColumn("type", F.when(F.startswith("source", F.lit("op:")), "sync").otherwise(c("type")))
    return Graph(kept, links, g.external_links, g.domains, g.custom_types, g.graphs)
