"""Extraction rules over a table of code declarations: predicates and rules given as plain dicts become Columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archweave.functions.text import glob_regex, transformed
from archweave.graph import GraphError
from archweave.plans.fixpoint import frontier

#: The built-in component types in the order they are tried, and what their extraction has to name.
BUILT_IN = ("api", "useCase", "domainOp", "event", "eventHandler", "ui")
REQUIRED_EXTRACT = {"api": ["apiType"], "event": ["eventName"], "eventHandler": ["subscribedEvents"], "domainOp": ["operationName"], "ui": ["route"]}
FINDS = {"classes": "class", "methods": "method", "functions": "function"}


def predicate(p: Mapping, prefix: str = "") -> Column:
    """A predicate as a Column over declarations; ``prefix`` reads the parent class's columns instead."""
    c = lambda name: F.col(prefix + name)
    (kind, arg), *more = p.items()
    if more:
        raise GraphError("INVALID_PREDICATE", f"One predicate at a time: {', '.join(p)}")
    if kind == "and":
        return reduce(lambda a, b: a & b, (predicate(x, prefix) for x in arg), F.lit(True))
    if kind == "or":
        return reduce(lambda a, b: a | b, (predicate(x, prefix) for x in arg), F.lit(False))
    if kind == "hasDecorator":
        names = [arg["name"]] if isinstance(arg["name"], str) else list(arg["name"])
        return F.coalesce(F.exists(c("decorators"), lambda d: d["name"].isin(*names) & (d["source"].eqNullSafe(arg["from"]) if "from" in arg else F.lit(True))), F.lit(False))
    if kind == "hasJSDoc":
        return F.coalesce(F.array_contains(c("jsdoc_tags"), arg["tag"]), F.lit(False))
    if kind == "extendsClass":
        return c("extends").eqNullSafe(arg["name"])
    if kind == "implementsInterface":
        return F.coalesce(F.exists(c("implements"), lambda i: i["text"] == arg["name"]), F.lit(False))
    if kind == "nameEndsWith":
        return F.coalesce(F.endswith(c("name"), F.lit(arg["suffix"])), F.lit(False))
    if kind == "nameMatches":
        return F.coalesce(c("name").rlike(arg["pattern"]), F.lit(False))
    if kind == "inClassWith":
        return (c("kind") == "method") & c("parent_class").isNotNull() & predicate(arg, "parent_")
    raise GraphError("INVALID_PREDICATE", f"Unknown predicate: {kind}")


def with_parents(declarations: DataFrame) -> DataFrame:
    """Methods get their class's columns as ``parent_*``; the join is on file and class name."""
    names = ("decorators", "jsdoc_tags", "extends", "implements", "name", "kind")
    parents = declarations.filter("kind = 'class'").select("file", F.col("name").alias("parent_class"), *(F.col(n).alias(f"parent_{n}") for n in names)).dropDuplicates(["file", "parent_class"])
    return declarations.join(parents, ["file", "parent_class"], "left").withColumn("parent_parent_class", F.lit(None).cast("string"))


def module_of(files: DataFrame, modules: list[Mapping]) -> DataFrame:
    """(file, module): the first module, in the order given, one of whose globs matches the path."""
    first = None
    for m in reversed(modules):
        hit = reduce(lambda a, b: a | b, (F.col("file").rlike(glob_regex(g)) for g in ([m["path"]] if isinstance(m["path"], str) else m["path"])))
        first = F.when(hit, m["name"]).otherwise(first if first is not None else F.lit(None).cast("string"))
    return files.select("file", (first if first is not None else F.lit(None).cast("string")).alias("module"))


def extract_components(declarations: DataFrame, modules: list[Mapping]) -> DataFrame:
    """Draft components (type, name, file, line, domain): per declaration every type of its module whose rule it meets,
    built-in types first, then custom ones; a type whose rule is ``notUsed`` finds nothing."""
    d = with_parents(declarations)
    found = []
    for at, m in enumerate(modules):
        earlier = [F.col("file").rlike(glob_regex(g)) for x in modules[:at] for g in ([x["path"]] if isinstance(x["path"], str) else x["path"])]
        own = [F.col("file").rlike(glob_regex(g)) for g in ([m["path"]] if isinstance(m["path"], str) else m["path"])]
        here = reduce(lambda a, b: a | b, own) & ~reduce(lambda a, b: a | b, earlier, F.lit(False))
        rules = [(t, m[t]) for t in BUILT_IN if t in m] + list(m.get("customTypes", {}).items())
        for place, (t, rule) in enumerate(rules):
            if rule.get("notUsed"):
                continue
            hit = here & (F.col("kind") == FINDS[rule["find"]]) & predicate(rule["where"])
            found.append(F.when(hit, F.struct(F.lit(place).alias("place"), F.lit(t).alias("type"), F.lit(m["name"]).alias("domain"))))
    none = F.lit(None).cast("struct<place:int,type:string,domain:string>")
    drafts = d.select("file", "ord", "name", "line", F.explode(F.array_compact(F.array(*(found or [none])))).alias("t"))
    return drafts.select("file", "t.place", "ord", "t.type", "name", "line", "t.domain")


def extracted(rule: Mapping) -> Column:
    """An extraction rule that needs the declaration alone; errors are raised where a row fails the rule."""
    (kind, arg), = rule.items()
    how = arg.get("transform", {}) if isinstance(arg, Mapping) else {}
    fail = lambda text: F.raise_error(F.lit(text)).cast("string")
    if kind == "literal":
        return F.lit(arg)
    if kind == "fromClassName":
        return transformed(F.when(F.col("kind") == "method", F.col("parent_class")).otherwise(F.col("name")), how)
    if kind == "fromMethodName":
        return transformed(F.col("name"), how)
    if kind == "fromFilePath":
        group, hit = int(arg["capture"]), F.col("file").rlike(arg["pattern"])
        return transformed(F.when(hit, F.regexp_extract("file", arg["pattern"], group)).otherwise(fail(f"Pattern does not match: {arg['pattern']}")), how)
    if kind == "fromDecoratorArg":
        d = F.get(F.filter("decorators", lambda x: x["name"] == arg["decorator"]) if "decorator" in arg else F.col("decorators"), F.lit(0))
        value = F.get(d["args"], F.lit(int(arg["position"]))) if "position" in arg else d["named_args"][arg["name"]]
        return transformed(F.coalesce(value, fail("Decorator argument not found")), how)
    if kind == "fromDecoratorName":
        name = F.get("decorators", F.lit(0))["name"]
        if mapping := arg.get("mapping"):
            name = F.coalesce(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))[name], name)
        return transformed(name, how)
    if kind == "fromMethodSignature":
        return F.struct(F.coalesce("parameters", F.array().cast("array<struct<name:string,type:string>>")).alias("parameters"), F.coalesce("return_type", F.lit("unknown")).alias("return_type"))
    if kind == "fromConstructorParams":
        return F.transform(F.coalesce("ctor_parameters", F.array().cast("array<struct<name:string,type:string>>")), lambda p: F.struct(p["name"].alias("name"), F.coalesce(p["type"], F.lit("unknown")).alias("type")))
    if kind == "fromParameterType":
        p = F.get("parameters", F.lit(int(arg["position"])))
        return transformed(F.when(p.isNull(), fail(f"No parameter at position {arg['position']}")).otherwise(F.coalesce(p["type"], F.lit("unknown"))), how)
    raise GraphError("INVALID_RULE", f"Unknown extraction rule: {kind}")


def base_classes(declarations: DataFrame) -> DataFrame:
    """(name, base, depth): every class with itself and the classes it extends, nearest first; cycles end."""
    classes = declarations.filter("kind = 'class'").groupBy("name").agg(F.min_by(F.regexp_replace("extends", "<.*$", ""), "ord").alias("extends"))
    start = classes.select("name", F.col("name").alias("base"), F.lit(0).cast("long").alias("depth"))
    up = classes.filter("extends IS NOT NULL").select(F.col("name").alias("base"), F.col("extends").alias("next"))
    return frontier(start, lambda new: new.join(up, "base").select("name", F.col("next").alias("base"), (F.col("depth") + 1).alias("depth")), ["name", "base"])


def property_values(declarations: DataFrame, property_: str, *, static: bool = False, transform: Mapping | None = None) -> DataFrame:
    """(name, value) per class: the literal of a property, the class's own or the nearest base's; transforms touch
    strings only."""
    own = declarations.filter("kind = 'class'").select(F.col("name").alias("base"), F.explode("properties").alias("p")).filter((F.col("p.name") == property_) & (F.coalesce("p.is_static", F.lit(False)) == static) & F.col("p.literal").isNotNull())
    near = base_classes(declarations).join(own, "base").groupBy("name").agg(F.min_by("p", "depth").alias("p"))
    value = F.when(F.col("p.literal_kind") == "string", transformed(F.col("p.literal"), transform or {})).otherwise(F.col("p.literal"))
    return near.select("name", value.alias("value"))


def generic_args(declarations: DataFrame, interface: str, position: int) -> DataFrame:
    """(name, types): the type argument of an interface that a class or its nearest base implements, unions spelt out."""
    own = declarations.filter("kind = 'class'").select(F.col("name").alias("base"), F.explode("implements").alias("i")).filter(F.col("i.base") == interface)
    near = base_classes(declarations).join(own, "base").groupBy("name").agg(F.min_by("i", "depth").alias("i"))
    arg = F.get("i.type_args", F.lit(position))
    return near.filter(arg.isNotNull()).select("name", F.transform(F.split(arg, r"\|"), lambda x: F.trim(x)).alias("types"))


def resolve_modules(modules: list[Mapping], load) -> list[dict]:
    """Modules with what they ``extend`` filled in: rules of the base where a module has none, custom types merged, the
    module's own first. ``load`` turns a source into a module; without a base all six built-in rules are needed."""
    out = []
    for m in modules:
        if source := m.get("extends"):
            base = load(source)
            merged = {**{t: base[t] for t in BUILT_IN if t in base}, **{k: v for k, v in m.items() if k != "extends"}}
            if custom := {**base.get("customTypes", {}), **m.get("customTypes", {})}:
                merged["customTypes"] = custom
        else:
            merged = dict(m)
        if missing := [t for t in BUILT_IN if t not in merged]:
            raise GraphError("MISSING_RULES", f"Module '{m['name']}' lacks rules: {', '.join(missing)}")
        out.append(merged)
    return out


def config_errors(config: Mapping) -> list[str]:
    """What is wrong with an extraction config; none for a good one."""
    out = []
    modules = config.get("modules")
    if not isinstance(modules, list) or not modules:
        return ["/modules: must be a non-empty array"]
    for i, m in enumerate(modules):
        at = f"/modules/{i}"
        out += [f"{at}: must have required property '{k}'" for k in ("name", "path") if not m.get(k)]
        for t, rule in [(t, m[t]) for t in BUILT_IN if t in m] + list(m.get("customTypes", {}).items()):
            if rule.get("notUsed"):
                continue
            out += [f"{at}/{t}: must have required property '{k}'" for k in ("find", "where") if k not in rule]
            if rule.get("find") not in (None, *FINDS):
                out.append(f"{at}/{t}/find: must be one of {', '.join(FINDS)}")
            if "where" in rule:
                try:
                    predicate(rule["where"])
                except (GraphError, KeyError, TypeError, ValueError) as e:
                    out.append(f"{at}/{t}/where: {e}")
            if "extract" in rule:
                out += [f"{at}/{t}/extract: must have required property '{k}'" for k in REQUIRED_EXTRACT.get(t, []) if k not in rule["extract"]]
    return out


def decorated(find: str, *names: str) -> dict:
    return {"find": find, "where": {"hasDecorator": {"name": list(names)}}}


#: The default conventions, by decorator.
CONVENTIONS = {
    "api": {"find": "methods", "where": {"inClassWith": {"hasDecorator": {"name": "APIContainer"}}}}, "useCase": decorated("classes", "UseCase"), "domainOp": {"find": "methods", "where": {"inClassWith": {"hasDecorator": {"name": "DomainOpContainer"}}}},
    "event": decorated("classes", "Event"), "eventHandler": {"find": "methods", "where": {"inClassWith": {"hasDecorator": {"name": "EventHandlerContainer"}}}}, "ui": decorated("classes", "UI"),
}
