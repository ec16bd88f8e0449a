"""Scalar functions of the model as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from archweave.schema import COMPONENT_TYPES, HTTP_METHODS


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\s+", "-")


def component_id(domain: Column, module: Column, kind: Column, name: Column) -> Column:
    """domain:module:type:slug; the type in lower case, only the name slugged."""
    return F.concat_ws(":", domain, module, F.lower(kind), slug(name))


def id_name(id_: Column) -> Column:
    """The name part of an id with exactly four parts, else null."""
    parts = F.split(id_, ":")
    return F.when(F.size(parts) == 4, parts[3])


def trimmed(x: Column) -> Column:
    """White space of any kind off both ends; Spark's trim takes blanks only."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, ignoring case; two empty strings are alike, one alone is not."""
    x, y = F.lower(a), F.lower(b)
    most = F.greatest(F.length(x), F.length(y))
    return F.when(most == 0, 1.0).when(F.least(F.length(x), F.length(y)) == 0, 0.0).otherwise(1 - F.levenshtein(x, y) / most)


def canonical_type(raw: Column) -> Column:
    """The component type of that name, whatever its case, else null."""
    return F.create_map(*(F.lit(x) for t in COMPONENT_TYPES for x in (t.lower(), t)))[F.lower(raw)]


def valid_http_method(raw: Column) -> Column:
    return F.upper(raw).isin(*HTTP_METHODS)


def state_pair(raw: Column) -> Column:
    """``from:to`` as a struct, null unless there are exactly two parts; empty parts count."""
    p = F.split(raw, ":", -1)
    return F.when(F.size(p) == 2, F.struct(p[0].alias("from"), p[1].alias("to")))


def key_value(raw: Column) -> Column:
    """``key:value`` cut at the first colon, null without one."""
    at = F.instr(raw, ":")
    return F.when(at > 0, F.struct(F.substring(raw, F.lit(1), at - 1).alias("key"), F.substring(raw, at + 1, F.length(raw)).alias("value")))


def comma_list(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, ",", -1), trimmed), lambda x: x != "")


def new_only(incoming: Column, existing: Column) -> Column:
    """What is not there yet; repetitions within the incoming stay."""
    return F.filter(incoming, lambda x: ~F.exists(existing, lambda e: e.eqNullSafe(x)))


def edge_label(apis: Column, events: Column) -> Column:
    a, e = F.concat(apis.cast("string"), F.lit(" API")), F.concat(events.cast("string"), F.lit(" Event"))
    return F.when((apis > 0) & (events > 0), F.concat(a, F.lit(" · "), e)).when(apis > 0, a).when(events > 0, e)


def location_text(file: Column, line: Column) -> Column:
    return F.concat(file, F.when(line.isNotNull(), F.concat(F.lit(":"), line.cast("string"))).otherwise(""))


def truncate(x: Column, n: int) -> Column:
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.substring(x, 1, max(0, n - 2)), F.lit("...")))


def pluralize(n: Column, one: str, many: str | None = None) -> Column:
    return F.when(n == 1, one).otherwise(many or one + "s")


def editor_url(root: str, file: Column, line: Column) -> Column:
    return F.concat(F.lit(f"vscode://file/{root.removesuffix('/')}/"), file, F.lit(":"), line.cast("string"))


def code_url(host: str, org: str, repository: Column, branch: str, file: Column, line: Column) -> Column:
    return F.concat(F.lit(f"{host.removesuffix('/')}/{org}/"), repository, F.lit(f"/blob/{branch}/"), file, F.when(line.isNotNull(), F.concat(F.lit("#L"), line.cast("string"))).otherwise(""))


def edge_kind(target_type: Column) -> Column:
    return F.when(target_type == "Event", "event").otherwise("default")


def is_async(link_type: Column) -> Column:
    return F.coalesce(link_type == "async", F.lit(False))


def transformed(value: Column, how: Mapping[str, object]) -> Column:
    """Suffix and prefix off, case, kebab to Pascal, Pascal to kebab; always in this order, however ``how`` is ordered."""
    if (suffix := how.get("stripSuffix")) is not None:
        value = F.lit("") if suffix == "" else F.when(F.endswith(value, F.lit(suffix)), F.substring(value, F.lit(1), F.length(value) - len(str(suffix)))).otherwise(value)
    if prefix := how.get("stripPrefix"):
        value = F.when(F.startswith(value, F.lit(prefix)), F.substring(value, F.lit(len(str(prefix)) + 1), F.length(value))).otherwise(value)
    if how.get("toLowerCase"):
        value = F.lower(value)
    if how.get("toUpperCase"):
        value = F.upper(value)
    if how.get("kebabToPascal"):
        value = F.array_join(F.transform(F.split(value, "-"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), "")
    if how.get("pascalToKebab"):
        value = F.regexp_replace(F.lower(F.regexp_replace(value, "([A-Z])", "-$1")), "^-", "")
    return value


def glob_regex(glob: str) -> str:
    """A path glob as an anchored regular expression: ``**`` spans folders, ``*`` and ``?`` stay within one, braces choose."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + r"(?:(?!\.)[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i) and i + 2 == len(glob) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + r"(?:(?!\.)[^/]+/)*(?!\.)[^/]+", i + 2
            continue
        if c == "*":
            out += r"(?!\.)[^/]*" if i == 0 or glob[i - 1] == "/" else "[^/]*"
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]", end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"
