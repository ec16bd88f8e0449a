"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Everything here is DataFrame functions; a document is one row throughout, so nothing is shuffled and no
group can grow hot. Patterns are written possessively, with a look-behind where a run of characters would
otherwise be tried from each of its positions: the matches are those of the plain pattern, found in time
linear in the text and without recursion, however long a run is.

Defined results: null text counts as empty; empty text has no spans; texts of any length are read whole;
repeated rows give repeated results; columns other than the id and text are not read, so clashing names
cannot matter. Ties between kinds at one start keep the order of ``KINDS``.
"""

from __future__ import annotations

from collections.abc import Callable
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before and after a span that count as nearby, up to the next span of its kind.
CONTEXT = 40
KEEP = 0.6

#: Signs of an IBAN by country.
IBAN_SIGNS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "IR IS TR", 27: "BF BI BJ CF CG CM DJ EG FR GA GR IT KM MC MG MR SM TD", 28: "AL AZ BY CI CY DO GQ GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
#: An IBAN has the length of its country and no letter or digit after it; codes without a length of their own have none.
IBAN = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_SIGNS.items()) + ")(?![A-Za-z0-9_])"

#: Pattern in Java's dialect, a cheap test that any match implies, base score, context words and
#: what they add. Email, ip, card and phone are the base kinds.
KINDS: dict[str, tuple[str, str, float, str, float]] = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|kontakt|correo|courriel", 0.1),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "host|server|address|login|adresse", 0.3),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", 0.8, "card|visa|credit|karte|carte|tarjeta", 0.2),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|call|tel|mobile|fax", 0.2),
    "iban": (IBAN, r"[A-Z]{2}[0-9]{2}", 0.8, "iban|bank|account|konto|compte|cuenta", 0.2),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]-[0-9]{2}-[0-9]", 0.4, "ssn|social|security|tax", 0.4),
}
BASE = ("email", "ip", "card", "phone")
#: Texts with more spans than this are cut by an array of their signs, so that time stays linear in the text.
MANY = 64
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"


def luhn(digits: Column) -> Column:
    """True where the digit string passes Luhn's checksum; meant for short strings."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """True where country and check digits, moved to the end, make the number 1 modulo 97 (letters count from A = 10)."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        value = F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c))) == 1


def confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(value, " ", ""))
    return F.lit(True)


def running(steps: Column, n: Column, both: Callable[[Column, Column], Column] = add) -> Column:
    """Running sums, or what else ``both`` makes of two numbers, of an array of ``n`` numbers from 0 on, by blocks of about sqrt(n) so that n spans cost n ** 1.5 at most.

    ``steps`` has to be a materialised column: it is named several times.
    """
    width = F.greatest(F.lit(32), F.ceil(F.sqrt(n)).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: both(x, y))
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), width)
    sums = F.transform(starts, lambda b: total(F.slice(steps, b + 1, width)))
    block = lambda b, off: F.transform(F.sequence(F.lit(1), F.least(width, n - b)), lambda i: both(off, total(F.slice(steps, b + 1, i))))
    carried = F.transform(sums, lambda s, k: struct_of(k, total(F.slice(sums, F.lit(1), k))))
    return F.when(n > 0, F.flatten(F.transform(carried, lambda c: block(c["k"] * width, c["off"])))).otherwise(F.array().cast("array<int>"))


def struct_of(k: Column, off: Column) -> Column:
    return F.struct(k.alias("k"), off.alias("off"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``spans`` = array<struct<start, rank, end, kind, value, score>> by start and kind.

    Offsets are code points, ends exclusive. A span's value and score are kept for redaction and review.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    df = df.select("*", *(F.when(F.contains("text", F.lit("@")) if k == "email" else F.col("text").rlike(gate), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}") for k, (p, gate, *_) in KINDS.items()))
    piece = lambda x: F.struct(F.length(x).alias("n"), F.right(x, F.lit(CONTEXT)).alias("tail"), F.left(x, F.lit(CONTEXT)).alias("head"))
    no_piece = F.array().cast("array<struct<n:int,tail:string,head:string>>")
    df = df.select("doc_id", *(f"m_{k}" for k in KINDS), *(F.when(F.size(f"m_{k}") > 0, F.transform(F.split("text", p, -1), piece)).otherwise(no_piece).alias(f"p_{k}") for k, (p, *_) in KINDS.items()))
    df = df.select("*", *(F.zip_with(f"m_{k}", F.slice(f"p_{k}", F.lit(1), F.size(f"m_{k}")), lambda v, x: x["n"] + F.length(v)).alias(f"s_{k}") for k in KINDS))
    df = df.select("*", *(running(F.col(f"s_{k}"), F.size(f"m_{k}")).alias(f"e_{k}") for k in KINDS))
    found = [spans_of(k, rank) for rank, k in enumerate(KINDS)]
    return df.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def spans_of(kind: str, rank: int) -> Column:
    _, _, base, words, more = KINDS[kind]
    m, p, e = F.col(f"m_{kind}"), F.col(f"p_{kind}"), F.col(f"e_{kind}")
    zipped = F.arrays_zip(m.alias("v"), e.alias("e"), F.slice(p, F.lit(1), F.size(m)).alias("b"), F.slice(p, F.lit(2), F.size(m)).alias("a"))

    def span(z: Column) -> Column:
        near = F.concat(z["b"]["tail"], F.lit(" "), z["a"]["head"]).rlike(f"(?i)(?:{words})")
        score = F.lit(base) + F.when(near, more).otherwise(0.0)
        return F.struct((z["e"] - F.length(z["v"])).alias("start"), F.lit(rank).alias("rank"), z["e"].alias("end"), F.lit(kind).alias("kind"), z["v"].alias("value"), F.round(score, 2).alias("score"))

    kept = F.transform(F.filter(zipped, lambda z: confirmed(kind, z["v"])), span)
    return F.filter(kept, lambda s: s["score"] >= KEEP) if kind not in BASE else kept


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and the list of all spans, per document."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = find_spans(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(count, BASE), F.sha2(text(F.filter("spans", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``find_spans`` replaced by ``<kind>``; all columns and rows stay, null texts stay null.

    Spans of several kinds that overlap become one mask, named after the first of them.
    """
    made = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    df = find_spans(made, "row", "text").select(F.col("doc_id").alias("row"), F.col("doc_id")[text_col].alias("text"), "spans")
    none = F.array().cast("array<string>")
    df = df.select("*", F.transform("spans", lambda s: s["end"]).alias("ends"), F.when(F.size("spans") > MANY, F.split("text", "")).otherwise(none).alias("signs"))
    df = df.select("*", running(F.col("ends"), F.size("ends"), F.greatest).alias("reach"))
    before = lambda i: F.coalesce(F.get("reach", i - 1), F.lit(0))
    opening = F.filter(F.transform("spans", lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), before(i).alias("from"))), lambda h: h["start"] >= h["from"])
    df = df.select("*", opening.alias("masks"), before(F.size("reach")).alias("rest"))

    def piece(start: Column, end: Column) -> Column:
        n = end - start
        return F.when(F.size("signs") > 0, F.array_join(F.slice("signs", start + 1, n), "")).otherwise(F.substring(F.col("text"), start + 1, n))

    woven = F.concat(F.array_join(F.transform("masks", lambda h: F.concat(piece(h["from"], h["start"]), F.lit("<"), h["kind"], F.lit(">"))), ""), piece(F.col("rest"), F.length("text")))
    text = F.when(F.size("spans") > 0, woven).otherwise(F.col("text"))
    return df.select(*((text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
