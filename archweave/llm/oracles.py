"""DuckDB SQL for the operators that SQL can express, written from what each has to return.

The others rest on byte formats, vocabularies, trained models or a tree of markup that SQL lacks; tests hold those
against brute force, round trips and held-out labels.
"""

TOPK = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

#: Signs of an IBAN by country, in the registry's groups of one length.
_SIGNS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "IR IS TR", 27: "BF BI BJ CF CG CM DJ EG FR GA GR IT KM MC MG MR SM TD", 28: "AL AZ BY CI CY DO GQ GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in _SIGNS.items()) + ")\\b"
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "0.9", "mail|contact|kontakt|correo|courriel", "0.1"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "0.6", "host|server|address|login|adresse", "0.3"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", "0.8", "card|visa|credit|karte|carte|tarjeta", "0.2"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "0.7", "phone|call|tel|mobile|fax", "0.2"),
    "iban": (_IBAN, "0.8", "iban|bank|account|konto|compte|cuenta", "0.2"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "0.4", "ssn|social|security|tax", "0.4"),
}
_RAW = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {i} AS rank, {b} AS base, {more} AS more, '(?i)(?:{words})' AS words, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS p FROM d" for i, (k, (p, b, words, more)) in enumerate(_KINDS.items()))

PII = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), raw AS ({_RAW}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw WHERE len(m) > 0),
placed AS (
  SELECT doc_id, kind, rank, m[i] AS v, base, more, words, right(p[i], 40) || ' ' || left(p[i + 1], 40) AS near, regexp_replace(m[i], '[^0-9]', '', 'g') AS dg, replace(m[i], ' ', '') AS solid,
    CAST(list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS BIGINT) AS s FROM each
), scored AS (
  SELECT doc_id, kind, rank, s, s + length(v) AS e, base + CASE WHEN regexp_matches(near, words) THEN more ELSE 0 END AS score FROM placed
  WHERE CASE kind
    WHEN 'ip' THEN list_bool_and([len(ltrim(x, '0')) <= 3 AND CAST('0' || right(x, 3) AS INTEGER) <= 255 FOR x IN string_split(v, '.')])
    WHEN 'card' THEN len(dg) BETWEEN 14 AND 19 AND list_sum([CASE WHEN (len(dg) - j) % 2 = 0 THEN CAST(dg[j] AS INTEGER) WHEN CAST(dg[j] AS INTEGER) > 4 THEN 2 * CAST(dg[j] AS INTEGER) - 9 ELSE 2 * CAST(dg[j] AS INTEGER) END FOR j IN range(1, len(dg) + 1)]) % 10 = 0
    WHEN 'phone' THEN len(dg) BETWEEN 10 AND 15
    WHEN 'iban' THEN list_reduce([CAST(x AS BIGINT) FOR x IN string_split(array_to_string([CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END FOR c IN string_split(substr(solid, 5) || substr(solid, 1, 4), '')], ''), '')], lambda a, x: (a * 10 + x) % 97) = 1
    ELSE true END
), kept AS (SELECT * FROM scored WHERE rank < 4 OR score >= 0.6),
told AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < 4) AS base_spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans, string_agg(printf('%.2f', CAST(score AS DOUBLE)), ',' ORDER BY s, rank, e) AS scores
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN told ON told.doc_id = d.doc_id
"""

NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, chr(1))] ELSE list_distinct([w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, c.component_id = s.doc_id AS kept FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id
"""

MIX = """
WITH RECURSIVE n AS (SELECT coalesce(source, 'null') AS s, count(*) AS n FROM documents GROUP BY ALL),
t AS (SELECT *, greatest(2000, 4 * count(*) OVER ()) AS period, n ** 0.7 AS w FROM n),
f AS (SELECT *, w / sum(w) OVER () * period AS exact FROM t),
g AS (SELECT *, greatest(1, CAST(floor(exact) AS BIGINT)) AS low FROM f),
h AS (SELECT *, period - sum(low) OVER () AS spare, row_number() OVER (ORDER BY low - exact, s) AS turn FROM g),
k AS (SELECT s, n, CAST(period AS BIGINT) AS period, CAST(low + CASE WHEN turn <= spare THEN 1 ELSE 0 END AS BIGINT) AS share FROM h),
w AS (SELECT s, share, period, unnest(range(0, share)) AS j FROM k),
b AS (SELECT s, share, j, j * period // share AS release, ((j + 1) * period + share - 1) // share AS due FROM w),
a AS (SELECT list({'release': release, 'due': due, 'weight': -share, 's': s, 'j': j} ORDER BY release, due, -share, s) AS todo, max(due) AS period FROM b),
r AS (
  SELECT CAST(0 AS BIGINT) AS slot, [x FOR x IN todo IF x.release = 0] AS ready, [x FOR x IN todo IF x.release > 0] AS todo FROM a
  UNION ALL
  SELECT slot + 1, list_concat([x FOR x IN ready IF x.s <> p.s OR x.j <> p.j], [x FOR x IN todo IF x.release = slot + 1]), [x FOR x IN todo IF x.release > slot + 1]
  FROM (SELECT *, list_min([{'due': x.due, 'weight': x.weight, 's': x.s, 'j': x.j} FOR x IN ready]) AS p FROM r) WHERE slot + 1 < (SELECT period FROM a)
), slots AS (
  SELECT slot, p.s AS s, p.j AS j, p.due AS due FROM (SELECT slot, list_min([{'due': x.due, 'weight': x.weight, 's': x.s, 'j': x.j} FOR x IN ready]) AS p FROM r)
), dealt AS (
  SELECT documents.*, k.*, (row_number() OVER (PARTITION BY k.s ORDER BY md5(CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) - 1) // 32 AS block FROM documents JOIN k ON k.s = coalesce(source, 'null')
)
SELECT doc_id, text, lang, source, n_chars, d.s AS mix_source, block AS mix_block, block // d.share * d.period + slot AS mix_slot, block // d.share * d.period + b.release AS mix_release, block // d.share * d.period + slots.due AS mix_deadline
FROM dealt d JOIN slots ON slots.s = d.s AND slots.j = block % d.share JOIN b ON b.s = d.s AND b.j = slots.j
"""

ORACLES: dict[str, str] = {"op2_threshold_topk": TOPK, "op4_pii": PII, "op5_pfair_mix": MIX, "op10_minhash": NEAR}
