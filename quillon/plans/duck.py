"""DuckDB twins: one chain of common table expressions from `part` to matches, of which each query reads what it needs."""

from __future__ import annotations

from ..functions import vocabulary as V
from ..sources import fixture


def in_list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def leet(x: str) -> str:
    for d, c in (("1", "l"), ("0", "o")):
        for _ in range(2):
            x = rf"regexp_replace({x}, '([a-zA-Z]){d}([a-zA-Z])', '\1{c}\2', 'g')"
        x = rf"regexp_replace(regexp_replace({x}, '([a-zA-Z]){d}\b', '\1{c}', 'g'), '\b{d}([a-zA-Z])', '{c}\1', 'g')"
    return x


def collapse(x: str) -> str:
    return rf"list_reduce(list_prepend({x}, regexp_extract_all({x}, '\b([a-z])\.(?:\s*([a-z])\.?)+')), lambda s, m: replace(s, m, replace(replace(m, '.', ''), ' ', '')))"


def mapped(x: str, table: dict[str, str]) -> str:
    for word, to in table.items():
        x = rf"regexp_replace({x}, '\b{word}\b', '{to}', 'g')"
    return x


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def as_set(x: str) -> str:
    return f"list_sort(list_distinct({x}))"


def strip_legal(x: str) -> str:
    return squeeze(rf"regexp_replace(lower({x}), '\b({V.LEGAL_WORDS})\b', '', 'g')")


def skeleton(w: str) -> str:
    s = f"regexp_replace(lower({w}), '[^a-z0-9]', '', 'g')"
    plain = s
    for a, b in (("sh", "s"), ("ph", "f"), ("ch", "k")):
        s = f"replace({s}, '{a}', '{b}')"
    s = rf"replace(regexp_replace({s}, 'c([eiy])', 's\1', 'g'), 'c', 'k')"
    for a, b in (("q", "k"), ("x", "ks"), ("z", "s"), ("v", "w"), ("b", "w")):
        s = f"replace({s}, '{a}', '{b}')"
    s = rf"regexp_replace({s}, 'm([tdks])', 'n\1', 'g')"
    for ch in "abcdefghijklmnopqrstuvwxyz0123456789":
        s = f"regexp_replace({s}, '{ch}+', '{ch}', 'g')"
    return f"CASE WHEN length({plain}) <= 2 THEN {plain} ELSE {s}[1:1] || regexp_replace({s}[2:], '[aeiouy]', '', 'g') END"


def grams(x: str) -> str:
    return as_set(f"list_transform(range(1, greatest(length({x}) - 1, 1)), lambda i: substr({x}, i, 3))")


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0::DOUBLE END"


def token_sort(x: str) -> str:
    return rf"array_to_string(list_sort(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')), ' ')"


NORM_NAME = squeeze(mapped(rf"regexp_replace({collapse(f'strip_accents(trim(lower({leet("business_name")})))')}, '[^\w\s]', ' ', 'g')", dict.fromkeys(V.LEGAL_FORMS, "corp")))
NORM_ADDRESS = squeeze(mapped(rf"regexp_replace({collapse(f'strip_accents(trim(lower({leet("business_address")})))')}, '[^\w\s]', ' ', 'g')", V.ADDRESS_MAP))
BRAND = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(norm_name), '\b({V.HONORIFICS})\b', ' ', 'g'), '\b({V.BRAND_ENDINGS})\b', ' ', 'g'), '[^a-z0-9]', '', 'g'), '^({V.BRAND_PREFIX})', '')"
UNITS = rf"'\b({V.UNIT_WORDS})\s*[:#-]?\s*(\d+[a-z]?)'"
WORDED = rf"'(?i)\b(?:{V.NUMBER_WORDS})\s*[:#-]?\s*(\d+[0-9a-zA-Z\-/]*)'"
TRAILING = rf"'(?i)\b(\d+\s*(?:{V.NUMBER_TAIL})?)\s*$'"
PARTS = "list_filter(list_transform(string_split({0}, ','), lambda p: trim(p)), lambda p: p <> '')"


def cut(c: str, found: str) -> str:
    return f"(substr({c}, 1, strpos({c}, {found}) - 1) || substr({c}, strpos({c}, {found}) + length({found})))"


def cte(caps: dict[str, int] = V.POSTING_CAPS) -> str:
    return rf"""
WITH ent AS ({fixture.ENT_SQL.format(part="part")}),
truth AS ({fixture.TRUTH_SQL.format(part="part")}),
tp AS (SELECT source1_entity_id AS s1_id, unnest(list_filter(list_transform(string_split(matched_entity_ids, ','), lambda x: trim(x)), lambda x: x <> '' AND x <> 'nan')) AS cid FROM truth),
n0 AS (SELECT *, split_part(entity_id, '-', 1) AS source, {NORM_NAME} AS norm_name, {NORM_ADDRESS} AS norm_address FROM ent),
n1 AS (SELECT *, {as_set(rf"list_filter(string_split_regex(norm_name, '\s+'), lambda t: length(t) >= 3 AND t NOT IN ({in_list(V.STOPWORDS)}))")} AS sig_tokens, {strip_legal("norm_name")} AS stripped_name,
  CASE WHEN length({BRAND}) >= 5 THEN {BRAND} ELSE '' END AS compact_brand,
  regexp_extract_all(lower(business_address), {UNITS}, 1) AS u1, regexp_extract_all(lower(business_address), {UNITS}, 2) AS u2,
  {as_set(rf"list_filter(string_split_regex(norm_address, '\s+'), lambda t: regexp_full_match(t, '[a-z]{{6,}}') AND t NOT IN ({in_list(V.ADDRESS_STOPWORDS)}))")} AS addr_tokens,
  list_filter(regexp_extract_all(business_address, '\d+'), lambda n: length(n) BETWEEN 2 AND 6) AS digits,
  {as_set(r"regexp_extract_all(lower(business_address), '\b[a-zA-Z]-?\d{1,4}\b')")} AS house_codes,
  {grams("norm_name")} AS c3_name, {grams("norm_address")} AS c3_addr,
  regexp_extract(trim(business_address), '\b\d{{5,6}}\b') AS postcode, trim(regexp_replace(trim(business_address), '\b\d{{5,6}}\b', '', 'g')) AS rest FROM n0),
n2 AS (SELECT *, list_filter(string_split_regex(stripped_name, '\s+'), lambda t: t NOT IN ({in_list(V.STOPWORDS)}) AND regexp_full_match(t, '[a-z]+')) AS own,
  {as_set(f"list_transform(sig_tokens, lambda w: {skeleton('w')})")} AS phonetic,
  {as_set("list_transform(range(1, len(u1) + 1), lambda i: u1[i] || '_' || regexp_replace(u2[i], '^0+', ''))")} AS unit_keys,
  {as_set("list_concat(digits, list_filter(list_transform(digits, lambda n: regexp_replace(n, '^0+', '')), lambda n: length(n) >= 2))")} AS addr_nums,
  regexp_extract(rest, {WORDED}) AS worded, regexp_extract(rest, '(?i)^(\d+\s*(?:{V.NUMBER_TAIL})?)\b') AS lead0, coalesce({PARTS.format("rest")}[1], '') AS first_part FROM n1),
n3 AS (SELECT *, CASE WHEN len(own) >= 2 AND length(array_to_string(list_transform(own, lambda t: t[1]), '')) BETWEEN 2 AND 6 THEN [array_to_string(list_transform(own, lambda t: t[1]), '')]
    WHEN len(own) = 1 AND length(own[1]) BETWEEN 2 AND 5 THEN own ELSE []::VARCHAR[] END AS acronyms,
  CASE WHEN regexp_matches(substr(rest, length(lead0) + 1), '(?i)^\s*(?:{V.STREET_WORDS})\b') THEN regexp_extract(lead0, '^\d+') ELSE lead0 END AS lead, regexp_extract(first_part, {TRAILING}) AS tail FROM n2),
n4 AS (SELECT *, trim(lower(CASE WHEN worded <> '' THEN regexp_extract(rest, {WORDED}, 1) WHEN lead <> '' THEN lead WHEN tail <> '' THEN tail ELSE '' END)) AS number,
  CASE WHEN worded <> '' THEN {cut("rest", "worded")} WHEN lead <> '' THEN trim(substr(rest, length(lead) + 1), ', ') WHEN tail <> '' THEN array_to_string(list_prepend(trim({cut("first_part", "tail")}), {PARTS.format("rest")}[2:]), ', ') ELSE rest END AS left_ FROM n3),
n5 AS (SELECT *, {PARTS.format("left_")} AS pts FROM n4),
n6 AS (SELECT *, CASE WHEN len(pts) > 1 THEN lower(pts[len(pts)]) ELSE '' END AS locality, lower(CASE WHEN len(pts) > 1 THEN array_to_string(pts[:len(pts) - 1], ', ') ELSE coalesce(pts[1], '') END) AS street FROM n5),
rec AS (SELECT *, {as_set(rf"list_filter(string_split_regex(regexp_replace(locality, '[^\w\s]', ' ', 'g'), '\s+'), lambda t: length(t) >= 3 AND t NOT IN ({in_list(V.STOPWORDS)}))")} AS loc_tokens FROM n6),
k0 AS (SELECT entity_id, source, country, 'T' AS key_type, unnest(sig_tokens) AS key FROM rec UNION ALL SELECT entity_id, source, country, 'N', unnest(addr_nums) FROM rec
  UNION ALL SELECT entity_id, source, country, 'H', unnest(house_codes) FROM rec UNION ALL SELECT entity_id, source, country, 'A', unnest(acronyms) FROM rec
  UNION ALL SELECT entity_id, source, country, 'PH', unnest(phonetic) FROM rec UNION ALL SELECT entity_id, source, country, 'UK', unnest(unit_keys) FROM rec
  UNION ALL SELECT entity_id, source, country, 'AT', unnest(addr_tokens) FROM rec UNION ALL SELECT entity_id, source, country, 'CB', compact_brand[1:8] FROM rec WHERE compact_brand <> ''
  UNION ALL SELECT entity_id, source, country, 'P', norm_name[1:3] FROM rec WHERE length(norm_name) >= 3
  UNION ALL SELECT entity_id, source, country, 'CB', t[1:8] FROM (SELECT entity_id, source, country, unnest(sig_tokens) AS t FROM rec WHERE source = 'S1') WHERE length(t) >= 5),
keys AS (SELECT DISTINCT entity_id, source, country, key_type, key FROM k0),
posts AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY country, key_type, key) AS n FROM keys WHERE source <> 'S1') WHERE n <= CASE key_type WHEN 'P' THEN {caps["P"]} WHEN 'AT' THEN {caps["AT"]} ELSE {caps["default"]} END),
cand AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cid FROM keys a JOIN posts b USING (country, key_type, key) WHERE a.source = 'S1'),
cheap AS (SELECT c.s1_id, c.cid, a.country, {jaccard("a.sig_tokens", "b.sig_tokens")} AS ntj, {jaccard("a.c3_name", "b.c3_name")} AS nc3, CASE WHEN a.stripped_name = b.stripped_name AND a.stripped_name <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lex,
  CASE WHEN list_has_any(a.acronyms, b.acronyms) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS acr,
  CASE WHEN a.number <> '' AND b.number <> '' THEN CASE WHEN a.number = b.number THEN 1.0::DOUBLE ELSE (-1.0)::DOUBLE END ELSE 0.0::DOUBLE END AS nsm, CASE WHEN a.number = '' OR b.number = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mnm,
  CASE WHEN a.postcode <> '' AND b.postcode <> '' THEN CASE WHEN a.postcode = b.postcode THEN 1.0::DOUBLE WHEN a.postcode[1:3] = b.postcode[1:3] THEN 0.5::DOUBLE ELSE (-1.0)::DOUBLE END ELSE 0.0::DOUBLE END AS pcm,
  CASE WHEN a.postcode = '' OR b.postcode = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mpc, {jaccard("a.loc_tokens", "b.loc_tokens")} AS ljc, {jaccard("a.c3_addr", "b.c3_addr")} AS ac3,
  CASE WHEN a.norm_address = '' OR b.norm_address = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mad, abs(length(a.norm_name) - length(b.norm_name)) / greatest(length(a.norm_name), length(b.norm_name), 1) AS nld,
  CASE WHEN len(a.unit_keys) > 0 AND len(b.unit_keys) > 0 THEN CASE WHEN list_has_any(a.unit_keys, b.unit_keys) THEN 1.0::DOUBLE ELSE (-1.0)::DOUBLE END ELSE 0.0::DOUBLE END AS ukm,
  CASE WHEN a.compact_brand = b.compact_brand AND a.compact_brand <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cbm,
  CASE WHEN a.postcode = '' OR b.postcode = '' THEN 0.0::DOUBLE WHEN a.postcode = b.postcode THEN 1.0::DOUBLE WHEN a.postcode[1:3] = b.postcode[1:3] THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS code,
  CASE WHEN list_has_any(a.house_codes, b.house_codes) OR list_has_any(a.addr_tokens, b.addr_tokens) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM cand c JOIN rec a ON c.s1_id = a.entity_id JOIN rec b ON c.cid = b.entity_id),
sc AS (SELECT s1_id, cid, country, round(0.4::DOUBLE * ntj + 0.3::DOUBLE * nc3 + 0.15::DOUBLE * ac3 + 0.15::DOUBLE * greatest(nsm, 0.0::DOUBLE), 6) AS p FROM cheap),
prim AS (SELECT * FROM sc WHERE p >= CASE country WHEN 'US' THEN 0.5::DOUBLE WHEN 'India' THEN 0.45::DOUBLE ELSE 0.4::DOUBLE END),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY p DESC, s1_id) AS k FROM prim) WHERE k = 1),
matches AS (SELECT * FROM (SELECT s1_id, cid, p, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cid) AS INTEGER) AS rank FROM won) WHERE rank <= 12),
s1 AS (SELECT entity_id AS s1_id, country FROM ent WHERE entity_id LIKE 'S1-%'),
said AS (SELECT m.s1_id, count(*) AS n_pred, count(tp.cid) AS ok FROM matches m LEFT JOIN tp ON m.s1_id = tp.s1_id AND m.cid = tp.cid GROUP BY 1),
nt AS (SELECT s1_id, count(*) AS n_true FROM tp GROUP BY 1),
f0 AS (SELECT s1.s1_id, s1.country, coalesce(n_pred, 0) AS n_pred, coalesce(ok, 0) AS ok, coalesce(n_true, 0) AS n_true FROM s1 LEFT JOIN said USING (s1_id) LEFT JOIN nt USING (s1_id)),
f1 AS (SELECT *, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE WHEN n_true = 0 OR n_pred = 0 THEN 0.0::DOUBLE ELSE ok / n_pred END AS p, CASE WHEN n_true = 0 THEN 1.0::DOUBLE WHEN n_pred = 0 THEN 0.0::DOUBLE ELSE ok / n_true END AS r FROM f0),
fs AS (SELECT *, CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN ok > 0 THEN 1.25::DOUBLE * p * r / (0.25::DOUBLE * p + r) ELSE 0.0::DOUBLE END AS f05 FROM f1)
"""
