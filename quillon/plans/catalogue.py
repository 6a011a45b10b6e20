"""Registry of the record-linkage queries and their DuckDB twins, by the ids of the operator inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import blocking, features, metrics, model, records, resolve, sampling, simple, tfidf, validate
from ..sources import fixture, readers, sinks, staging
from ..sources.staging import numbered
from . import duck, linkage
from .linkage import Linkage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(x: Linkage) under a name; sql reads the shared table expressions unless it is marked RAW."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Linkage(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql[4:] if sql.startswith("RAW ") else duck.cte() + sql
        return f

    return add


def listed(c) -> F.Column:
    return F.array_join(c, "|")


# Scans and sinks -----------------------------------------------------------------------------------------------------

query("sc1_record_scan", "SELECT entity_id, business_name, business_address, country FROM ent")(lambda x: x.ent)
query("sc2_country_scan", "SELECT entity_id, business_name FROM ent WHERE country = 'India'")(lambda x: x.ent.where("country = 'India'").select("entity_id", "business_name"))
query("sc3_limit_scan", "SELECT entity_id, country FROM ent WHERE entity_id LIKE 'S1-%' ORDER BY entity_id LIMIT 40")(lambda x: readers.first_rows(x.ent.where("entity_id like 'S1-%'"), 40).select("entity_id", "country"))


@query("sc4_needed_or_background", """, o AS (SELECT entity_id, row_number() OVER (PARTITION BY split_part(entity_id, '-', 1) ORDER BY entity_id) AS k FROM ent WHERE entity_id NOT LIKE 'S1-%' AND entity_id NOT IN (SELECT cid FROM tp))
SELECT entity_id FROM ent WHERE entity_id NOT LIKE 'S1-%' AND entity_id IN (SELECT cid FROM tp) UNION ALL SELECT entity_id FROM o WHERE k <= 25000""")
def _(x):
    return readers.needed_or_background(x.ent.where("entity_id not like 'S1-%'"), x.truth_pairs.select(F.col("cid").alias("entity_id"))).select("entity_id")


query("sc6_filtered_scan", "SELECT entity_id, business_name FROM ent WHERE entity_id IN (SELECT cid FROM tp)")(lambda x: x.ent.join(x.truth_pairs.select(F.col("cid").alias("entity_id")), "entity_id", "left_semi").select("entity_id", "business_name"))
query("sc7_ground_truth_parse", "SELECT source1_entity_id AS s1_id, matched_entity_ids AS ids, CAST(len(list_filter(string_split(matched_entity_ids, ','), lambda v: v <> '')) AS BIGINT) AS n FROM truth")(lambda x: readers.parse_truth(x.truth).select("s1_id", F.array_join("cids", ",").alias("ids"), F.size("cids").cast("long").alias("n")))
_CELL = r"""RAW SELECT c_custkey, trim(regexp_replace(replace('` ''' || c_name || ' the '' ', '\''', ''''), '^[`''"\s\\]+|[`''"\s\\]+$', '', 'g')) AS name FROM customer"""
query("sc8_cell_cleanup", _CELL)(lambda x: x.spark.read.parquet(f"{x.sf_dir}/customer.parquet").select("c_custkey", readers.clean_cell(F.concat(F.lit("` '"), "c_name", F.lit(" the ' "))).alias("name")))
query("sc10_text_variant", "SELECT entity_id, lower(business_name) AS name, coalesce(string_split(lower(business_name), ' ')[1], '') AS w1, coalesce(string_split(lower(business_name), ' ')[2], '') AS w2, lower(business_name)[1:3] AS prefix3, trim(list_last(string_split(lower(business_address), ','))) AS suburb FROM ent")(lambda x: readers.text_variant(x.ent).select("entity_id", "name", "w1", "w2", "prefix3", "suburb"))
query("sc13_id_scan", "SELECT DISTINCT source1_entity_id AS entity_id FROM truth")(lambda x: x.truth.select(F.col("source1_entity_id").alias("entity_id")).distinct())
query("sc15_synthetic", "RAW SELECT id AS k, 'S1-' || CAST(id AS VARCHAR) AS s1_id, (['Alpha','Bharat','Cedar','Delta','Emerald','Falcon','Ganga','Horizon','Indigo','Jupiter'])[id * 31 % 10 + 1] || ' ' || (['Traders','Foods','Textiles','Motors','Systems','Clinic','Studio'])[id * 17 % 7 + 1] || ' ' || CAST(id AS VARCHAR) AS name, CASE id % 4 WHEN 3 THEN 'France' ELSE CASE id % 2 WHEN 0 THEN 'US' ELSE 'India' END END AS country, CASE WHEN (id * 7919 + 11) % 100 < 25 THEN 0 WHEN (id * 7919 + 11) % 100 < 60 THEN 1 ELSE 2 END AS n_matches FROM range(1200) t(id)")(lambda x: fixture.synthetic(x.spark))
query("sc17_stress_cases", "RAW SELECT * FROM (VALUES " + ", ".join(f"({i}, " + ", ".join("'" + v.replace("'", "''") + "'" for v in r[:4]) + f", {r[4]})" for i, r in enumerate(fixture.STRESS)) + ") t(pair, name_1, address_1, name_2, address_2, label)")(lambda x: fixture.stress(x.spark))
query("sk1_matching_rows", ", l AS (SELECT s1_id, string_agg(cid, ',' ORDER BY rank) AS ids FROM matches GROUP BY 1) SELECT s1.s1_id AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM s1 LEFT JOIN l USING (s1_id)")(lambda x: sinks.match_rows(x.s1_ids, x.matches))
query("sk2_candidate_rows", ", l AS (SELECT s1_id, string_agg(cid, ',' ORDER BY cid) AS ids FROM cand GROUP BY 1) SELECT s1.s1_id AS source1_entity_id, coalesce(ids, '') AS candidate_entity_ids FROM s1 LEFT JOIN l USING (s1_id)")(lambda x: sinks.candidate_rows(x.s1_ids, x.pairs))
query("sk6_report", """, a AS (SELECT count(*) AS n, round(avg(f05), 6) AS f05 FROM fs) SELECT n, f05 FROM a""")(lambda x: metrics.macro(_scores(x)).select("n", F.col("macro_f05").alias("f05")))

# Text ----------------------------------------------------------------------------------------------------------------

_noisy = "translate(business_name, 'lo', '10')"
query("n1_leetspeak", f"SELECT entity_id, {duck.leet(_noisy)} AS fixed FROM ent")(lambda x: x.ent.select("entity_id", T.fix_leetspeak(F.translate("business_name", "lo", "10")).alias("fixed")))
query("n2_strip_accents", "RAW SELECT doc_id, strip_accents(coalesce(text, '')) AS plain FROM documents")(lambda x: x.spark.read.parquet(f"{x.sf_dir}/documents.parquet").select("doc_id", T.strip_accents("text").alias("plain")))
query("n3_transliterate")(lambda x: x.spark.read.parquet(f"{x.sf_dir}/documents.parquet").select("doc_id", T.transliterate("text").alias("plain")))
query("n5_dotted", f"SELECT entity_id, {duck.collapse('lower(business_address)')} AS collapsed FROM ent")(lambda x: x.ent.select("entity_id", T.collapse_initials(F.lower("business_address")).alias("collapsed")))
query("n6_legal_map", f"SELECT entity_id, {duck.mapped('lower(business_name)', dict.fromkeys(V.LEGAL_FORMS, 'corp'))} AS mapped FROM ent")(lambda x: x.ent.select("entity_id", T.mapped(F.lower("business_name"), dict.fromkeys(V.LEGAL_FORMS, "corp")).alias("mapped")))
query("n7_addr_map", f"SELECT entity_id, {duck.mapped('lower(business_address)', V.ADDRESS_MAP)} AS mapped FROM ent")(lambda x: x.ent.select("entity_id", T.mapped(F.lower("business_address"), V.ADDRESS_MAP).alias("mapped")))
for _name, _spark, _sql in (
    ("n4_normalize_name", lambda: F.col("norm_name"), "norm_name"),
    ("n4_normalize_address", lambda: F.col("norm_address"), "norm_address"),
    ("n8_sig_tokens", lambda: listed("sig_tokens"), "array_to_string(sig_tokens, '|')"),
    ("n9_strip_legal", lambda: F.col("stripped_name"), "stripped_name"),
    ("n10_acronyms", lambda: listed("acronyms"), "array_to_string(acronyms, '|')"),
    ("n12_phonetic", lambda: listed("phonetic"), "array_to_string(phonetic, '|')"),
    ("n13_compact_brand", lambda: F.col("compact_brand"), "compact_brand"),
    ("n14_unit_keys", lambda: listed("unit_keys"), "array_to_string(unit_keys, '|')"),
    ("n15_parse_addr", lambda: F.concat_ws("|", "parsed.number", "parsed.postcode", "parsed.street", "parsed.locality", listed("parsed.loc_tokens")), "concat_ws('|', number, postcode, street, locality, array_to_string(loc_tokens, '|'))"),
    ("n16_addr_tokens", lambda: listed("addr_tokens"), "array_to_string(addr_tokens, '|')"),
    ("n17_addr_numbers", lambda: listed("addr_nums"), "array_to_string(addr_nums, '|')"),
    ("n18_house_codes", lambda: listed("house_codes"), "array_to_string(house_codes, '|')"),
    ("n19_char3", lambda: listed("c3_name"), "array_to_string(c3_name, '|')"),
    ("n21_prefix", lambda: T.prefix_key(F.col("norm_name")), "CASE WHEN length(norm_name) >= 3 THEN norm_name[1:3] ELSE '' END"),
):
    query(_name, f"SELECT entity_id, {_sql} AS value FROM rec")(lambda x, c=_spark: x.rec.select("entity_id", c().alias("value")))
query("n11_skeleton", f", w AS (SELECT DISTINCT unnest(string_split_regex(trim(lower(p_name)), '\\s+')) AS word FROM part) SELECT word, {duck.skeleton('word')} AS value FROM w")(lambda x: x.spark.read.parquet(f"{x.sf_dir}/part.parquet").select(F.explode(F.split(F.trim(F.lower("p_name")), r"\s+")).alias("word")).distinct().select("word", T.skeleton(F.col("word")).alias("value")))
query("n20_record", "SELECT entity_id, norm_name, norm_address, array_to_string(sig_tokens, '|') AS tokens, number, locality FROM rec WHERE source = 'S1'")(lambda x: x.s1.select("entity_id", "norm_name", "norm_address", listed("sig_tokens").alias("tokens"), F.col("parsed.number").alias("number"), F.col("parsed.locality").alias("locality")))
query("n23_has_indic", "RAW SELECT doc_id, regexp_matches(coalesce(text, ''), '[ऀ-ൿ]') AS indic FROM documents")(lambda x: x.spark.read.parquet(f"{x.sf_dir}/documents.parquet").select("doc_id", T.has_indic("text").alias("indic")))

# Blocking ------------------------------------------------------------------------------------------------------------

query("j1_postings", "SELECT entity_id, country, key_type, key FROM keys WHERE source <> 'S1'")(lambda x: blocking.keys(x.pool))
query("f2_df_cap", "SELECT entity_id, country, key_type, key FROM posts")(lambda x: blocking.cap(blocking.keys(x.pool), x.caps))
query("j2_candidates", "SELECT s1_id, cid FROM cand")(lambda x: x.pairs)
query("j3_simple_blocking", "SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cid FROM keys a JOIN keys b USING (country, key_type, key) WHERE a.source = 'S1' AND b.source <> 'S1' AND key_type IN ('T', 'A', 'P')")(lambda x: blocking.block_simple(x.s1, x.pool))
query("j4_scored_topk", """, s AS (SELECT a.entity_id AS s1_id, b.entity_id AS cid, CAST(sum(CASE key_type WHEN 'T' THEN 2 ELSE 3 END) AS BIGINT) AS score FROM keys a JOIN posts b USING (country, key_type, key) WHERE a.source = 'S1' AND key_type IN ('T', 'N') GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cid) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 25""")(lambda x: blocking.block_scored(x.s1, x.pool, 25, x.caps))
query("j5_rule_blocking")(lambda x: blocking.block_rules(readers.text_variant(x.ent.where("entity_id like 'S1-%'")), readers.text_variant(x.ent.where("entity_id not like 'S1-%'"))))
query("j6_attribute_lookup", "SELECT c.s1_id, c.cid, a.norm_name AS name_1, b.norm_name AS name_2 FROM cand c JOIN rec a ON c.s1_id = a.entity_id JOIN rec b ON c.cid = b.entity_id")(lambda x: x.paired.select("s1_id", "cid", F.col("a.norm_name").alias("name_1"), F.col("b.norm_name").alias("name_2")))
query("j8_label_join", "SELECT c.s1_id, c.cid, CASE WHEN tp.cid IS NULL THEN 0 ELSE 1 END AS label FROM cand c LEFT JOIN tp ON c.s1_id = tp.s1_id AND c.cid = tp.cid")(lambda x: x.pairs.join(x.truth_pairs.withColumn("_t", F.lit(1)), ["s1_id", "cid"], "left").select("s1_id", "cid", F.when(F.col("_t").isNull(), 0).otherwise(1).alias("label")))
query("j10_address_overlap", """, sh AS (SELECT a.entity_id AS s1_id, b.entity_id AS cid, count(*) FILTER (key_type = 'N') AS n, count(*) FILTER (key_type = 'AT') AS t FROM keys a JOIN keys b USING (country, key_type, key) WHERE a.source = 'S1' AND b.source <> 'S1' AND key_type IN ('N', 'AT') GROUP BY 1, 2) SELECT s1_id, cid FROM sh WHERE n >= 1 OR t >= 2""")(lambda x: blocking.address_overlap(x.s1, x.pool))
query("a6_blocking_recall", ", h AS (SELECT tp.s1_id, tp.cid, s1.country, c.cid AS hit FROM tp JOIN s1 USING (s1_id) LEFT JOIN cand c ON c.s1_id = tp.s1_id AND c.cid = tp.cid) SELECT country, count(*) AS links, count(hit) AS captured, round(count(hit) / count(*), 6) AS recall FROM h GROUP BY ROLLUP (country)")(lambda x: blocking.recall(x.pairs, x.truth_pairs, x.s1_ids))
query("a7_reduction", ", n AS (SELECT (SELECT count(*) FROM cand) AS pairs, (SELECT count(*) FROM s1) AS n1, (SELECT count(*) FROM ent WHERE entity_id NOT LIKE 'S1-%') AS n2) SELECT pairs, n1 * n2 AS possible, round(1.0::DOUBLE - pairs / (n1 * n2), 6) AS reduction, round(pairs / n1, 6) AS per_entity FROM n")(lambda x: blocking.reduction(x.pairs, x.s1_ids, x.ent.where("entity_id not like 'S1-%'")))

# Features ------------------------------------------------------------------------------------------------------------

_CHEAP = {"x1_ntj": "ntj", "x5_nc3": "nc3", "x8_lex": "lex", "x9_acr": "acr", "x10_nsm": "nsm", "x10_mnm": "mnm", "x11_pcm": "pcm", "x11_mpc": "mpc", "x12_ljc": "ljc", "x14_ac3": "ac3", "x16_mad": "mad", "x17_nld": "nld", "x20_ukm": "ukm"}
for _name, _f in _CHEAP.items():
    query(_name, f"SELECT s1_id, cid, round({_f}, 6) AS value FROM cheap")(lambda x, f=_f: x.paired.select("s1_id", "cid", F.round(features.cheap()[f], 6).alias("value")))
# The table of common subsequences is too slow in SQL on all pairs: the tests hold these against a plain one.
_COSTLY = {"x2_nts": "nts", "x3_nlv": "nlv", "x13_slv": "slv", "x15_alv": "alv", "x18_phs": "phs", "x19_cbs": "cbs"}
for _name, _f in _COSTLY.items():
    query(_name)(lambda x, f=_f: x.paired.select("s1_id", "cid", F.round(features.costly()[f], 6).alias("value")))
query("x4_indel_native")(lambda x: x.paired.select("s1_id", "cid", F.round(S.indel_ratio_native(F.col("a.stripped_name"), F.col("b.stripped_name")), 6).alias("value")))
query("x21_sequence_ratio")(lambda x: x.paired.select("s1_id", "cid", F.round(S.sequence_ratio(F.col("a.norm_name"), F.col("b.norm_name")), 6).alias("value")))
query("x23_jaro_winkler", "SELECT s1_id, cid, round(jaro_winkler_similarity(a.norm_name, b.norm_name), 6) AS value FROM cand JOIN rec a ON s1_id = a.entity_id JOIN rec b ON cid = b.entity_id")(lambda x: x.paired.select("s1_id", "cid", F.round(S.jaro_winkler(F.col("a.norm_name"), F.col("b.norm_name")), 6).alias("value")))
query("x23_levenshtein", "SELECT s1_id, cid, CAST(levenshtein(a.norm_name, b.norm_name) AS INTEGER) AS value FROM cand JOIN rec a ON s1_id = a.entity_id JOIN rec b ON cid = b.entity_id")(lambda x: x.paired.select("s1_id", "cid", F.levenshtein("a.norm_name", "b.norm_name").alias("value")))
_VEC = """, nm AS (SELECT DISTINCT stripped_name AS name FROM rec), {words}, tf AS (SELECT name, term, count(*) AS tf FROM te GROUP BY 1, 2), nn AS (SELECT count(*) AS n FROM nm), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= {low} AND count(*) <= {high} * (SELECT n FROM nn)),
w0 AS (SELECT name, term, {tf} * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), nn), vec AS (SELECT name, term, w / sqrt(sum(w * w) OVER (PARTITION BY name)) AS w FROM w0)
"""
_WORD = _VEC.format(words=r"tk AS (SELECT name, regexp_extract_all(lower(name), '\b\w\w+\b') AS t FROM nm), te AS (SELECT name, unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tk)", low=2, high=0.95, tf="tf")
_CHAR = _VEC.format(words=r"wd AS (SELECT name, ' ' || unnest(list_filter(string_split_regex(lower(name), '\s+'), lambda v: v <> '')) || ' ' AS v FROM nm), te AS (SELECT name, unnest(flatten(list_transform([3, 4, 5], lambda k: list_transform(range(1, greatest(length(v) - k + 2, 1)), lambda i: substr(v, i, k))))) AS term FROM wd)", low=1, high=1.0, tf="(1 + ln(tf))")


def _vectors(x, space: str) -> DataFrame:
    terms, _, opts = features.SPACES[space]
    return tfidf.vectors(features.names_of(x.rec), terms(F.col("name")), x.idf[space], **opts).select("name", "term", F.round("w", 6).alias("w"))


query("w1_tfidf_word", _WORD + "SELECT name, term, round(w, 6) AS w FROM vec")(lambda x: _vectors(x, "word"))
query("w2_tfidf_char", _CHAR + "SELECT name, term, round(w, 6) AS w FROM vec")(lambda x: _vectors(x, "char"))
_COS = """, pr AS (SELECT DISTINCT a.stripped_name AS name_1, b.stripped_name AS name_2 FROM cand JOIN rec a ON s1_id = a.entity_id JOIN rec b ON cid = b.entity_id),
ds AS (SELECT name_1, name_2, sum(p.w * q.w) AS c FROM pr JOIN vec p ON p.name = name_1 JOIN vec q ON q.name = name_2 AND q.term = p.term GROUP BY 1, 2)
SELECT name_1, name_2, round(coalesce(c, 0.0::DOUBLE), 6) AS cosine FROM pr LEFT JOIN ds USING (name_1, name_2)"""


def _cosine(x, feature: str) -> DataFrame:
    both = x.weighed_pairs(x.pairs).select(F.col("a.stripped_name").alias("name_1"), F.col("b.stripped_name").alias("name_2"), F.round(features.cosines()[feature], 6).alias("cosine"))
    return both.distinct()


query("x6_twc", _WORD + _COS)(lambda x: _cosine(x, "twc"))
query("x7_tcc", _CHAR + _COS)(lambda x: _cosine(x, "tcc"))
query("f3_gate", "SELECT s1_id, cid FROM cheap WHERE greatest(ac3, nc3, ntj, cbm, code, hit, acr, greatest(ukm, 0)) >= 0.30")(lambda x: x.paired.where(features.gate() >= 0.30).select("s1_id", "cid"))
query("x_linear_score", "SELECT s1_id, cid, p FROM sc")(lambda x: features.linear_score(x.paired))
# Sequence ratios have no SQL; the tests hold all columns of all pairs against plain Python.
query("x22_eleven_features")(lambda x: simple.eleven(features.pair_up(x.pairs, x.simple.where("entity_id LIKE 'S1-%'"), x.simple.where("entity_id NOT LIKE 'S1-%'"))))
for _style in ("leading", "keyword", "robust"):
    query(f"n24_parse_{_style}")(lambda x, s=_style: x.ent.select("entity_id", simple.parse_address("business_address", s).alias("a")).select("entity_id", "a.*"))
query("n22_simple_fields")(lambda x: x.simple.select("entity_id", "clean_name", "clean_address", listed("name_tokens").alias("name_tokens"), listed("address_tokens").alias("address_tokens"), "initials", "number", "code"))

# Windows and resolution ----------------------------------------------------------------------------------------------

query("f4_primary", "SELECT s1_id, cid, p FROM prim")(lambda x: resolve.primary(x.scored, linkage.THRESHOLDS).select("s1_id", "cid", "p"))
query("o1_winner", "SELECT s1_id, cid, p FROM won")(lambda x: resolve.winners(resolve.primary(x.scored, linkage.THRESHOLDS)).select("s1_id", "cid", "p"))
query("o2_topk_cap", ", r AS (SELECT s1_id, cid, p, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cid) AS INTEGER) AS rank FROM sc) SELECT * FROM r WHERE rank <= 3")(lambda x: resolve.ranked(x.scored, 3).select("s1_id", "cid", "p", "rank"))
query("m3_resolve", "SELECT s1_id, cid, p, rank FROM matches")(lambda x: x.matches.select("s1_id", "cid", "p", "rank"))
query("m4_resolve_margin", """, o AS (SELECT s1_id, cid, p, max(p) OVER (PARTITION BY s1_id) AS top, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cid) AS k FROM sc WHERE p >= 0.40::DOUBLE), v AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY p DESC, s1_id) AS c FROM o),
g AS (SELECT * FROM v WHERE c = 1 AND (k = 1 OR (p >= 0.55::DOUBLE AND round(top - p, 9) <= 0.25::DOUBLE))) SELECT s1_id, cid, p, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cid) AS INTEGER) AS rank FROM g""")(lambda x: resolve.resolve_margin(x.scored).select("s1_id", "cid", "p", "rank"))
query("m5_pairwise", "SELECT s1_id, cid, p, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cid) AS INTEGER) AS rank FROM sc WHERE p >= 0.5::DOUBLE")(lambda x: resolve.pairwise(x.scored, 0.5).select("s1_id", "cid", "p", "rank"))
query("m3_resolve_chunked", """, ch AS (SELECT s1_id, CAST(floor((row_number() OVER (ORDER BY s1_id) - 1) / 100) AS BIGINT) AS chunk_id FROM s1), p1 AS (SELECT prim.*, chunk_id FROM prim JOIN ch USING (s1_id)), v AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, cid ORDER BY p DESC, s1_id) AS k FROM p1),
r AS (SELECT chunk_id, s1_id, cid, p, CAST(row_number() OVER (PARTITION BY chunk_id, s1_id ORDER BY p DESC, cid) AS INTEGER) AS rank FROM v WHERE k = 1) SELECT * FROM r WHERE rank <= 12""")(lambda x: resolve.resolve(resolve.chunked(x.scored, x.s1_ids.select("s1_id"), 100), linkage.THRESHOLDS, within=("chunk_id",)).select("chunk_id", "s1_id", "cid", "p", "rank"))
_DRAW = "((42 * 48271 + CAST(split_part(s1_id, '-', 2) AS BIGINT) * 69621 + 12345) % 999983)"
query("o6_hash_split", f"SELECT s1_id, CASE WHEN {_DRAW} % 100 < 60 THEN 'train' WHEN {_DRAW} % 100 < 80 THEN 'validation' ELSE 'test' END AS split FROM s1")(lambda x: sampling.split(x.s1_ids, {"train": 60, "validation": 20, "test": 20}).select("s1_id", "split"))
_HARD = f""", hn AS (SELECT c.s1_id, c.cid, ((({_DRAW} * 48271 + CAST(split_part(cid, '-', 2) AS BIGINT) * 69621 + 12345) % 999983) * 48271 + CAST(split_part(cid, '-', 1)[2:2] AS BIGINT) * 69621 + 12345) % 999983 AS h FROM cand c ANTI JOIN tp ON c.s1_id = tp.s1_id AND c.cid = tp.cid),
hard AS (SELECT s1_id, cid FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY h, cid) AS k FROM hn) WHERE k <= 10)"""
query("o4_hard_negatives", _HARD + " SELECT * FROM hard")(lambda x: sampling.hard_negatives(x.pairs, x.truth_pairs))
_RANDOM = f""", pl AS (SELECT country, entity_id AS cid, row_number() OVER (PARTITION BY country ORDER BY entity_id) - 1 AS place FROM ent WHERE entity_id NOT LIKE 'S1-%'), pz AS (SELECT country, count(*) AS size FROM pl GROUP BY 1),
pk AS (SELECT s1_id, country, (({_DRAW} * 48271 + d * 69621 + 12345) % 999983) % size AS place FROM s1 JOIN pz USING (country), (VALUES (1), (2)) t(d)), rn AS (SELECT DISTINCT pk.s1_id, pl.cid FROM pk JOIN pl USING (country, place)), rand AS (SELECT rn.* FROM rn ANTI JOIN tp ON rn.s1_id = tp.s1_id AND rn.cid = tp.cid)"""
_s1e = lambda x: x.ent.where("entity_id like 'S1-%'")
_poole = lambda x: x.ent.where("entity_id not like 'S1-%'")
query("o5_random_negatives", _RANDOM + " SELECT s1_id, cid FROM rand")(lambda x: sampling.random_negatives(_s1e(x), _poole(x), x.truth_pairs))
query("m6_train_pairs", _HARD + _RANDOM + " SELECT s1_id, cid, 1 AS label FROM tp UNION ALL SELECT s1_id, cid, 0 FROM (SELECT * FROM hard UNION SELECT * FROM rand)")(lambda x: sampling.training_pairs(x.pairs, _s1e(x), _poole(x), x.truth_pairs))
query("o7_lowest_accepted", "SELECT s1_id, cid, p FROM matches ORDER BY p, s1_id, cid LIMIT 5")(lambda x: x.matches.select("s1_id", "cid", "p").orderBy("p", "s1_id", "cid").limit(5))
query("o8_token_sort", f"SELECT entity_id, {duck.token_sort('norm_name')} AS value FROM rec")(lambda x: x.rec.select("entity_id", S.token_sort(F.col("norm_name")).alias("value")))

# Aggregates ----------------------------------------------------------------------------------------------------------


def _scores(x) -> DataFrame:
    return metrics.per_record(x.s1_ids, x.matches, x.truth_pairs)


query("a2_by_country", "SELECT country, count(*) AS n FROM ent WHERE entity_id NOT LIKE 'S1-%' GROUP BY 1")(lambda x: _poole(x).groupBy("country").agg(F.count("*").alias("n")))
query("a3_macro_f05", "SELECT count(*) AS n, round(avg(f05), 6) AS macro_f05 FROM fs")(lambda x: metrics.macro(_scores(x)).select("n", "macro_f05"))
query("a4_macro_prf", "SELECT count(*) AS n, round(avg(f05), 6) AS macro_f05, round(avg(p), 6) AS macro_p, round(avg(r), 6) AS macro_r FROM fs")(lambda x: metrics.macro(_scores(x)))
query("a5_country_rollup", "SELECT country, count(*) AS n, round(avg(f05), 6) AS macro_f05 FROM fs GROUP BY ROLLUP (country)")(lambda x: metrics.macro_by_country(_scores(x)))
query("a8_describe", ", c AS (SELECT s1_id, count(*) AS n FROM cand GROUP BY 1) SELECT count(*) AS n_records, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS least, round(quantile_cont(n, 0.25), 6) AS q1, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.75), 6) AS q3, max(n) AS most FROM c")(lambda x: metrics.describe_counts(x.pairs))
_TS = [0.3, 0.4, 0.5, 0.6]
query("a9_threshold_sweep", ", ts AS (SELECT unnest([0.3, 0.4, 0.5, 0.6]::DOUBLE[]) AS t), hi AS (SELECT t, s1_id, cid, p FROM sc, ts WHERE p >= t), w AS (SELECT *, row_number() OVER (PARTITION BY t, cid ORDER BY p DESC, s1_id) AS k FROM hi), m AS (SELECT *, row_number() OVER (PARTITION BY t, s1_id ORDER BY p DESC, cid) AS j FROM w WHERE k = 1), sd AS (SELECT m.t, m.s1_id, count(*) AS np, count(tp.cid) AS ok FROM m LEFT JOIN tp ON m.s1_id = tp.s1_id AND m.cid = tp.cid WHERE j <= 12 GROUP BY 1, 2), z AS (SELECT ts.t, s1.s1_id, coalesce(np, 0) AS np, coalesce(ok, 0) AS ok, coalesce(n_true, 0) AS nt FROM s1 CROSS JOIN ts LEFT JOIN sd ON sd.t = ts.t AND sd.s1_id = s1.s1_id LEFT JOIN nt ON nt.s1_id = s1.s1_id) SELECT t, round(avg(CASE WHEN nt = 0 THEN CASE WHEN np = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN ok > 0 THEN 1.25::DOUBLE * (ok / np) * (ok / nt) / (0.25::DOUBLE * (ok / np) + ok / nt) ELSE 0.0::DOUBLE END), 6) AS macro_f05 FROM z GROUP BY t")(lambda x: metrics.sweep(x.scored, x.s1_ids, x.truth_pairs, _TS))
query("a10_prob_bands", "SELECT CASE WHEN p < 0.2::DOUBLE THEN 0.2::DOUBLE WHEN p < 0.4::DOUBLE THEN 0.4::DOUBLE WHEN p < 0.6::DOUBLE THEN 0.6::DOUBLE WHEN p < 0.8::DOUBLE THEN 0.8::DOUBLE ELSE 99.0::DOUBLE END AS band, count(*) AS n FROM sc GROUP BY 1")(lambda x: metrics.bands(x.scored, [0.2, 0.4, 0.6, 0.8]))
query("a11_fn_taxonomy", "SELECT CASE WHEN a.norm_address = '' OR b.norm_address = '' THEN 'missing_address' WHEN a.number <> '' AND b.number <> '' AND a.number <> b.number THEN 'number_conflict' WHEN NOT list_has_any(a.sig_tokens, b.sig_tokens) THEN 'no_shared_token' WHEN a.stripped_name <> b.stripped_name THEN 'name_variant' ELSE 'other' END AS reason, count(*) AS n FROM tp JOIN rec a ON s1_id = a.entity_id JOIN rec b ON cid = b.entity_id LEFT JOIN matches m ON m.s1_id = tp.s1_id AND m.cid = tp.cid WHERE m.cid IS NULL GROUP BY 1".replace("FROM tp JOIN rec a ON s1_id", "FROM tp JOIN rec a ON tp.s1_id").replace("ON cid = b", "ON tp.cid = b"))(lambda x: features.pair_up(x.truth_pairs.join(x.matches, ["s1_id", "cid"], "left_anti"), x.s1, x.pool).select(metrics.fn_reason().alias("reason")).groupBy("reason").agg(F.count("*").alias("n")))
query("a12_multi_claim", ", k AS (SELECT cid, count(DISTINCT s1_id) AS k FROM sc WHERE p >= 0.5::DOUBLE GROUP BY 1) SELECT count(*) AS claimed, count(*) FILTER (k > 1) AS multi, round(count(*) FILTER (k > 1) / count(*), 6) AS rate FROM k")(lambda x: metrics.multi_claims(x.scored, 0.5))
query("a13_token_df", "SELECT country, token, count(*) AS df FROM (SELECT country, unnest(sig_tokens) AS token FROM rec) GROUP BY 1, 2")(lambda x: metrics.token_frequency(x.rec))
query("a14_distinct_counts", "SELECT count(DISTINCT s1_id) AS records, count(DISTINCT cid) AS candidates FROM cand")(lambda x: x.pairs.agg(F.count_distinct("s1_id").alias("records"), F.count_distinct("cid").alias("candidates")))
query("a15_exact_leak", "SELECT count(*) AS pairs, count(*) FILTER (a.business_address = b.business_address) AS same_address FROM tp JOIN ent a ON s1_id = a.entity_id JOIN ent b ON cid = b.entity_id")(lambda x: metrics.exact_leaks(x.truth_pairs, x.ent))
query("a17_singletons", "SELECT count(*) FILTER (matched_entity_ids = '') AS singletons, count(*) FILTER (matched_entity_ids <> '') AS matched FROM truth")(lambda x: metrics.singletons(readers.parse_truth(x.truth)))
query("a18_pair_prf", ", b AS (SELECT m.cid AS p, tp.cid AS t FROM matches m FULL JOIN tp ON m.s1_id = tp.s1_id AND m.cid = tp.cid), n AS (SELECT count(*) FILTER (p IS NOT NULL AND t IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM b) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(1.25::DOUBLE * (tp / (tp + fp)) * (tp / (tp + fn)) / (0.25::DOUBLE * (tp / (tp + fp)) + tp / (tp + fn)), 6) AS f FROM n")(lambda x: metrics.pair_level(x.matches, x.truth_pairs))

# Sets ----------------------------------------------------------------------------------------------------------------

_part = lambda x, s: x.ent.where(f"entity_id like '{s}-%'")
query("u1_union_all", "SELECT entity_id, country FROM ent WHERE entity_id LIKE 'S2-%' UNION ALL SELECT entity_id, country FROM ent WHERE entity_id LIKE 'S3-%'")(lambda x: _part(x, "S2").unionByName(_part(x, "S3")).select("entity_id", "country"))
query("u2_union_distinct", "SELECT key FROM keys WHERE key_type = 'T' UNION SELECT key FROM keys WHERE key_type = 'P'")(lambda x: x.rec.select(F.explode("sig_tokens").alias("key")).union(x.rec.where("length(norm_name) >= 3").select(T.prefix_key(F.col("norm_name")))).distinct())
query("u3_intersect", "SELECT s1_id, cid FROM cand INTERSECT SELECT s1_id, cid FROM tp")(lambda x: x.pairs.intersect(x.truth_pairs))
query("u4_fp_fn_except", "SELECT 'fp' AS kind, s1_id, cid FROM (SELECT s1_id, cid FROM matches EXCEPT SELECT s1_id, cid FROM tp) UNION ALL SELECT 'fn', s1_id, cid FROM (SELECT s1_id, cid FROM tp EXCEPT SELECT s1_id, cid FROM matches)")(lambda x: x.matches.select("s1_id", "cid").subtract(x.truth_pairs).select(F.lit("fp").alias("kind"), "s1_id", "cid").union(x.truth_pairs.subtract(x.matches.select("s1_id", "cid")).select(F.lit("fn"), "s1_id", "cid")))
query("u6_subset", "SELECT count(*) AS outside FROM (SELECT s1_id, cid FROM matches EXCEPT SELECT s1_id, cid FROM cand)")(lambda x: x.matches.select("s1_id", "cid").join(x.pairs, ["s1_id", "cid"], "left_anti").agg(F.count("*").alias("outside")))

# Model and validation ------------------------------------------------------------------------------------------------


@query("m1_gbt_score")
def _(x):
    """Every candidate pair of the test split."""
    return linkage.scores(x, linkage.train(x), "test").select("s1_id", "cid", F.round("p", 6).alias("p"))


@query("m2_predict")
def _(x):
    """Matches of all records, under thresholds that the validation split gives each country."""
    fitted = linkage.train(x)
    return linkage.predict(x, fitted, linkage.tuned(x, fitted)).select("s1_id", "cid", F.round("p", 6).alias("p"), "rank")


@query("m8_tuned_f05")
def _(x):
    """The test split's quality by country (null: all) under those thresholds."""
    fitted = linkage.train(x)
    mine = x.split.where("split = 'test'").select("s1_id", "country")
    found = linkage.predict(x, fitted, linkage.tuned(x, fitted)).join(mine.select("s1_id"), "s1_id", "left_semi")
    return metrics.macro_by_country(metrics.per_record(mine, found, x.truth_pairs))


@query("a16_importance")
def _(x):
    return model.importance(linkage.train(x), x.spark).withColumn("share", F.round("share", 6))


query("f8_probability_band", "SELECT s1_id, cid, p FROM sc WHERE p >= 0.2::DOUBLE AND p <= 0.35::DOUBLE")(lambda x: x.scored.where("p >= 0.2 and p <= 0.35").select("s1_id", "cid", "p"))
query("u5_augmented", _HARD + _RANDOM + """, lb AS (SELECT s1_id, cid, 1 AS label FROM tp UNION ALL SELECT s1_id, cid, 0 FROM (SELECT * FROM hard UNION SELECT * FROM rand)),
mined AS (SELECT lb.* FROM lb JOIN sc USING (s1_id, cid) WHERE label = 0 AND p >= 0.2::DOUBLE) SELECT * FROM lb UNION ALL SELECT * FROM mined UNION ALL SELECT * FROM mined""")(lambda x: _augmented(x))


def _augmented(x) -> DataFrame:
    """Training pairs and, twice over, the negatives that the score likes."""
    labelled = sampling.training_pairs(x.pairs, _s1e(x), _poole(x), x.truth_pairs)
    return labelled.unionByName(model.mine_hard(labelled.join(x.scored.select("s1_id", "cid", "p"), ["s1_id", "cid"])).select("s1_id", "cid", "label"))


@query("m7_refitted")
def _(x):
    """Scores of the test split after a second fit with mined negatives."""
    again = linkage.train_on_hard(x)
    return linkage.scores(x, again, "test").select("s1_id", "cid", F.round("p", 6).alias("p"))


@query("m9_stress")
def _(x):
    s = fixture.stress(x.spark)
    side = lambda i, tag: s.select(F.concat(F.lit(f"{tag}-"), "pair").alias("entity_id"), F.col(f"name_{i}").alias("business_name"), F.col(f"address_{i}").alias("business_address"), F.lit("France").alias("country"))
    pairs = s.select(F.concat(F.lit("S1-"), "pair").alias("s1_id"), F.concat(F.lit("S2-"), "pair").alias("cid"), "label")
    one, two = (features.weigh(staging.written(records.derive(side(i, tag)), "stress"), x.idf) for i, tag in ((1, "S1"), (2, "S2")))
    rows = staging.written(features.features(features.pair_up(pairs.select("s1_id", "cid"), one, two)), "stress")
    return model.score(linkage.train(x), rows).join(pairs, ["s1_id", "cid"]).select("s1_id", "label", F.round("p", 6).alias("p"))


@query("m10_validate", """, v AS (SELECT s1_id, row_number() OVER (ORDER BY s1_id) AS k FROM s1),
rows_ AS (SELECT s1_id, ['S2-' || k, 'S3-' || k] AS ids FROM v WHERE k % 10 <> 0 UNION ALL SELECT s1_id, ['S2-1', 'S2-1'] FROM v WHERE k % 50 = 1 UNION ALL SELECT 'S1-x', ['S1-5', 'X-9']), i AS (SELECT s1_id, unnest(ids) AS cid FROM rows_),
f AS (SELECT 'duplicate_row' AS rule, s1_id AS what FROM rows_ GROUP BY s1_id HAVING count(*) > 1 UNION ALL SELECT 'repeated_id', s1_id FROM rows_ WHERE len(ids) <> len(list_distinct(ids)) UNION ALL SELECT 'self_match', cid FROM i WHERE cid LIKE 'S1-%'
UNION ALL SELECT 'bad_prefix', cid FROM i WHERE NOT (cid LIKE 'S1-%' OR cid LIKE 'S2-%' OR cid LIKE 'S3-%') UNION ALL SELECT 'missing_record', s1_id FROM s1 WHERE s1_id NOT IN (SELECT s1_id FROM rows_) UNION ALL SELECT DISTINCT 'extra_record', s1_id FROM rows_ WHERE s1_id NOT IN (SELECT s1_id FROM s1)),
r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY what) AS k FROM f)
SELECT rule, 'error' AS severity, count(*) AS n, string_agg(what, ',' ORDER BY what) FILTER (k <= 3) AS examples FROM r GROUP BY rule""")
def _(x):
    v = numbered(x.s1_ids.select("s1_id"), "_place", "s1_id").select("s1_id", (F.col("_place") + 1).alias("k"))
    ids = lambda *c: F.array(*c)
    good = v.where("k % 10 <> 0").select("s1_id", ids(F.concat(F.lit("S2-"), "k"), F.concat(F.lit("S3-"), "k")).alias("ids"))
    bad = v.where("k % 50 = 1").select("s1_id", ids(F.lit("S2-1"), F.lit("S2-1")))
    odd = x.spark.range(1).select(F.lit("S1-x"), ids(F.lit("S1-5"), F.lit("X-9")))
    parsed = good.union(bad).union(odd).select(F.lit(1).cast("long").alias("line"), F.lit("row").alias("kind"), "s1_id", "ids")
    return validate.rules(parsed, x.s1_ids.select("s1_id"))


query("m12_prediction_diff", ", b AS (SELECT s1_id, cid FROM sc WHERE p >= 0.5::DOUBLE), d AS (SELECT coalesce(m.s1_id, b.s1_id) AS s1_id, m.cid AS x, b.cid AS y FROM matches m FULL JOIN b ON m.s1_id = b.s1_id AND m.cid = b.cid) SELECT s1_id, count(*) FILTER (y IS NULL) AS only_first, count(*) FILTER (x IS NULL) AS only_second FROM d GROUP BY 1 HAVING count(*) FILTER (y IS NULL) + count(*) FILTER (x IS NULL) > 0")(lambda x: validate.prediction_diff(x.matches, resolve.pairwise(x.scored, 0.5)))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
