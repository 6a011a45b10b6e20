"""Labelled business records made from the `part` table by arithmetic, and literal stress cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS_SQL = """
WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_name, p_type, p_name || ' ' || replace(p_brand, '#', ' ') AS nm, CAST(10 + p_partkey % 500 AS VARCHAR(20)) AS n, CAST(floor(p_partkey / 4) AS BIGINT) % 20 AS m,
  CASE p_partkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END AS country FROM {part}),
a AS (SELECT *, CASE country WHEN 'US' THEN n || ' Main St, ' || p_type WHEN 'India' THEN 'Plot No. ' || n || ', MG Road, ' || p_type ELSE 'Rue de la Paix ' || n || ', ' || p_type END AS ad FROM p),
e AS (
  SELECT 'S1-' || CAST(k AS VARCHAR(20)) AS entity_id, nm || CASE country WHEN 'US' THEN ' Inc' WHEN 'India' THEN ' Pvt Ltd' ELSE ' SARL' END AS business_name, ad AS business_address, country, k, m FROM a WHERE k % 4 = 0
  UNION ALL SELECT 'S2-' || CAST(k AS VARCHAR(20)), CASE WHEN k % 8 = 0 THEN substr(nm, 1, 2) || substr(nm, 4)
    ELSE split_part(nm, ' ', 2) || ' ' || split_part(nm, ' ', 1) || substr(nm, length(split_part(nm, ' ', 1)) + length(split_part(nm, ' ', 2)) + 2) END,
    replace(replace(replace(CASE WHEN k % 5 = 0 THEN split_part(ad, ', ', 1) ELSE ad END, 'Main St', 'Main Street'), 'MG Road', 'M.G. Rd'), 'Rue de la Paix', 'R. de la Paix'), country, k, m FROM a WHERE k % 4 = 0 AND m >= 5
  UNION ALL SELECT 'S3-' || CAST(k AS VARCHAR(20)), p_name || ' Corp', CASE WHEN k % 7 = 0 THEN '' ELSE 'Near SBI ATM, ' || p_type END, country, k, m FROM a WHERE k % 4 = 0 AND m >= 12
  UNION ALL SELECT 'S2-' || CAST(k AS VARCHAR(20)), nm || ' Airport Branch', 'Airport Terminal ' || CAST(1 + k % 3 AS VARCHAR(20)) || ', ' || p_type, country, k, m FROM a WHERE k % 4 = 1
  UNION ALL SELECT 'S3-' || CAST(k AS VARCHAR(20)), split_part(p_name, ' ', 1) || ' Logistics Group', CAST(50 + k % 400 AS VARCHAR(20)) || ' Commercial Complex, ' || p_type, country, k, m FROM a WHERE k % 4 = 2)
"""
ENT_SQL = RECORDS_SQL + "SELECT entity_id, business_name, business_address, country FROM e"
TRUTH_SQL = RECORDS_SQL + """SELECT entity_id AS source1_entity_id, CASE WHEN m < 5 THEN '' WHEN m < 12 THEN 'S2-' || CAST(k AS VARCHAR(20)) ELSE 'S2-' || CAST(k AS VARCHAR(20)) || ',S3-' || CAST(k AS VARCHAR(20)) END AS matched_entity_ids FROM e WHERE entity_id LIKE 'S1-%'"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, business_name, business_address, country: reference source S1 and noisy sources S2 and S3."""
    return spark.sql(ENT_SQL, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source1_entity_id, matched_entity_ids (comma list, empty for a record without a match)."""
    return spark.sql(TRUTH_SQL, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


#: Names and addresses of a country that training never sees: (name, address, name, address, same business?).
STRESS = [
    ("Boulangerie Martin SARL", "12 Rue de la Paix, 75002 Paris", "Boulangerie Martin", "12 R. de la Paix, 75002 Paris", 1),
    ("Garage Dupont SAS", "4 bis Avenue Foch, 69006 Lyon", "Garage Dupont", "4 bis Av Foch, 69006 Lyon", 1),
    ("Pharmacie du Centre", "8 Bd Victor Hugo, 06000 Nice", "Pharmacie Centre SELARL", "8 Boulevard Victor Hugo, 06000 Nice", 1),
    ("Librairie Moreau", "Rue Nationale 30, Lille", "Librairie Moreau EURL", "30 Rue Nationale, Lille", 1),
    ("Transports Lefevre SA", "Impasse des Lilas 3, Bordeaux", "Transports Lefèvre", "3 Imp des Lilas, Bordeaux", 1),
    ("Cafe de la Gare", "1 Place de la Gare, 67000 Strasbourg", "Cafe du Marche", "9 Place du Marche, 67000 Strasbourg", 0),
    ("Optique Bernard", "15 Rue du Port, 13002 Marseille", "Fleurs Simon", "15 Rue du Port, 13002 Marseille", 0),
    ("Menuiserie Petit", "22 Rue Haute, 31000 Toulouse", "Menuiserie Grand", "80 Rue Basse, 44000 Nantes", 0),
]


def stress(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(STRESS)], "pair int, name_1 string, address_1 string, name_2 string, address_2 string, label int")


SYNTHETIC_SQL = """
SELECT id AS k, 'S1-' || CAST(id AS VARCHAR(20)) AS s1_id, {words} AS name, CASE id % 4 WHEN 3 THEN 'France' ELSE CASE id % 2 WHEN 0 THEN 'US' ELSE 'India' END END AS country,
 CASE WHEN (id * 7919 + 11) % 100 < 25 THEN 0 WHEN (id * 7919 + 11) % 100 < 60 THEN 1 ELSE 2 END AS n_matches FROM {ids}
"""


def synthetic(spark: SparkSession, n_entities: int = 1200) -> DataFrame:
    """Entities with 0, 1 or 2 matches (25, 35, 40 %) by counter arithmetic: the same rows however they are partitioned."""
    words = "element_at(split('Alpha Bharat Cedar Delta Emerald Falcon Ganga Horizon Indigo Jupiter', ' '), CAST(id * 31 % 10 AS INT) + 1) || ' ' || element_at(split('Traders Foods Textiles Motors Systems Clinic Studio', ' '), CAST(id * 17 % 7 AS INT) + 1) || ' ' || CAST(id AS VARCHAR(20))"
    return spark.sql(SYNTHETIC_SQL.format(words=words, ids="{ids}"), ids=spark.range(n_entities))


#: Legal forms that a French variant may end in.
FORMS = ["SARL", "SAS", "EURL", "SA"]


def _roll(seed: int, *parts):
    """0 to 99, by arithmetic on numbers: the same on every run and however rows are partitioned."""
    h = F.lit(seed).cast("long")
    for p in parts:
        h = (h * 48_271 + p.cast("long") * 69_621 + 12_345) % 999_983
    return h % 100


def _pick(words: list[str], n):
    return F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))


def noisy_sources(entities: DataFrame, branches: int = 350, confusers: int = 350, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Of synthetic entities (k, s1_id, name, country, n_matches): records of all sources and the true pairs.

    S1 has every entity.  One with a match has a noisy copy in S2, one with two another in S3: a letter may be dropped, two
    words may change places, the legal form may be cut, the street may be shortened.  Branches are the first entities' names
    at other places (S2), confusers share their first word and nothing else (S3); both match nothing."""
    k = F.col("k")
    e = entities.withColumn("legal", _pick(["Pvt Ltd", "Inc", "LLC", "Corp"], k)).withColumn("street", F.concat((10 + k % 490).cast("string"), F.lit(" "), _pick(["Main Street", "Park Road", "Lake Avenue", "Hill Lane"], k * 7), F.lit(", "), _pick(["Springfield", "Pune", "Lyon", "Riverton", "Nagpur"], k * 3)))
    full = F.concat_ws(" ", "name", "legal")
    words = F.split("name", " ")
    swapped = F.concat_ws(" ", F.element_at(words, 2), F.element_at(words, 1), F.array_join(F.slice(words, 3, 9), " "))
    dropped = F.concat(F.substring("name", 1, 2), F.substring("name", 4, 200))

    def noisy(source: int) -> DataFrame:
        roll, cut = _roll(seed, k, F.lit(source)), _roll(seed + 1, k, F.lit(source))
        name = F.when(roll < 30, dropped).when(roll < 55, swapped).otherwise(F.col("name"))
        short = F.regexp_replace(F.regexp_replace("street", "Street", "St"), "Road", "Rd")
        rows = e.where(F.col("n_matches") >= source - 1)
        return rows.select(F.concat(F.lit(f"S{source}-"), k.cast("string")).alias("entity_id"), F.when(cut < 40, name).otherwise(F.concat_ws(" ", name, "legal")).alias("business_name"), F.when(cut % 10 < 1, "").when(cut % 2 == 0, short).otherwise(F.col("street")).alias("business_address"), "country")

    n = 1_000_000
    branch = e.where(k < branches).select(F.concat(F.lit("S2-"), (k + n).cast("string")).alias("entity_id"), F.concat_ws(" ", "name", F.lit("Airport Branch")).alias("business_name"), F.concat(F.lit("Terminal "), (1 + k % 3).cast("string"), F.lit(", Airport Road")).alias("business_address"), "country")
    confuser = e.where(k < confusers).select(F.concat(F.lit("S3-"), (k + n).cast("string")).alias("entity_id"), F.concat_ws(" ", F.element_at(words, 1), F.lit("Logistics Group")).alias("business_name"), F.concat((900 + k % 90).cast("string"), F.lit(" Commercial Complex")).alias("business_address"), "country")
    own = e.select(F.col("s1_id").alias("entity_id"), full.alias("business_name"), F.col("street").alias("business_address"), "country")
    true = e.select("s1_id", F.explode(F.sequence(F.lit(2), F.greatest(F.col("n_matches") + 1, F.lit(2)))).alias("source"), "n_matches", "k").where("n_matches > 0")
    pairs = true.select("s1_id", F.concat(F.lit("S"), F.col("source").cast("string"), F.lit("-"), k.cast("string")).alias("cid"))
    return own.unionByName(noisy(2)).unionByName(noisy(3)).unionByName(branch).unionByName(confuser), pairs


def country_variants(rows: DataFrame, most: int = 3, seed: int = 7) -> DataFrame:
    """rows (entity_id, business_name, business_address) -> 1 to `most` variants of each, with nth: a legal form is appended
    (60 %), else `& Fils` (30 %); the first street word that has an abbreviation gets it; `, France` is appended (40 %)."""
    n = F.crc32(F.col("entity_id").cast("binary"))
    made = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), (1 + n % most).cast("int"))))
    form, tail = _roll(seed, n, F.col("nth")), _roll(seed + 1, n, F.col("nth"))
    name = F.when(form < 60, F.concat_ws(" ", "business_name", _pick(FORMS, n + F.col("nth")))).when(form < 72, F.concat("business_name", F.lit(" & Fils"))).otherwise(F.col("business_name"))
    address = F.col("business_address")
    short = address
    for word, to in reversed([("Avenue", "Av"), ("Boulevard", "Bd"), ("Rue", "R."), ("Place", "Pl")]):
        short = F.when(F.contains(address, F.lit(word)), F.replace(address, F.lit(word), F.lit(to))).otherwise(short)
    return made.withColumns({"business_name": name, "business_address": F.when(tail < 40, F.concat(short, F.lit(", France"))).otherwise(short)})
