"""Candidate pairs: posting keys, caps on frequent keys, and equi-joins on (country, key type, key)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import POSTING_CAPS
from ..sources.staging import written

#: Rows from which a key of an uncapped join is spread, and over how many salts.
HOT, SALTS = 10_000, 64
#: Keys of a record up to which its pairs are shown by their first shared key, ids in a row of a class, pairs of ids in a cell,
#: tasks beyond which cells grow instead.
MOST, CHUNK, CELL, TASKS = 64, 64, 1 << 20, 10_000
#: Key families of the full scheme: type -> column of a record.
FAMILIES = {"T": "sig_tokens", "N": "addr_nums", "H": "house_codes", "A": "acronyms", "PH": "phonetic", "UK": "unit_keys", "AT": "addr_tokens"}


def _tagged(kind: str, column) -> "F.Column":
    return F.transform(column, lambda k: F.struct(F.lit(kind).alias("key_type"), k.alias("key")))


def keys(rec: DataFrame, families=tuple(FAMILIES), probe: bool = False, brand: bool = True, prefix: bool = True) -> DataFrame:
    """entity_id, country, key_type, key, each key once a record.  probe: the reference side also looks brands up by its
    own long tokens."""
    sets = [_tagged(k, F.col(FAMILIES[k])) for k in families]
    some = lambda c: F.filter(F.array(c), lambda x: x != "")
    if brand:
        sets.append(_tagged("CB", some(F.substring("compact_brand", 1, 8))))
        if probe:
            sets.append(_tagged("CB", F.transform(F.filter("sig_tokens", lambda t: F.length(t) >= 5), lambda t: F.substring(t, 1, 8))))
    if prefix:
        sets.append(_tagged("P", F.filter(F.array(F.substring("norm_name", 1, 3)), lambda p: F.length(p) >= 3)))
    return rec.select("entity_id", "country", F.explode(F.array_distinct(F.concat(*sets))).alias("k")).select("entity_id", "country", "k.key_type", "k.key")


def cap(postings: DataFrame, caps: dict[str, int] = POSTING_CAPS) -> DataFrame:
    """Postings without the keys that are more frequent than their type's cap: the whole key goes.  The counts combine
    before the shuffle, so a frequent key is never brought together."""
    limit = F.lit(caps["default"])
    for kind, n in caps.items():
        if kind != "default":
            limit = F.when(F.col("key_type") == kind, n).otherwise(limit)
    by = ["country", "key_type", "key"]
    return postings.join(postings.groupBy(*by).count().where(F.col("count") <= limit).select(*by), by, "left_semi")


def spread(left: DataFrame, right: DataFrame, by: list[str], hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """left join right on the columns `by` without a cap: keys with more than `hot` rows on the right are dealt into salts,
    and their rows on the left go to each, so that no task gets a whole frequent key."""
    many = right.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*by, F.lit(salts).alias("_salts"))
    some = lambda d: d.join(many, by, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    own = [c for c in right.columns if c not in by]
    left = some(left).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    right = some(right).withColumn("_salt", F.pmod(F.xxhash64(*own), F.col("_salts")).cast("int")).drop("_salts")
    return left.join(right, [*by, "_salt"]).drop("_salt")


def candidates(s1_keys: DataFrame, postings: DataFrame) -> DataFrame:
    """s1_id, cid: pairs that share a key.  Caps bound what one reference record can draw from a key."""
    by = ["country", "key_type", "key"]
    left, right = s1_keys.withColumnRenamed("entity_id", "s1_id"), postings.withColumnRenamed("entity_id", "cid")
    return left.join(right, by).select("s1_id", "cid").distinct()


def _exploded(side: DataFrame, name: str, keys_of=lambda ks: ks) -> DataFrame:
    return side.select(F.col("id").alias(name), F.explode(keys_of(F.col("ks"))).alias("key"))


def _any_key(one: DataFrame, two: DataFrame) -> DataFrame:
    return spread(_exploded(one, "s1_id"), _exploded(two, "cid"), ["key"]).select("s1_id", "cid").distinct()


def _classes(side: DataFrame, rule, chunk: int) -> DataFrame:
    """ks (sorted keys of the rule), ids: records of equal keys in rows of about `chunk` ids."""
    side = side.select("id", F.array_sort(rule(F.col("ks"))).alias("ks")).where(F.size("ks") > 0)
    large = side.groupBy("ks").agg(F.count("*").alias("_n")).where(F.col("_n") > chunk)
    parts = F.coalesce(F.ceil(F.col("_n") / chunk), F.lit(1))
    return side.join(large, "ks", "left").groupBy("ks", F.pmod(F.xxhash64("id"), parts).alias("_part")).agg(F.collect_list("id").alias("ids")).drop("_part")


def linked(one: DataFrame, two: DataFrame, rule=lambda ks: ks, width=F.size, rest=_any_key, most: int = MOST, chunk: int = CHUNK, cell: int = CELL) -> DataFrame:
    """s1_id, cid, each pair once: records of one and two (id, key) that share a key, or one that rule makes of a record's keys.

    Records of equal keys form classes.  Rows of classes meet at each key, a pair of rows passes at the first key that they
    share, and only then are its ids paired: no pair is shuffled, sorted or compared with others, so what is written on the
    way grows with the records, their keys and the sides of cells, much less than the pairs.  A key's pairs are dealt into cells of about `cell`, cut on
    both sides, as near to squares as the sides allow: a row goes to one row or column of cells, not to all.  Where that
    would take more than TASKS tasks, cells are larger.
    Records with more than `most` keys (width says how many the rule makes) go through rest, pair by pair."""
    sides = [written(d.groupBy("id").agg(F.collect_set("key").alias("ks")).withColumn("_long", width(F.col("ks")) > most), "keys") for d in (one, two)]
    short, long = ([d.where(c).drop("_long") for d in sides] for c in ("not _long", "_long"))
    left, right = (written(_classes(d, rule, chunk), "classes") for d in short)
    at = lambda d, n, rows: d.select(F.explode("ks").alias("key"), F.size("ids").alias("_n")).groupBy("key").agg(F.sum("_n").alias(n), F.count("*").alias(rows))
    met = at(left, "_n1", "_rows1").join(at(right, "_n2", "_rows2"), "key").withColumn("_work", F.col("_n1").cast("double") * F.col("_n2"))
    met = written(met, "met")
    total = met.agg(F.sum("_work")).first()[0] or 0
    held = F.ceil(F.col("_n2") * chunk / cell)  # a row of ids meets no more than the least cell has at a time, however large cells get
    cell = max(cell, math.ceil(total / TASKS))
    parts = 1 + int(total // cell)
    cut = lambda own, other, rows: F.greatest(F.least(F.ceil(F.col(own) * F.least(F.col(other), F.lit(math.sqrt(cell))) / cell), F.col(rows)), F.lit(1)).cast("int")
    met = met.select("key", cut("_n1", "_n2", "_rows1").alias("_cut1"), F.greatest(cut("_n2", "_n1", "_rows2"), F.least(held, F.col("_rows2"))).cast("int").alias("_cut2"))

    def dealt(rows: DataFrame, own: int, other: int) -> DataFrame:
        rows = rows.select(F.explode("ks").alias("key"), F.col("ks").alias(f"_ks{own}"), F.col("ids").alias(f"_ids{own}")).join(met, "key")
        rows = rows.withColumn(f"_at{own}", F.pmod(F.xxhash64(f"_ids{own}"), F.col(f"_cut{own}")).cast("int")).withColumn(f"_at{other}", F.explode(F.sequence(F.lit(0), F.col(f"_cut{other}") - 1)))
        return rows.drop("_cut1", "_cut2").repartition(parts, "key", "_at1", "_at2")

    left, right = dealt(left, 1, 2), dealt(right, 2, 1)
    met_first = left.join(right, ["key", "_at1", "_at2"]).where(F.array_min(F.array_intersect("_ks1", "_ks2")) == F.col("key"))
    out = met_first.select(F.explode("_ids1").alias("s1_id"), "_ids2").select("s1_id", F.explode("_ids2").alias("cid"))
    if not long[0].isEmpty():
        out = out.union(rest(long[0], sides[1].drop("_long")))
    if not long[1].isEmpty():
        out = out.union(rest(short[0], long[1]))
    return out


def _within(country, kind, key) -> "F.Column":
    """One string for a country's key; null where a part is."""
    return F.concat(kind, F.lit(":"), F.length(country).cast("string"), F.lit(":"), country, F.lit(":"), key)


def block(s1: DataFrame, pool: DataFrame, caps: dict[str, int] = POSTING_CAPS) -> DataFrame:
    return candidates(keys(s1, probe=True), cap(keys(pool), caps))


def block_simple(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Tokens, acronyms and name prefixes only, without caps."""
    side = lambda d: keys(d, families=("T", "A"), brand=False).select(F.col("entity_id").alias("id"), _within(F.col("country"), F.col("key_type"), F.col("key")).alias("key"))
    return linked(side(s1), side(pool))


def block_scored(s1: DataFrame, pool: DataFrame, k: int = 25, caps: dict[str, int] = POSTING_CAPS, token: int = 2, number: int = 3) -> DataFrame:
    """s1_id, cid, score: shared tokens and numbers add weights; the k best of each reference record, ties by id."""
    only = {"families": ("T", "N"), "brand": False, "prefix": False}
    by = ["country", "key_type", "key"]
    hits = keys(s1, **only).withColumnRenamed("entity_id", "s1_id").join(cap(keys(pool, **only), caps).withColumnRenamed("entity_id", "cid"), by)
    scored = hits.groupBy("s1_id", "cid").agg(F.sum(F.when(F.col("key_type") == "T", token).otherwise(number)).alias("score"))
    nth = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "cid"))
    return scored.withColumn("rank", nth).where(F.col("rank") <= k)


def block_rules(one: DataFrame, two: DataFrame) -> DataFrame:
    """Pairs of text variants that share a soundex of either word, the prefix or the suburb."""
    rules = ("sx1", "sx2", "prefix3", "suburb")
    some = F.filter(F.array(*[F.when(F.col(c) != "", F.concat(F.lit(f"{c}:"), c)) for c in rules]), lambda k: k.isNotNull())
    side = lambda d: d.select(F.col("entity_id").alias("id"), F.explode(some).alias("key"))
    return linked(side(one), side(two))


def _of(kind: str):
    return lambda ks: F.filter(ks, lambda k: k.startswith(f"{kind}:"))


_numbers, _tokens = _of("N"), _of("AT")


def _number_or_two_tokens(ks) -> "F.Column":
    """The numbers, and each two tokens together as one key."""
    tokens = F.array_sort(_tokens(ks))
    twos = F.transform(tokens, lambda x, i: F.transform(F.slice(tokens, i + 2, F.size(tokens)), lambda y: F.concat(x, F.lit(" "), y)))
    return F.concat(_numbers(ks), F.flatten(twos))


def _pair_keys(ks) -> "F.Column":
    """How many keys that makes."""
    numbers, tokens = F.size(_numbers(ks)), F.size(_tokens(ks)).cast("long")
    return numbers + tokens * (tokens - 1) / 2


def _overlapping(one: DataFrame, two: DataFrame) -> DataFrame:
    shared = spread(_exploded(one, "s1_id"), _exploded(two, "cid"), ["key"])
    n = shared.groupBy("s1_id", "cid").agg(F.count_if(F.col("key").startswith("N:")).alias("numbers"), F.count_if(F.col("key").startswith("AT:")).alias("tokens"))
    return n.where("numbers >= 1 or tokens >= 2").select("s1_id", "cid")


def address_overlap(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs of one country that share an address number, or two address tokens."""
    def side(d):
        numbers, tokens = (d.select(F.col("entity_id").alias("id"), "country", F.lit(kind).alias("kind"), F.explode(c).alias("key")) for kind, c in (("N", "addr_nums"), ("AT", "addr_tokens")))
        return numbers.union(tokens).select("id", _within(F.col("country"), F.col("kind"), F.col("key")).alias("key"))
    return linked(side(s1), side(pool), _number_or_two_tokens, _pair_keys, _overlapping)


def recall(pairs: DataFrame, truth_pairs: DataFrame, countries: DataFrame) -> DataFrame:
    """country (null: all), links, captured, recall."""
    hit = truth_pairs.join(pairs.withColumn("hit", F.lit(1)), ["s1_id", "cid"], "left").join(countries, "s1_id")
    out = hit.rollup("country").agg(F.count("*").alias("links"), F.count("hit").alias("captured"))
    return out.withColumn("recall", F.round(F.col("captured") / F.col("links"), 6))


def reduction(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """pairs, possible, reduction, per_entity; the cross product is only counted."""
    one, two = s1.agg(F.count("*").alias("n1")), pool.agg(F.count("*").alias("n2"))
    n = pairs.agg(F.count("*").alias("pairs")).join(F.broadcast(one), F.lit(True)).join(F.broadcast(two), F.lit(True))  # one row each
    return n.select("pairs", (F.col("n1") * F.col("n2")).alias("possible"), F.round(1.0 - F.col("pairs") / (F.col("n1") * F.col("n2")), 6).alias("reduction"), F.round(F.col("pairs") / F.col("n1"), 6).alias("per_entity"))
