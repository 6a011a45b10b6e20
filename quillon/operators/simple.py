"""The small feature set: light normalisers, one number and one postal code of an address, eleven columns of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..functions import vocabulary as V
from . import features

COLUMNS = ["clean_name", "clean_address", "name_tokens", "address_tokens", "initials", "number", "code"]


def clean(c: Column) -> Column:
    """Lower case without marks; letters behind an initial and its dot are drawn together; other signs become spaces."""
    c = T.strip_accents(F.lower(F.trim(T.text(c))))
    joined = F.transform(F.regexp_extract_all(c, F.lit(V.DOTTED), F.lit(0)), lambda m: F.translate(m, ". ", ""))
    # What split() leaves and what the pattern finds take turns.
    turns = F.arrays_zip(F.split(c, V.DOTTED, -1).alias("gap"), joined.alias("hit"))
    c = F.array_join(F.transform(turns, lambda x: F.concat(x["gap"], F.coalesce(x["hit"], F.lit("")))), "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_]", " "), " +", " "))


def tokens(cleaned: Column) -> Column:
    """Words of three letters or more that say something."""
    return T.as_set(F.filter(F.split(cleaned, " "), lambda w: (F.length(w) >= 3) & ~w.isin(*V.SIMPLE_STOPWORDS)))


def long_numbers(c) -> Column:
    """Set of the numbers of three to six digits."""
    return T.as_set(F.regexp_extract_all(T.text(c), F.lit(r"(?U)\b\d{3,6}\b"), F.lit(0)))


def initials(cleaned: Column) -> Column:
    """First letters of the words of two letters or more, five at most."""
    long = F.filter(F.split(cleaned, " "), lambda w: F.length(w) > 1)
    return F.array_join(F.transform(F.slice(long, 1, 5), lambda w: F.substring(w, 1, 1)), "")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _parts(c: Column) -> Column:
    """What stands between commas."""
    return F.filter(F.transform(F.split(c, ","), _strip), lambda x: x != "")


def parse_address(c, style: str = "robust") -> Column:
    """Struct of number, postcode, street and locality; nulls are empty.

    leading: a number counts at the beginning alone.  keyword: also behind a word for a plot or a door, and behind a word for
    a street, where it stays in the street.  robust: behind a word for a plot or a door, at the beginning, or at the end of
    the first part.
    """
    whole = _strip(T.text(c))
    left = _strip(F.regexp_replace(whole, V.SIMPLE_CODE, ""))
    ways = {"leading": ["lead"], "keyword": ["prefix", "lead", "street"], "robust": ["prefix", "lead", "tail"]}[style]
    pattern = {"prefix": rf"(?iU){V.HOUSE_PREFIX}{V.HOUSE}\b", "lead": rf"(?iU)^{V.HOUSE}\b", "street": rf"(?iU){V.HOUSE_STREET}{V.HOUSE}\b", "tail": rf"(?iU)\b{V.HOUSE}\s*$"}
    first = F.coalesce(F.get(_parts(left), F.lit(0)), F.lit(""))
    number = {w: F.lower(_strip(F.regexp_extract(first if w == "tail" else left, pattern[w], 1))) for w in ways}
    without = {
        "prefix": F.array_join(F.split(left, pattern["prefix"], 2), ""),
        "lead": F.btrim(F.array_join(F.split(left, pattern["lead"], 2), ""), F.lit(", ")),
        "street": left,
        "tail": F.array_join(F.concat(F.array(F.regexp_replace(first, pattern["tail"], "")), F.slice(_parts(left), F.lit(2), F.size(_parts(left)))), ", "),
    }
    hit = [number[w] != "" for w in ways]
    choose = lambda values, rest: F.coalesce(*[F.when(h, v) for h, v in zip(hit, values)], rest)
    parts, n = _parts(choose([without[w] for w in ways], left)), F.size(_parts(choose([without[w] for w in ways], left)))
    return F.struct(
        choose(number.values(), F.lit("")).alias("number"),
        F.regexp_extract(whole, V.SIMPLE_CODE, 0).alias("postcode"),
        F.lower(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(1))), ", ")).alias("street"),
        F.when(n > 1, F.lower(F.element_at(parts, -1))).otherwise("").alias("locality"),
    )


def derive(rows: DataFrame) -> DataFrame:
    """Records (entity_id, business_name, business_address) with the columns that the small set compares.  Nulls are empty."""
    rows = rows.select("entity_id", clean(F.col("business_name")).alias("clean_name"), clean(F.col("business_address")).alias("clean_address"), T.text("business_address").alias("_address"))
    made = {
        "name_tokens": tokens(F.col("clean_name")),
        "address_tokens": tokens(F.col("clean_address")),
        "initials": initials(F.col("clean_name")),
        "number": F.lower(F.regexp_extract("_address", V.SIMPLE_NUMBER, 0)),
        "code": F.regexp_extract("_address", V.SIMPLE_CODE, 0),
    }
    return rows.withColumns(made).select("entity_id", *COLUMNS)


def eleven(paired: DataFrame) -> DataFrame:
    """s1_id, cid and eleven columns of pairs of derived records (structs a and b)."""
    both = lambda c: (F.col(f"a.{c}"), F.col(f"b.{c}"))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    (n1, n2), (a1, a2), (i1, i2), number, code = map(both, ("clean_name", "clean_address", "initials", "number", "code"))
    lacks = lambda x, y: flag((x == "") | (y == ""))
    alike = lambda x, y: F.when((x == "") | (y == ""), 0.0).otherwise(S.sequence_ratio(x, y))
    short = (F.length(i1) >= 2) & ((i1 == n2) | (i2 == n1) | (i1 == i2))
    return paired.select(
        "s1_id",
        "cid",
        F.round(S.jaccard(*both("name_tokens")), 6).alias("name_jaccard"),
        F.round(alike(n1, n2), 6).alias("name_ratio"),
        flag(short).alias("acronym"),
        F.round(S.jaccard(*both("address_tokens")), 6).alias("address_jaccard"),
        F.round(alike(a1, a2), 6).alias("address_ratio"),
        features.agree(*number).alias("number"),
        lacks(*number).alias("number_missing"),
        features.agree(*code).alias("code"),
        lacks(*code).alias("code_missing"),
        lacks(a1, a2).alias("address_missing"),
        F.round(F.abs(F.length(n1) - F.length(n2)) / F.greatest(F.length(n1), F.length(n2), F.lit(1)), 6).alias("length_gap"),
    )
