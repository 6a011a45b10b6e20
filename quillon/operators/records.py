"""Derived columns of a record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def derive(rows: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Records with every normalised string and key set.  ascii_only: the input needs no transliteration."""
    name, address = (F.coalesce(c, F.lit("")) if ascii_only else T.transliterate(c) for c in ("business_name", "business_address"))
    r = rows.select("entity_id", "country", F.split_part("entity_id", F.lit("-"), F.lit(1)).alias("source"), name.alias("name"), address.alias("address"))
    r = r.withColumns({"norm_name": T.normalise("name"), "norm_address": T.normalise("address", address=True), "parsed": T.parse_address("address")})
    n, a = F.col("norm_name"), F.col("norm_address")
    r = r.withColumns({"sig_tokens": T.sig_tokens(n), "stripped_name": T.strip_legal(n), "compact_brand": T.compact_brand(n), "acronyms": T.acronyms(n), "unit_keys": T.unit_keys("address"), "addr_tokens": T.distinctive_tokens(a), "addr_nums": T.address_numbers("address"), "house_codes": T.house_codes("address"), "c3_name": T.char_grams(n), "c3_addr": T.char_grams(a)})
    return r.withColumn("phonetic", T.as_set(F.transform("sig_tokens", T.skeleton)))
