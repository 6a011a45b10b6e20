"""TF-IDF: weights fitted once, vectors as long tables (name, term, w) or packed into arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_terms(c: Column) -> Column:
    """Words of two and more characters, and pairs of neighbours."""
    w = F.regexp_extract_all(F.lower(c), F.lit(r"\b\w\w+\b"), F.lit(0))
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(w, pairs)


def char_terms(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words padded with a space on either side; a word shorter than n counts once, whole."""
    words = F.transform(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))

    def one(w: Column, n: int) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))
        short = F.array(w) if n == low else F.array().cast("array<string>")
        return F.when(F.length(w) >= n, many).otherwise(short)

    return F.flatten(F.transform(words, lambda w: F.flatten(F.array(*[one(w, n) for n in range(low, high + 1)]))))


def fit(names: DataFrame, terms: Column, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """names (name, distinct) -> term, idf: ln((1 + n) / (1 + df)) + 1.  Terms in fewer than min_df names or in more than the
    share max_df are no terms.  What is fitted on one set of names weighs any other."""
    n = F.broadcast(names.agg(F.count("*").alias("n")))  # one row
    df = names.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = df.join(n, F.lit(True)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    return df.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def vectors(names: DataFrame, terms: Column, idf: DataFrame, sublinear: bool = False) -> DataFrame:
    """names (name, distinct) -> name, term, w: tf * idf, scaled to length 1; sublinear: 1 + ln tf in place of tf."""
    tf = names.select("name", F.explode(terms).alias("term")).groupBy("name", "term").agg(F.count("*").alias("tf"))
    w = tf.join(idf, "term").select("name", "term", ((1 + F.log("tf") if sublinear else F.col("tf")) * F.col("idf")).alias("w"))
    length = w.groupBy("name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return w.join(length, "name").select("name", "term", (F.col("w") / F.col("length")).alias("w"))


def packed(vecs: DataFrame, prefix: str) -> DataFrame:
    """name with its terms, as numbers, and their weights in arrays: what one name has is bounded by its length."""
    pairs = F.array_sort(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "w")))
    both = vecs.groupBy("name").agg(pairs.alias("v"))
    return both.select("name", F.col("v.t").alias(f"{prefix}_terms"), F.col("v.w").alias(f"{prefix}_weights"))
