"""Matching quality: precision-weighted F per record, pair-level measures, sweeps and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(n, of) -> Column:
    """n / of as SQL doubles divide: 0 / 0 is NaN and n / 0 infinite, where Spark's own division would be an error."""
    n, of = n.cast("double"), of.cast("double")
    by_none = F.when((n == 0) | F.isnan(n), float("nan")).otherwise(F.signum(n) * float("inf"))
    return F.when(of == 0, F.when(n.isNotNull(), by_none)).otherwise(F.try_divide(n, of))


def per_record(s1: DataFrame, pred: DataFrame, truth_pairs: DataFrame, *by: str) -> DataFrame:
    """s1_id (and other columns of s1), p, r, f05 for every record of s1; a record without true matches scores 1 if nothing
    is predicted, else 0.  by: columns of pred and s1 that part the predictions."""
    marked = pred.select(*by, "s1_id", "cid", F.lit(1).alias("said")).distinct().join(truth_pairs.withColumn("is_true", F.lit(1)), ["s1_id", "cid"], "left")
    said = marked.groupBy(*by, "s1_id").agg(F.count("*").alias("n_pred"), F.count("is_true").alias("tp"))
    true = truth_pairs.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    all_ = s1.join(said, [*by, "s1_id"], "left").join(true, "s1_id", "left").fillna(0, ["n_pred", "tp", "n_true"])
    none, empty = F.col("n_true") == 0, F.col("n_pred") == 0
    p = F.when(none & empty, 1.0).when(none | empty, 0.0).otherwise(F.col("tp") / F.col("n_pred"))
    r = F.when(none, 1.0).when(empty, 0.0).otherwise(F.col("tp") / F.col("n_true"))
    f = F.when(none, F.when(empty, 1.0).otherwise(0.0)).when(F.col("tp") > 0, 1.25 * F.col("p") * F.col("r") / (0.25 * F.col("p") + F.col("r"))).otherwise(0.0)
    return all_.withColumn("p", p).withColumn("r", r).withColumn("f05", f)


def macro(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("f05", "p", "r")])


def macro_by_country(scores: DataFrame) -> DataFrame:
    """One row a country and one for all (country null)."""
    return scores.rollup("country").agg(F.count("*").alias("n"), F.round(F.avg("f05"), 6).alias("macro_f05"))


def sweep(scored: DataFrame, s1: DataFrame, truth_pairs: DataFrame, thresholds: list[float], most: int = 12) -> DataFrame:
    """t, macro_f05 for each threshold: the pairs are resolved once for each, all in one plan."""
    from .resolve import ranked, winners

    ts = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("t")
    at = scored.select("*", ts).where(F.col("p") >= F.col("t"))
    pred = ranked(winners(at, "t"), most, "t")
    return per_record(s1.select("*", ts), pred, truth_pairs, "t").groupBy("t").agg(F.round(F.avg("f05"), 6).alias("macro_f05"))


def best_threshold(swept: DataFrame, *by: str) -> DataFrame:
    """The first threshold with the highest score."""
    return swept.groupBy(*by).agg(F.max_by("t", F.struct("macro_f05", -F.col("t"))).alias("t"), F.max("macro_f05").alias("macro_f05"))


def pair_level(pred: DataFrame, truth_pairs: DataFrame, beta: float = 0.5) -> DataFrame:
    """tp, fp, fn and precision, recall, F of pairs; NaN where nothing is predicted, as in SQL."""
    both = pred.select("s1_id", "cid").distinct().withColumn("_p", F.lit(1)).join(truth_pairs.withColumn("_t", F.lit(1)), ["s1_id", "cid"], "full_outer")
    n = both.agg(F.count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    p, r, b2 = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn")), beta * beta
    return n.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio((1 + b2) * p * r, b2 * p + r), 6).alias("f"))


def bands(scored: DataFrame, edges: list[float]) -> DataFrame:
    """band (upper edge), n of scores; the last band is open."""
    band = F.lit(float("inf"))
    for e in sorted(edges, reverse=True):
        band = F.when(F.col("p") < e, float(e)).otherwise(band)
    return scored.groupBy(F.when(band == float("inf"), F.lit(99.0)).otherwise(band).alias("band")).agg(F.count("*").alias("n"))


def fn_reason() -> Column:
    """Why a true pair (records a and b) may have been missed."""
    a, b = "a.norm_address", "b.norm_address"
    return (
        F.when((F.col(a) == "") | (F.col(b) == ""), "missing_address")
        .when((F.col("a.parsed.number") != "") & (F.col("b.parsed.number") != "") & (F.col("a.parsed.number") != F.col("b.parsed.number")), "number_conflict")
        .when(~F.arrays_overlap("a.sig_tokens", "b.sig_tokens"), "no_shared_token")
        .when(F.col("a.stripped_name") != F.col("b.stripped_name"), "name_variant")
        .otherwise("other")
    )


def multi_claims(scored: DataFrame, t: float) -> DataFrame:
    """Candidates that several records claim at t or above; without any claim the rate is NaN, as in SQL."""
    n = scored.where(F.col("p") >= t).groupBy("cid").agg(F.count_distinct("s1_id").alias("k"))
    return n.agg(F.count("*").alias("claimed"), F.count_if(F.col("k") > 1).alias("multi")).withColumn("rate", F.round(ratio(F.col("multi"), F.col("claimed")), 6))


def describe_counts(pairs: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles, max of candidates per record."""
    n = pairs.groupBy("s1_id").agg(F.count("*").alias("n"))
    q = [F.round(F.percentile("n", x), 6).alias(a) for a, x in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return n.agg(F.count("*").alias("n_records"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").alias("least"), *q, F.max("n").alias("most"))


def token_frequency(rec: DataFrame) -> DataFrame:
    return rec.select("country", F.explode("sig_tokens").alias("token")).groupBy("country", "token").agg(F.count("*").alias("df"))


def exact_leaks(truth_pairs: DataFrame, records: DataFrame) -> DataFrame:
    """True pairs whose raw addresses are the same."""
    a, b = (records.select(F.col("entity_id").alias(k), F.col("business_address").alias(x)) for k, x in (("s1_id", "x"), ("cid", "y")))
    return truth_pairs.join(a, "s1_id").join(b, "cid").agg(F.count("*").alias("pairs"), F.count_if(F.col("x") == F.col("y")).alias("same_address"))


def singletons(truth: DataFrame) -> DataFrame:
    return truth.agg(F.count_if(F.size("cids") == 0).alias("singletons"), F.count_if(F.size("cids") > 0).alias("matched"))
