"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words (weighted shares, capped at a multiple of its size).  A document's expected
number of copies is level * size ** TILT, at most `most`, the level of a source being such that expected words add up to
its target; sizes count by class (four to a doubling), so a source has as many inclusion probabilities as size classes.
The whole part of the expected number is given for certain; documents whose expected number is whole, those at the cap
among them, are split off.  What is left, p < 1, is the inclusion probability of a Pareto order sample: documents rank by
random odds over inclusion odds, u/(1-u) divided by p/(1-p), and a fixed number is taken.

Words come near the target since samples are drawn by size: each stratum (a doubling of size) has a fixed number of its
own, its sum of p rounded at random.  From the largest stratum to the smallest, the words that rounding adds or leaves go
over to the next, so that small documents make up for large ones; this leaves every p as it is on average, but where a
stratum has too few documents to make up for what it is handed, some p of a small source shift.  At last one document a source, taken or left out,
closes what the strata's means have left open, if that helps.

Plan: sizes are worked out in one narrow pass and written; all else reads that small table.  Counts by source and class,
and by source, stratum and bucket of the ranking (BUCKETS at most) combine before they are shuffled; running sums give
the bucket that holds each cut, and only documents of those buckets are ever sorted.  The cuts go back to the rows as a
table of one row a source and class.  A source that holds a third of the rows is never brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, read, text_of, written

BUCKETS = 4096
SALTS = 64
BROADCAST_ROWS = 20_000
BASE_WEIGHTS = (5.0, 2.0, 1.0)
TOTAL, MOST = 1.5, 2.0
SEED = "mix-1"


def size_of(text):
    """Number of words, i.e. runs of characters that are not white space.  One letter is left of each, so that no object a
    word is made."""
    return F.length(F.translate(F.regexp_replace(text, f"[^{SPACE}]+", "x"), "\t\n\x0b\x0c\r ", "")).cast("long")


def uniform(*parts):
    """A number in (0, 1) that depends on the parts alone."""
    digest = F.md5(F.concat(*[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def octave(size):
    """Of sizes from 1: how often they can be halved."""
    return F.length(F.bin(size)) - 1


def size_class(size):
    """Four classes a doubling; -1 for documents without words."""
    low = F.call_function("shiftleft", F.lit(1).cast("long"), octave(size))
    return F.when(size > 0, 4 * octave(size) + F.floor(4 * (size - low) / low).cast("int")).otherwise(-1)


def tilt(cls):
    """Fourth root of the smallest size of a class."""
    return F.sqrt(F.sqrt(F.pow(F.lit(2.0), F.floor(cls / 4)) * (1 + (cls % 4) / 4)))


def sized(docs: DataFrame, *keep, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, u, cls of every row, and the columns to keep."""
    rows = docs.select("doc_id", "source", size_of(text_of(docs)).alias("size"), *keep)
    return rows.withColumn("u", uniform(F.lit(seed), F.col("doc_id"))).withColumn("cls", size_class(F.col("size")))


def targets(sizes: DataFrame, weights=BASE_WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """source, source_size -> source, source_size, target: min(most * size, level * weight), the level being such that
    the targets add up to total * all sizes.  One row a source enters; the running sums over them are one task's."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    w = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    # Sources fill up in the order of cap / weight.  Before a source fills, those ahead of it are full.
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    w = w.withColumn("full", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    everything = Window.partitionBy(F.lit(1))
    w = w.withColumn("level", (total * F.sum("source_size").over(everything) - F.col("full")) / F.col("open"))
    w = w.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    # The first source whose share fits under its cap sets the level of all that follow.
    w = w.withColumn("level", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return w.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def expected(classes: DataFrame, shares: DataFrame, most: float = MOST) -> DataFrame:
    """classes (source, cls, n, words) with certain, the copies that are certain, and p, the inclusion probability."""
    c = classes.join(shares.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("g", tilt(F.col("cls")))
    fill = Window.partitionBy("source").orderBy(F.desc("cls"))  # the largest reach the cap first
    c = c.withColumn("full", most * F.coalesce(F.sum("words").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("open", F.sum(F.col("g") * F.col("words")).over(fill.rowsBetween(0, Window.unboundedFollowing)))
    c = c.withColumn("level", F.when(F.col("open") > 0, (F.col("target") - F.col("full")) / F.col("open")))
    fits = F.when(F.round(F.col("level") * F.col("g"), 9) <= most, F.col("level"))
    c = c.withColumn("level", F.first(fits, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    copies = F.when(F.col("cls") < 0, 0.0).otherwise(F.round(F.coalesce(F.least(F.col("level") * F.col("g"), F.lit(most)), F.lit(most)), 9))
    c = c.withColumn("copies", copies).withColumn("certain", F.floor("copies").cast("long"))
    return c.select("source", "cls", "n", "words", "source_size", "target", "certain", (F.col("copies") - F.col("certain")).alias("p"))


def numbers(classes: DataFrame, seed: str) -> DataFrame:
    """source, h, take: how many of each stratum the sample has."""
    h = F.floor(F.col("cls") / 4).cast("int")
    s = classes.where("p > 0").groupBy("source", h.alias("h")).agg(F.sum("n").alias("n"), F.sum(F.col("p") * F.col("n")).alias("sum_p"), F.sum(F.col("p") * F.col("words")).alias("sum_w"))
    s = s.withColumn("mean", F.col("sum_w") / F.col("sum_p")).withColumn("u", uniform(F.lit(seed + "-"), F.coalesce("source", F.lit("null")), F.lit("-"), F.col("h")))
    # At most one row a doubling of size: the strata of a source fit into an array.
    listed = s.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("h")).alias("k"), "n", "sum_p", "sum_w", "mean", "u"))).alias("strata"))
    none = F.array().cast("array<struct<h:int,take:bigint>>")

    def step(state, x):
        take = F.floor(F.round(x["sum_p"] + state["carry"] / x["mean"], 9) + x["u"]).cast("bigint")
        take = F.greatest(F.least(take, x["n"]), F.lit(0).cast("bigint"))
        return F.struct((state["carry"] + x["sum_w"] - take * x["mean"]).alias("carry"), F.concat(state["made"], F.array(F.struct((-x["k"]).alias("h"), take.alias("take")))).alias("made"))

    made = F.aggregate("strata", F.struct(F.lit(0.0).alias("carry"), none.alias("made")), step, lambda s: s["made"])
    return listed.select("source", F.explode(made).alias("m")).select("source", "m.h", "m.take")


def order_key():
    """Random odds over inclusion odds; null where nothing is left to chance."""
    return F.try_divide(F.col("u") / (1 - F.col("u")), F.col("_p") / (1 - F.col("_p")))


def bucket():
    return F.floor(order_key() / (1 + order_key()) * BUCKETS).cast("int")


def place():
    return F.struct(order_key().alias("key"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))


def by_class(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with the table's columns of their source and class, named with a leading _.  The table is broadcast when it is
    counted to be small; beyond that both sides are salted, so that no source gathers in one task."""
    t = table.select(*[F.col(c).alias(f"_{c}") for c in table.columns])
    same = rows.source.eqNullSafe(t._source) & (rows.cls == t._cls)
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(t), same).drop("_source", "_cls")
    t = t.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_mine", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return rows.join(t, rows.source.eqNullSafe(t._source) & (rows.cls == t._cls) & (rows._mine == t._salt)).drop("_source", "_cls", "_salt", "_mine")


def taken_by_rank():
    """Does the sample have the row?  Rows carry the plan's columns."""
    head = (bucket() < F.col("_cut")) | ((bucket() == F.col("_cut")) & (place() <= F.col("_last")))
    return F.coalesce((F.col("_p") > 0) & head, F.lit(False))


def plan(rows: DataFrame, seed: str = SEED, weights=BASE_WEIGHTS, total: float = TOTAL, most: float = MOST, close: bool = True) -> DataFrame:
    """doc_id, source, size, u, cls -> one row a source and class: source_size, target, certain copies, p, the stratum's cut
    in the ranking, and the document of the source that closes the gap, by one copy more or less.  close: is there one?"""
    classes = written(rows.groupBy("source", "cls").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-classes")
    shares = written(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total, most), "mix-shares")
    classes = written(expected(classes, shares, most).withColumn("h", F.floor(F.col("cls") / 4).cast("int")), "mix-expected")
    named = lambda d, *cs: d.select(F.col("source").alias("_s"), F.col("h").alias("_h"), *cs)
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("h") == F.col("_h"))
    drawn = classes.join(named(numbers(classes, seed), "take"), same, "left").drop("_s", "_h")
    drawn = written(drawn.withColumn("take", F.coalesce("take", F.lit(0).cast("long"))), "mix-numbers")
    held = by_class(rows, drawn.select("source", "cls", "p", "h", "take")).where("_p > 0 and _take > 0")
    counts = held.groupBy("source", F.col("_h").alias("h"), "_take", bucket().alias("bucket")).agg(F.count("*").alias("k"))
    running = Window.partitionBy("source", "h").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("k").over(running)).where(F.col("upto") >= F.col("_take"))
    cut = upto.groupBy("source", "h").agg(F.min("bucket").alias("cut"), F.min(F.col("upto") - F.col("k")).alias("before"))
    drawn = written(drawn.join(named(cut, "cut", "before"), same, "left").drop("_s", "_h"), "mix-cut")
    # Only the documents of the cuts' own buckets are put in order.
    near = by_class(rows, drawn.where("cut is not null").select("source", "cls", "p", "h", "take", "cut", "before")).where(bucket() == F.col("_cut"))
    nth = F.row_number().over(Window.partitionBy("source", "_h").orderBy(place()))
    last = near.withColumn("nth", nth).where(F.col("_before") + F.col("nth") <= F.col("_take")).groupBy("source", F.col("_h").alias("h")).agg(F.max(place()).alias("last"))
    drawn = written(drawn.join(named(last, "last"), same, "left").drop("_s", "_h"), "mix-last")
    if not close:
        return drawn.withColumn("closing", F.lit(None).cast("long")).withColumn("sign", F.lit(0))
    held = by_class(rows, drawn.select("source", "cls", "target", "certain", "p", "cut", "last")).withColumn("in", taken_by_rank())
    gap = held.groupBy("source").agg((F.first("_target") - F.sum(F.col("size") * (F.col("_certain") + F.col("in").cast("int")))).alias("gap"))
    gap = written(gap.withColumnRenamed("source", "_s"), "mix-gap")
    open_ = by_class(rows, written(drawn.join(gap, F.col("source").eqNullSafe(F.col("_s"))).select("source", "cls", "certain", "p", "cut", "last", "gap"), "mix-open")).withColumn("in", taken_by_rank())
    more = (F.col("_gap") > 0) & ~F.col("in") & (F.col("_certain") + 1 <= most)
    fewer = (F.col("_gap") < 0) & F.col("in")
    off = F.abs(F.col("size") - F.abs("_gap"))
    open_ = open_.where((more | fewer) & (F.col("size") > 0) & F.col("doc_id").isNotNull() & (off < F.abs("_gap")))
    closing = open_.groupBy(F.col("source").alias("_s")).agg(F.min_by("doc_id", F.struct(off, "u", "doc_id")).alias("closing"), F.first(F.signum("_gap").cast("int")).alias("sign"))
    return written(drawn.join(written(closing, "mix-closing"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-plan")


def with_copies(rows: DataFrame, made: DataFrame) -> DataFrame:
    """rows with copies, _source_size and _target."""
    rows = by_class(rows, made.select("source", "cls", "source_size", "target", "certain", "p", "cut", "last", "closing", "sign"))
    closes = F.when(F.col("doc_id") == F.col("_closing"), F.col("_sign")).otherwise(0)
    return rows.withColumn("copies", F.when(F.col("size") > 0, F.col("_certain") + taken_by_rank().cast("int") + closes).otherwise(0).cast("long"))


def mix(docs: DataFrame, seed: str = SEED, **kw) -> DataFrame:
    """docs (doc_id, text, source and any other columns) with size, source_size, target, copies (0 to 2).

    Nulls: a null text has size 0, a null source is a source of its own and comes last, null ids share a place in the
    ranking, behind equal ones.  Rows that share a doc_id and a size class are taken or left together.  Texts without words
    are taken no times.  An empty table gives an empty result.  Long texts are only counted.  Clashing columns are replaced
    by the operator's own.
    """
    own = ["size", "source_size", "target", "copies"]
    rows = _planned(docs, seed, **kw)
    return rows.select("doc.*", "size", "_source_size", "_target", "copies").toDF(*docs.columns, *[f"_{c}_" for c in own]).drop(*own).withColumnsRenamed({f"_{c}_": c for c in own})


def _planned(docs: DataFrame, seed: str, **kw) -> DataFrame:
    made = plan(written(sized(docs, seed=seed), "mix-sizes"), seed, **kw)
    return with_copies(sized(docs, F.struct(*[docs[c] for c in docs.columns]).alias("doc"), seed=seed), made)


def repeated(docs: DataFrame, seed: str = SEED, **kw) -> DataFrame:
    """Each document as often as the mix takes it.  All columns stay as they are, whatever their names."""
    rows = _planned(docs, seed, **kw).where("copies > 0").withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(sized(read(spark, sf_dir, "documents")), "mix-sizes")
    rows = with_copies(rows, plan(rows))
    return rows.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


#: The same rows by plain windows and a recursion over the strata.
SQL = r"""
WITH RECURSIVE s0 AS (SELECT doc_id, source,
  CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
  (CAST(('0x' || substr(md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents),
s AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) - 1 ELSE -1 END AS h, CASE WHEN size > 0 THEN 4 * (length(bin(size)) - 1) + 4 * (size - (1::BIGINT << (length(bin(size)) - 1))) // (1::BIGINT << (length(bin(size)) - 1)) ELSE -1 END AS cls FROM s0),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM z),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS full_,
  sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_, (SELECT sum(source_size) FROM z)::DOUBLE AS everything, row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS k FROM w),
l AS (SELECT (1.5::DOUBLE * everything - full_) / open_ AS level FROM f WHERE (1.5::DOUBLE * everything - full_) / open_ * weight <= cap ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM l) * weight), cap) AS target FROM w),
c0 AS (SELECT source, cls, any_value(h) AS h, count(*) AS n, CAST(sum(size) AS BIGINT) AS words, sqrt(sqrt(pow(2.0::DOUBLE, any_value(h)) * (1 + (cls % 4) / 4.0::DOUBLE))) AS g FROM s WHERE size > 0 GROUP BY source, cls),
c1 AS (SELECT c0.*, source_size, target, 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY c0.source ORDER BY cls DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_, sum(g * words) OVER (PARTITION BY c0.source ORDER BY cls DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_ FROM c0 JOIN t ON c0.source IS NOT DISTINCT FROM t.source),
lv AS (SELECT source, arg_max((target - full_) / open_, cls) AS level FROM c1 WHERE round((target - full_) / open_ * g, 9) <= 2 GROUP BY source),
c2 AS (SELECT c1.*, round(coalesce(least(level * g, 2.0::DOUBLE), 2.0::DOUBLE), 9) AS copies FROM c1 LEFT JOIN lv ON c1.source IS NOT DISTINCT FROM lv.source),
c AS (SELECT source, cls, h, n, words, CAST(floor(copies) AS BIGINT) AS certain, copies - floor(copies) AS p FROM c2),
h0 AS (SELECT source, h, CAST(sum(n) AS BIGINT) AS n, sum(p * n) AS sum_p, sum(p * words) AS sum_w FROM c WHERE p > 0 GROUP BY source, h),
h1 AS (SELECT *, sum_w / sum_p AS mean, (CAST(('0x' || substr(md5('mix-1-' || coalesce(source, 'null') || '-' || CAST(h AS VARCHAR)), 1, 12)) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u, row_number() OVER (PARTITION BY source ORDER BY h DESC) AS k FROM h0),
st AS (SELECT source, h, k, greatest(least(CAST(floor(round(sum_p, 9) + u) AS BIGINT), n), 0) AS take, sum_w - greatest(least(CAST(floor(round(sum_p, 9) + u) AS BIGINT), n), 0) * mean AS carry FROM h1 WHERE k = 1
  UNION ALL SELECT h1.source, h1.h, h1.k, greatest(least(CAST(floor(round(sum_p + carry / mean, 9) + u) AS BIGINT), n), 0), carry + sum_w - greatest(least(CAST(floor(round(sum_p + carry / mean, 9) + u) AS BIGINT), n), 0) * mean FROM st JOIN h1 ON h1.source IS NOT DISTINCT FROM st.source AND h1.k = st.k + 1),
r0 AS (SELECT s.*, coalesce(c.certain, 0) AS certain, coalesce(c.p, 0) AS p, CASE WHEN c.p > 0 THEN (s.u / (1 - s.u)) / (c.p / (1 - c.p)) END AS key FROM s LEFT JOIN c ON s.source IS NOT DISTINCT FROM c.source AND s.cls = c.cls),
r1 AS (SELECT r0.*, coalesce(p > 0 AND rank() OVER (PARTITION BY r0.source, r0.h, p > 0 ORDER BY key, doc_id IS NULL, doc_id) <= take, false) AS picked FROM r0 LEFT JOIN st ON r0.source IS NOT DISTINCT FROM st.source AND r0.h = st.h),
g AS (SELECT r1.source, any_value(target) - sum(size * (certain + CAST(picked AS BIGINT))) AS gap FROM r1 JOIN t ON r1.source IS NOT DISTINCT FROM t.source GROUP BY r1.source),
e AS (SELECT r1.source, arg_min(doc_id, (abs(size - abs(gap)), u, doc_id)) AS closing, any_value(sign(gap)) AS sgn FROM r1 JOIN g ON r1.source IS NOT DISTINCT FROM g.source
  WHERE ((gap > 0 AND NOT picked AND certain + 1 <= 2) OR (gap < 0 AND picked)) AND size > 0 AND doc_id IS NOT NULL AND abs(size - abs(gap)) < abs(gap) GROUP BY r1.source)
SELECT r1.doc_id, r1.size, t.source_size, t.target, CAST(r1.size * (certain + CAST(picked AS BIGINT) + CASE WHEN r1.doc_id = e.closing THEN sgn ELSE 0 END) AS BIGINT) AS taken
FROM r1 JOIN t ON r1.source IS NOT DISTINCT FROM t.source LEFT JOIN e ON r1.source IS NOT DISTINCT FROM e.source
"""
