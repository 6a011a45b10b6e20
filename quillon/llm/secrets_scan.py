"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Every version of every document is addressed by the digest of its text.  The ledger keeps, for each blob and rule
version, the spans that were found, so a run scans only pairs that the ledger does not hold yet, each blob once however
many paths and versions carry it, and joins the findings back to all of them.  Blobs are brought together by digest with
map-side combination (a copy leaves a task once); the join back is between written tables, which adaptive execution can
split where one blob belongs to a third of all rows.

A match's place follows from the text between the matches: the pieces that split() leaves and the matches that
regexp_extract_all() returns interleave, so running sums of their lengths, taken by doubling, are code-point offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, scratch, written

#: kind -> (pattern, group whose length counts, least length).  The first three are fixed by the contract.
BASE_RULES = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
MORE_RULES = {
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "webtoken": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    "forge": (r"(?:gh[pousr]_|glpat-)[A-Za-z0-9_-]+", 0, 24),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    "bearer": (r"(?i)bearer\x20+([A-Za-z0-9+/_.=~-]+)", 1, 20),
}
RULES = BASE_RULES | MORE_RULES
RULE_VERSION = "3"
#: A cheap look at the text that every match of the rule passes: where it fails, nothing is extracted.
GUARD = {"hex": r"[0-9a-f]{24}"}


def running(a):
    """Running sums of an array, by doubling: its length times the logarithm of its length."""
    return F.aggregate(
        F.array(*[F.lit(1 << i) for i in range(31)]),
        a,
        lambda s, n: F.when(n < F.size(s), F.zip_with(s, F.concat(F.array_repeat(F.lit(0), n), F.slice(s, F.lit(1), F.size(s) - n)), lambda x, y: x + y)).otherwise(s),
    )


def spans(text, kind: str, number: int):
    """Array of (start, rule order, end, kind) of the matches that are long enough, in order; code points, end exclusive."""
    pattern, group, least = RULES[kind]
    if kind in GUARD:  # runs that are too short can't hide a longer one, so they needn't be matched at all
        pattern = pattern.replace("+", f"{{{least},}}")
    elif kind == "access":
        pattern = pattern.replace("+", f"{{{least - 4},}}")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), kept.alias("key"))
    lengths = F.transform(parts, lambda x: F.struct((F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("both"), F.length(x["hit"]).alias("hit"), F.length(x["key"]).alias("long")))
    none = F.array().cast("array<struct<start:int,nr:int,end:int,kind:string,long:int>>")

    def placed(ps):
        ends = running(F.transform(ps, lambda x: x["both"]))
        found = F.zip_with(ps, ends, lambda x, end: F.struct((end - x["hit"]).alias("start"), F.lit(number).alias("nr"), end.alias("end"), F.lit(kind).alias("kind"), x["long"].alias("long")))
        return F.filter(found, lambda x: x["long"] >= least)  # null behind the last match

    walk = F.get(F.transform(F.array(lengths), placed), F.lit(0))  # an array of one binds the lengths, so that they are worked out once
    return F.when(text.rlike(GUARD.get(kind, pattern)), walk).otherwise(none)


def blobs(docs: DataFrame) -> DataFrame:
    """Each distinct text once: blob, text."""
    return docs.select(blob().alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])


def blob():
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def scan(fresh: DataFrame) -> DataFrame:
    """blob, text -> blob, rule_version, found (spans by start, then rule order)."""
    found = F.array_sort(F.concat(*[spans(F.col("text"), k, i) for i, k in enumerate(RULES)]))
    return fresh.select("blob", F.lit(RULE_VERSION).alias("rule_version"), found.alias("found"))


def update_ledger(docs: DataFrame, ledger: str) -> DataFrame:
    """Scans the blobs of docs that the ledger (a path) lacks under this rule version, appends them, returns the ledger's
    rows of this version.  Blobs without findings are kept too: they have been looked at."""
    spark = docs.sparkSession
    schema = "blob string, rule_version string, found array<struct<start:int,nr:int,end:int,kind:string,long:int>>"
    fresh = blobs(docs)
    if known(spark, ledger):
        seen = spark.read.schema(schema).parquet(ledger).where(F.col("rule_version") == RULE_VERSION)
        fresh = written(docs.select("text").withColumn("_blob", blob()).join(seen.select(F.col("blob").alias("_blob")), "_blob", "left_anti").drop("_blob"), "unseen")
        fresh = blobs(fresh)
    scan(fresh).write.mode("append").parquet(ledger)
    return spark.read.schema(schema).parquet(ledger).where(F.col("rule_version") == RULE_VERSION)


def known(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def find_secrets(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, found: every row, with its spans.

    Null and empty texts have no spans; repeated rows each get theirs; an empty table gives an empty result.  Columns but
    doc_id and text are not looked at.  Texts are searched whole; the work grows with their length and n log n of the matches.  ledger: where findings of earlier runs are kept; a fresh one where None.
    """
    rows = update_ledger(docs, ledger or scratch(docs.sparkSession, "ledger"))
    hits = written(rows.where(F.size("found") > 0).select(F.col("blob").alias("_of"), "found"), "secrets")
    paths = docs.select("doc_id", blob().alias("_blob"))
    return paths.join(hits, F.col("_blob") == F.col("_of"), "left").select("doc_id", "found")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.coalesce("found", F.array().cast("array<struct<start:int,nr:int,end:int,kind:string,long:int>>"))
    rows = find_secrets(read(spark, sf_dir, "documents")).select("doc_id", found.alias("found"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["nr"] < len(BASE_RULES))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, BASE_RULES), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
