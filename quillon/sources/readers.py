"""Scans: tab-separated records, ground truth, id lists, benchmark tables, ledgers, submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import numbered

RECORD = "entity_id string, business_name string, business_address string, country string"


def records_tsv(spark: SparkSession, path: str, country: str | None = None, quoted: bool = False) -> DataFrame:
    """Records of a TSV with a header.  Unquoted files (the default) take quote characters as they are; rows whose last
    column is empty are left out there, and an address `nan` is empty.  country: only its rows."""
    rows = spark.read.schema(RECORD).option("sep", "\t").option("header", True).option("quote", '"' if quoted else "").csv(path)
    if not quoted:
        rows = rows.where(F.col("country").isNotNull())
    rows = rows.select("entity_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("business_name", "business_address", "country")])
    rows = rows.withColumn("business_address", F.when(F.col("business_address") == "nan", "").otherwise(F.col("business_address")))
    return rows if country is None else rows.where(F.col("country") == country)


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first n by id: the same rows on every run."""
    return rows.orderBy("entity_id").limit(n)


def needed_or_background(rows: DataFrame, needed: DataFrame, background: int = 25_000) -> DataFrame:
    """All rows whose id is needed (entity_id), and the first `background` others of each source by id."""
    needed = needed.select("entity_id").distinct()
    others = rows.join(needed, "entity_id", "left_anti").withColumn("_source", F.split_part("entity_id", F.lit("-"), F.lit(1)))
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("_source").orderBy("entity_id"))
    return rows.join(needed, "entity_id", "left_semi").unionByName(others.withColumn("_nth", nth).where(F.col("_nth") <= background).drop("_source", "_nth"))


def parse_truth(truth: DataFrame) -> DataFrame:
    """s1_id, cids: the comma list as an array; blanks and `nan` are no ids."""
    ids = F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != "nan"))
    return truth.select(F.col("source1_entity_id").alias("s1_id"), ids.alias("cids"))


def truth_pairs(truth: DataFrame) -> DataFrame:
    return parse_truth(truth).select("s1_id", F.explode("cids").alias("cid")).distinct()


def truth_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source1_entity_id string, matched_entity_ids string").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def ids_of(spark: SparkSession, path: str) -> DataFrame:
    """First column of a tab-separated file without its header; blank lines are skipped."""
    lines = spark.read.text(path).select(F.trim(F.split_part("value", F.lit("\t"), F.lit(1))).alias("entity_id"))
    return lines.where((F.col("entity_id") != "") & ~F.col("entity_id").isin("entity_id", "source1_entity_id")).distinct()


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0, in the order of files and places in them), value: numbered over all parts of a file that is split."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    return numbered(rows, "line", "_file", "_block", "_id").select("line", "value")


def found(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths below a folder whose name matches a glob, on any file system that Spark reads, in order."""
    import fnmatch

    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files, out = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True), []
    while files.hasNext():
        path = files.next().getPath()
        if fnmatch.fnmatch(path.getName(), pattern):
            out.append(path.toString())
    return sorted(out)


def clean_cell(c) -> "F.Column":
    """Cells of scraped restaurant tables: outer quotes and blanks go, an escaped apostrophe is one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\'", "'"), r"^[`'\"\s\\]+|[`'\"\s\\]+$", ""))


def restaurants_csv(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Benchmark restaurant table -> records."""
    rows = spark.read.schema("id int, name string, addr string, city string, phone string, type string, class int").option("header", True).csv(path)
    return rows.select(F.concat(F.lit(f"{prefix}-"), "id").alias("entity_id"), clean_cell(F.col("name")).alias("business_name"), F.concat_ws(", ", clean_cell(F.col("addr")), clean_cell(F.col("city"))).alias("business_address"), F.lit("US").alias("country"))


def person_records(rows: DataFrame, prefix: str) -> DataFrame:
    """Person tables (rec_id, given_name, surname, street_number, address_1, address_2, suburb, state, postcode) -> records."""
    some = lambda *cs: F.concat_ws(" ", *[F.when(F.trim(c) != "", F.trim(c)) for c in cs])
    return rows.select(F.concat(F.lit(f"{prefix}-"), F.split_part("rec_id", F.lit("-"), F.lit(2))).alias("entity_id"), some("given_name", "surname").alias("business_name"), F.concat_ws(", ", *[F.when(x != "", x) for x in (some("street_number", "address_1", "address_2"), some("suburb"), some("state", "postcode"))]).alias("business_address"), F.lit("AU").alias("country"))


def text_variant(rows: DataFrame) -> DataFrame:
    """Lower-case name and address, first two name tokens and their soundex, three-letter prefix, last address part."""
    name, address = F.lower(F.coalesce("business_name", F.lit(""))), F.lower(F.coalesce("business_address", F.lit("")))
    w = lambda i: F.coalesce(F.get(F.split(name, " "), F.lit(i)), F.lit(""))
    return rows.select("entity_id", name.alias("name"), address.alias("address"), w(0).alias("w1"), w(1).alias("w2"), F.soundex(w(0)).alias("sx1"), F.soundex(w(1)).alias("sx2"), F.substring(name, 1, 3).alias("prefix3"), F.trim(F.element_at(F.split(address, ","), -1)).alias("suburb"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Experiment ledger: JSON lines with whatever keys each has, NaN allowed."""
    return spark.read.json(path)
