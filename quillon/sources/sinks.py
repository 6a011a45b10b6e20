"""Sinks: match and candidate lists, ledgers, reports, models, packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_rows(s1: DataFrame, matches: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row for each id of s1 (s1_id): its matches (s1_id, cid, rank) as a comma list in rank order, empty without any."""
    lists = matches.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cid"))), lambda x: x["cid"]), ",").alias(column))
    return s1.select("s1_id").join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def candidate_rows(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each id of s1: all its candidates as a sorted comma list."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cid")), ",").alias("candidate_entity_ids"))
    return s1.select("s1_id").join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("candidate_entity_ids", F.lit("")).alias("candidate_entity_ids"))


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated part files with a header, no quoting, empty for null."""
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("nullValue", "").csv(path)


def append_ledger(row: DataFrame, path: str) -> None:
    row.write.mode("append").json(path)


def keep_best(row: DataFrame, path: str, metric: str) -> bool:
    """Overwrites the stored one-row report if the new one scores higher; says whether it did."""
    spark = row.sparkSession
    try:
        best = spark.read.json(path).agg(F.max(metric)).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        best = None
    new = row.first()[metric]
    if best is not None and new <= best:
        return False
    row.write.mode("overwrite").json(path)
    return True


def report_json(row: DataFrame) -> DataFrame:
    return row.select(F.to_json(F.struct(*row.columns)).alias("report"))


def package(spark, paths: dict[str, str], target: str) -> str:
    """Rows of finished TSV folders in one zip: name -> folder.  For outputs that a person carries away: lines come to the
    driver one partition at a time, and target is a file of the driver."""
    import zipfile

    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name, folder in paths.items():
            rows = spark.read.text(folder).withColumn("file", F.col("_metadata.file_path")).withColumn("at", F.monotonically_increasing_id())
            with z.open(name, "w") as out:
                header = None
                for r in rows.toLocalIterator():
                    if header is None:
                        header = r.value
                        out.write(f"{r.value}\n".encode())
                    elif r.value != header:
                        out.write(f"{r.value}\n".encode())
    return target
