"""Checks of an output file against its contract: one row a rule, with its severity, count and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADERS = {"matching": "source1_entity_id\tmatched_entity_ids", "candidate": "source1_entity_id\tcandidate_entity_ids"}


def parse_lines(lines: DataFrame, header: str) -> DataFrame:
    """lines (line, value) -> line, kind (header, bad_header, comma_header, no_tab, row), s1_id, ids."""
    first = F.col("line") == 0
    tab = F.instr("value", "\t")
    ids = F.filter(F.transform(F.split(F.expr("substr(value, instr(value, '\t') + 1)"), ","), lambda x: F.trim(x)), lambda x: x != "")
    kind = F.when(first & (F.trim("value") == header), "header").when(first & F.col("value").contains(",") & (tab == 0), "comma_header").when(first, "bad_header").when(F.trim("value") == "", "blank").when(tab == 0, "no_tab").otherwise("row")
    return lines.select("line", kind.alias("kind"), F.when(kind == "row", F.trim(F.split_part("value", F.lit("\t"), F.lit(1)))).alias("s1_id"), F.when(kind == "row", ids).alias("ids"))


def rules(parsed: DataFrame, s1: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """rule, severity, n, examples of a parsed file.  s1 (s1_id): the ids that need one row each; known (cid): all ids
    that a list may name, where that is to be checked."""
    rows = parsed.where("kind = 'row'")
    ids = rows.select("s1_id", F.explode("ids").alias("cid"))
    found = [parsed.where(F.col("kind") == k).select(F.lit(k).alias("rule"), F.concat(F.lit("line "), F.col("line")).alias("what")) for k in ("bad_header", "comma_header", "no_tab")]
    say = lambda name, d, c: found.append(d.select(F.lit(name).alias("rule"), F.col(c).alias("what")))
    say("duplicate_row", rows.groupBy("s1_id").count().where("count > 1"), "s1_id")
    say("repeated_id", rows.where("size(ids) <> size(array_distinct(ids))"), "s1_id")
    say("self_match", ids.where("cid like 'S1-%'"), "cid")
    say("bad_prefix", ids.where("not (cid like 'S1-%' or cid like 'S2-%' or cid like 'S3-%')"), "cid")
    say("missing_record", s1.select("s1_id").join(rows, "s1_id", "left_anti"), "s1_id")
    say("extra_record", rows.select("s1_id").distinct().join(s1, "s1_id", "left_anti"), "s1_id")
    if known is not None:
        say("unknown_id", ids.where("cid like 'S2-%' or cid like 'S3-%'").select("cid").distinct().join(known, "cid", "left_anti"), "cid")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return summary(out, "error")


def summary(faults: DataFrame, severity: str, examples: int = 3) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("rule").orderBy("what"))
    few = faults.withColumn("nth", nth).where(F.col("nth") <= examples).groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("what")), ",").alias("examples"))
    return faults.groupBy("rule").agg(F.count("*").alias("n")).join(few, "rule").select("rule", F.lit(severity).alias("severity"), "n", "examples")


def not_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches (s1_id, ids) that are not among the candidates: a warning."""
    pairs = lambda d: d.where("kind = 'row'").select("s1_id", F.explode("ids").alias("cid"))
    gone = pairs(matches).join(pairs(candidates), ["s1_id", "cid"], "left_anti")
    return summary(gone.select(F.lit("not_a_candidate").alias("rule"), F.concat_ws(":", "s1_id", "cid").alias("what")), "warning")


def prediction_diff(one: DataFrame, two: DataFrame) -> DataFrame:
    """s1_id, only_first, only_second: pairs of either run that the other lacks."""
    both = one.select("s1_id", "cid", F.lit(1).alias("x")).join(two.select("s1_id", "cid", F.lit(1).alias("y")), ["s1_id", "cid"], "full_outer")
    return both.groupBy("s1_id").agg(F.count_if(F.col("y").isNull()).alias("only_first"), F.count_if(F.col("x").isNull()).alias("only_second")).where("only_first + only_second > 0")
