"""Tables that several plans share, written once a session to the shared folder and read back as Parquet."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PATHS: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in a local session where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/quillon-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listing(spark: SparkSession, path: str) -> tuple:
    """Files of a table with their sizes and times."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def staged(spark: SparkSession, key: tuple, make: Callable[[], DataFrame], source: str) -> DataFrame:
    """make() as a written table.  Costly expressions are worked out once for all plans that start from them, scans read
    only the columns that they need, and lost executors cost no recomputation.  source: the table that make() starts
    from; when its files change, the table is made anew."""
    k = (spark.sparkContext.applicationId, *key, source, listing(spark, source))
    if k not in _PATHS:
        path = f"{shared_folder(spark)}/quillon-{key[0]}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _PATHS[k] = path
    return spark.read.parquet(_PATHS[k])


_RUN = 1 << 33  # ids that monotonically_increasing_id gives a partition


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with their place (from 0) in the order.  Ranges are dealt and sorted side by side; only their sizes, one row a
    range, are added up."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("_id", F.monotonically_increasing_id()), "places")
    dealt = dealt.withColumn("_part", F.floor(F.col("_id") / _RUN)).withColumn("_nth", F.col("_id") % _RUN)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(ranges), "_part").withColumn(name, F.col("_before") + F.col("_nth")).drop("_id", "_part", "_nth", "_before")
