"""Written tables for iterations: lineage is cut in the folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables: ``spark.checkpoint.dir``, as the session has it.

    Where it is unset, a session in one process gets a folder of its own; on a cluster that
    would be a disk that other machines don't see, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write once, read back: later rounds start from files that all executors share."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files behind ``written`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def numbered(df: DataFrame, *order: Column | str, name: str = "k", start: int = 1) -> DataFrame:
    """``df`` with its rows numbered in an order, without all of them in one task.

    Rows are dealt by ranges of the order and written with their range; a range is numbered from
    the number of rows in the ranges before it (one row a range).
    """
    dealt = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(W.Window.orderBy("__range").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.Window.partitionBy("__range").orderBy(*order))
    placed = dealt.withColumn("__at", inside).join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range")
    return placed.withColumn(name, (F.col("__before") + F.col("__at") - 1 + start).cast("int")).drop("__range", "__at", "__before")


def running_counts(rows: DataFrame, value: str, descending: bool = False) -> DataFrame:
    """(value, c, upto): how often each distinct value is there, and how many rows have it or one before it.

    Counts are dealt by ranges of the value; a range's running sum begins with the sizes of the ranges before it
    (one row a range), so no task sees all distinct values.  Nulls are left out.
    """
    order = F.col(value).desc() if descending else F.col(value).asc()
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    dealt = written(counts.repartitionByRange(order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.sum("c").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(W.Window.orderBy("__range").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("c").over(W.Window.partitionBy("__range").orderBy(order))
    return dealt.withColumn("__inside", inside).join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range").select(value, "c", (F.col("__before") + F.col("__inside")).alias("upto"))
