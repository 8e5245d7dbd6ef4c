"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="introngrid-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/introngrid-{spark.sparkContext.applicationId}"


#: Bytes of input files that one task is to take: about a million rows of the narrow test tables.
SHARE = 16 << 20


def shares(df: DataFrame) -> int | None:
    """Tasks for a shuffle of df's rows, in step with the bytes of the files it reads; None where the session's number is enough."""
    spark = df.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    size = 0
    for folder in {f.rsplit("/", 1)[0] if "/part-" in f else f for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        size += path.getFileSystem(conf).getContentSummary(path).getLength()
    wanted = -(-size // SHARE)
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df with the rows of equal keys together, in as many tasks as its input asks for; left as it is where the session's number is enough."""
    wanted = shares(df)
    return df.repartition(wanted, *keys) if wanted else df


def gather(df: DataFrame, *keys: str) -> DataFrame:
    """spread(), which moves small tables by the keys as well, in the session's number of tasks."""
    wanted = shares(df)
    return df.repartition(wanted, *keys) if wanted else df.repartition(*keys)


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: later jobs start from files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._introngrid_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that no later job reads."""
    for table in tables:
        path = getattr(table, "_introngrid_path", None)
        if path:
            jvm = table.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            conf = table.sparkSession._jsparkSession.sessionState().newHadoopConf()
            target.getFileSystem(conf).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop the shuffle files of jobs that are over."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def bounded_broadcast(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Hint a broadcast only if df, a materialized table, has at most max_rows rows."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
