"""Tables by name below a folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of one file up to this size may have a single row group, which one task reads: its rows are dealt out.
SMALL_FILE = 256 << 20
#: Bytes of files for each task that rows are dealt out to, where that makes more tasks than cores.
DEALT = 128 << 20
ROW = "_dealt"


def uneven(sc: SparkContext, files: list[tuple[object, int]], cores: int) -> bool:
    """Whether one row group, which a single task reads, has more than twice a core's share of the files, (path, length) each. Only files of that size are opened, half as many as cores at most, and only their footers are read."""
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    share = 2 * sum(n for _, n in files) / cores
    for path, n in files:
        if n > share:
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
            try:
                if any(b.getCompressedSize() > share for b in reader.getRowGroups()):
                    return True
            finally:
                reader.close()
    return False


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table, with the partitions of its files. One small file is spread over the cores, and so is a table of any size whose row groups leave most of them idle. Sizes are asked of the file system and of footers; tables of many row groups are never shuffled for this."""
    path = f"{folder}/{name}.parquet"
    df = spark.read.parquet(path)
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(sc._jsc.hadoopConfiguration())
    status, cores = fs.getFileStatus(place), sc.defaultParallelism
    files = [(f.getPath(), f.getLen()) for f in fs.listStatus(place) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    total = sum(n for _, n in files)
    if status.isFile() and (1 << 20) < total < SMALL_FILE:
        return df.repartition(cores)
    if total > 1 << 20 and uneven(sc, files, cores):
        # by row numbers, which files give again in the same order: repartition(n) alone would sort the rows first
        return df.withColumn(ROW, F.monotonically_increasing_id()).repartition(max(cores, -(-total // DEALT)), ROW).drop(ROW)
    return df


#: The most that is broadcast for a join, by its measured size.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame) -> bool:
    """Whether its rows as text take BROADCAST_BYTES at most."""
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("n")).first().n or 0) <= BROADCAST_BYTES


def sized(df: DataFrame) -> DataFrame:
    """df, to be broadcast in a join if it is small(). A larger one is joined by shuffles, whose skewed parts Spark splits."""
    return F.broadcast(df) if small(df) else df


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share, spark.checkpoint.dir. Where the session names none, a local one is made, for a session that runs in this process alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", master := spark.sparkContext.master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="kugiri-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/kugiri-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives the loss of executors. The shuffle files behind it go as soon as it is written."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)
