"""Session helpers shared by every job."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the cluster names in ``spark.checkpoint.dir``. Where none is set, a
    new temporary folder for a local session (tests); on a cluster that is an error, since executors share no local folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input files (some 200,000 contract rows) for each partition of a large shuffle.
EACH = 4 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files under a DataFrame; 0 where there are none (checkpoints, given rows)."""
    spark = df.sparkSession
    conf, Path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return sum((p := Path(f)).getFileSystem(conf).getFileStatus(p).getLen() for f in df.inputFiles())


def many_parts(df: DataFrame, *more: DataFrame) -> int | None:
    """How many partitions a shuffle of these tables needs, so that one task's share does not grow with them; None if the
    session's own number is enough."""
    n = -(-sum(map(input_bytes, (df, *more))) // EACH)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by the keys into as many partitions as the files under them need; as they are where the session's
    number of partitions is enough."""
    n = many_parts(df)
    return df.repartition(n, *keys) if n else df


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: it cuts the lineage, survives lost executors, and its
    columns can be read alone. The table goes when the session's JVM ends."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.parquet(folder)


def discard(table: DataFrame) -> None:
    """Remove the files of a table that ``written`` made, once nothing reads it any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files, broadcasts and checkpoints of tables that nothing refers to any more. It does so
    when the driver's garbage is collected, which an idle driver puts off while they fill disks and its own memory; for
    use between the rounds of a long job."""
    gc.collect()
    spark._jvm.System.gc()
