"""Session settings and stage materialisation."""

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app_name: str = "fallline", cores: str | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for written stages: the one the cluster names in ``spark.checkpoint.dir``.

    Where it names none, a session within one machine gets a temporary folder, which is deleted at
    its end; on a cluster, whose machines share no such folder, that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="fallline-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_table_path(spark: SparkSession, name: str) -> str:
    """Path for a table in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a stage to the shared folder as Parquet and go on from the written copy.

    Used where a stage feeds several branches, each of which then reads its own columns alone, or
    where a partition number must not change between two reads. The copy outlives a lost executor.
    """
    path = new_table_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """A stage like :func:`materialize` in buckets by ``key``.

    Windows and aggregates whose groups contain ``key`` read the copy without an exchange. The bucket rule is
    part of the table's entry in the catalog, which is taken out again once the plan holds it; the files stay.
    """
    spark = df.sparkSession
    name = f"stage_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(buckets, key)
    writer.option("path", new_table_path(spark, "buckets")).saveAsTable(name)
    stage = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return stage
