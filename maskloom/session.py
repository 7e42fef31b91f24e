"""Session settings and the lineage cut used between stages."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "maskloom") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it.

    Only a local session without the setting gets a temporary folder.
    """
    set_dir = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_SETTING
    )
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    return _local_folder(spark.sparkContext.applicationId)


@functools.cache
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix=f"maskloom-{application_id}-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back from there.

    Used where a costly result feeds several branches of a plan.  A table rather
    than a checkpoint, because each branch then reads only its own columns.
    """
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def join_hashed(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi join whose sides are sorted by a hash of the key first: a number that settles nearly every comparison.

    The sides merge, because the files of a cut are small and compressed: by their size one would be broadcast.
    """
    key = F.xxhash64(*[F.col(c).cast(left.schema[c].dataType) for c in on]).alias("__key")
    return left.select("*", key).join(right.select("*", key).hint("merge"), ["__key", *on], how).drop("__key")


def spread(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Deal rows out anew where the input has fewer splits than there are cores.

    A file of one row group is one task however many cores wait.  A large input
    has more splits than cores and is left alone, unless ``rows_per_task`` is given: a split of short rows
    that are made into long work holds too many of them, so these are counted (from the files'
    footers) and a task gets no more than that.
    """
    wanted = tasks_for(df, rows_per_task)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def tasks_for(df: DataFrame, rows_per_task: int | None = None) -> int:
    """As many tasks as there are cores, or as it takes that none has more than ``rows_per_task``."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-df.count() // rows_per_task)) if rows_per_task else cores
