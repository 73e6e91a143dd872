"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: The folder of an application whose spark.checkpoint.dir is unset; Spark does not let it be set later.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, for local masters only, one folder of this machine for the application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="arbelo-")
        folder = _OWN[app]
    return folder.rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over all cores at least: rows that are few but dear would else stay in the one task that read them or was coalesced for them."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def dealt(df: DataFrame) -> DataFrame:
    """df, spread if fewer tasks read it than there are cores; what many tasks read is not shuffled."""
    return spread(df) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends here, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/arbelo/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def materialize_parts(spark: SparkSession, parts: list[Callable[[], DataFrame]], name: str, side_by_side: bool = True) -> DataFrame:
    """The union of tables of one schema, each made and written by itself, as one table: no plan holds them all, and if not side_by_side the driver holds one plan at a time."""
    steps = [lambda part=part: materialize(part(), name) for part in parts]
    made = together(spark, *steps) if side_by_side else [step() for step in steps]
    return spark.read.schema(made[0].schema).parquet(*[m.written_to for m in made])


def together(spark: SparkSession, *steps: Callable[[], object]) -> list:
    """What the steps return, in their order; their plans are made and their jobs run side by side, as a small job leaves most cores idle."""
    target = inheritable_thread_target(spark)  # the caller's job tags and properties hold in each thread
    with ThreadPoolExecutor(len(steps)) as pool:
        return [done.result() for done in [pool.submit(target(step)) for step in steps]]


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
