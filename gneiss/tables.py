"""Where the tables of a data folder are, and small helpers that every operator uses."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the session's executors, which need not have it installed; Spark serves the archive from the driver."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        here = Path(__file__).resolve().parent
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{here.name}", "zip", here.parent, here.name))
        _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's ``spark.checkpoint.dir``, which all executors of a cluster reach.

    Where a session on one machine has none (tests), one is made; on a cluster a missing setting raises ValueError.
    """
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not given:
        set_dir = sc._jsc.sc().getCheckpointDir()
        given = set_dir.get() if set_dir.isDefined() else None
    if not given:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        given = sc._jsc.sc().getCheckpointDir().get()
    return given.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df``, written as a table in ``work_folder`` and read back, so that a lost executor costs no recomputation, only the columns used are read, and Spark knows its size.

    The table goes when the driver's file system closes.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/gneiss-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def blank_to_null(c: Column) -> Column:
    """NULL for text that is empty or only white space."""
    return F.when(F.regexp_replace(c, r"(?U)\s+", "") != "", c)
