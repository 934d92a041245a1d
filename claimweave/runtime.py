"""Session helpers: shared folder, written intermediate tables, shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a checked side is broadcast.
BROADCAST_ROWS = 200_000
#: A key that more rows carry is joined by broadcasting its one row, see keyed_join.
HOT_KEY = 100_000
#: Hot keys there are at most.
HOT_KEYS = 100_000

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_STASHED: set[str] = set()


def session(app: str = "claimweave", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested with; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only on a local master, where that is unset (tests), a temporary one is made.

    On a cluster an unset folder is an error: each executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not re.match(r"local(\[[^\]]*\])?$", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on master {master}")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        path = tempfile.mkdtemp(prefix="claimweave-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
        _LOCAL_DIRS[app] = path
    return "file://" + _LOCAL_DIRS[app]


def work_dir(spark: SparkSession) -> str:
    """This application's folder within the shared one; removed when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _STASHED:
        _STASHED.add(app)
        atexit.register(_clean, spark)
    return f"{shared_dir(spark)}/claimweave-{app}"


def stash(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and outlives any executor. by: columns that get folders."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clean(spark: SparkSession) -> None:
    try:
        drop_stashes(spark)
    except Exception:  # the session is gone; the folder is the cluster's to clean
        pass


def drop_stashes(spark: SparkSession) -> None:
    """Remove every intermediate table this application wrote."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/claimweave-{spark.sparkContext.applicationId}")
    path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="claimweave-zip-"), "claimweave_pkg.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("claimweave", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(out)
    atexit.register(shutil.rmtree, os.path.dirname(out), ignore_errors=True)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no further than one row past the bound."""
    return df.limit(rows + 1).count() <= rows


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast where its rows were counted to be few; unmarked otherwise."""
    return F.broadcast(df) if small_enough(df, rows) else df


def keyed_join(rows: DataFrame, dim: DataFrame, key: str | list[str], how: str = "inner", n: str = "n", hot: int = HOT_KEY) -> DataFrame:
    """rows joined (inner or left) with dim, which has one row per key and in column n how many of rows carry it.

    A key with more than hot rows would meet in one task. There are few such keys (the bar rises with the rows, so that there
    are at most HOT_KEYS), so their rows of dim are broadcast, and only the others are shuffled. dim is read more than once:
    give a written table. For a left join dim has to hold every key that many rows carry.
    """
    keys = [key] if isinstance(key, str) else key
    total, most = dim.agg(F.sum(n), F.max(n)).first()
    bar = max(hot, (total or 0) // HOT_KEYS)
    if (most or 0) <= bar:
        return rows.join(dim.drop(n), keys, how)
    few = dim.where(F.col(n) > bar).drop(n)
    top = rows.join(F.broadcast(few), keys)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(dim.where(F.col(n) <= bar).drop(n), keys, how)
    return top.unionByName(rest)


def spread_join(rows: DataFrame, dim: DataFrame, key: str | list[str], at_most: int, label: str, how: str = "inner", n: str = "n") -> DataFrame:
    """keyed_join where at_most, the number of rows, allows a hot key at all; a plain join where it does not."""
    return rows.join(dim.drop(n), key, how) if at_most <= HOT_KEY else keyed_join(rows, stash(dim, label), key, how, n)
