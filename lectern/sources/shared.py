"""Written tables in the folder that all executors share, and those of a corpus that many queries read, built once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

_BUILT: dict[tuple, tuple[str, DataFrame]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a local master gets a temporary one (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        place = spark.sparkContext.getCheckpointDir()
    return place.rstrip("/")


def _path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}"


#: Where it is there (Spark 4.1), the files of a query's shuffles go as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(writer: DataFrameWriter, spark: SparkSession, path: str) -> None:
    """Writes Parquet and leaves no shuffle files behind: a written table isn't computed again, so nothing reads them."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: the lineage ends there. `by` names columns that files are parted by."""
    spark = df.sparkSession
    path = _path(spark)
    _write(df.write.partitionBy(*by), spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> set[str]:
    """Those of the written() tables that df reads."""
    return {f[: f.index("/", f.index("/lectern-") + 1)] for f in df.inputFiles() if "/lectern-" in f}


def together(*tables: DataFrame) -> DataFrame:
    """The rows of written() tables of one schema, by a single scan however many they are."""
    first = tables[0]
    return first.sparkSession.read.schema(first.schema).parquet(*sorted(set().union(*map(_folders, tables))))


def discard(*tables: DataFrame) -> None:
    """Deletes the files of written() tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in _folders(df):
            if "/" not in path.rpartition("/lectern-")[2]:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def version(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> int:
    """A hash of the files of some tables: their paths, sizes and times."""
    files = spark.read.format("binaryFile").load([f"{sf_dir}/{n}.parquet" for n in names]).select("path", "modificationTime", "length")
    return files.agg(F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")).alias("v")).first()["v"]


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], sort: str | None = None, of: tuple[str, ...] = ("documents",), kept: bool = False) -> DataFrame:
    """The table `name` of a corpus: built at its first use in an application, and again when the tables `of` which it is made change.

    With `kept` build() gives the rows of written() tables, which stay as they are. With `sort` it is dealt by ranges of that column and sorted, so that filters on it read few row groups.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name, version(spark, sf_dir, of))
    if key in _BUILT and _there(spark, _BUILT[key][0]):
        return _BUILT[key][1]
    df = build()
    if kept and (folders := _folders(df)):
        _BUILT[key] = (min(folders), df)
        return df
    path = _path(spark)
    _write((df if sort is None else df.repartitionByRange(sort).sortWithinPartitions(sort)).write, spark, path)
    _BUILT[key] = (path, spark.read.schema(df.schema).parquet(path))
    return _BUILT[key][1]
