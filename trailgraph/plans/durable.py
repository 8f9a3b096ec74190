"""Tables that outlive executors, and code that reaches them."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one where none is set and all run on one machine."""
    context = spark.sparkContext
    set_already = context._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or (set_already.get() if set_already.isDefined() else None)
    if where is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="trailgraph-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not set_already.isDefined():
        context.setCheckpointDir(where)
    return where


#: Rows that a task writes at least, where the caller knows how many there are.
ROWS_PER_TASK = 50_000


def stored(df: DataFrame, name: str, rows: int | None = None, even: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage is cut and a lost executor costs nothing.

    rows, an estimate, keeps small tables from being written by more tasks than they need. even: df is shuffled into parts of
    the session's advisory size first, so that a table much smaller than what it is made from is written in few files.
    """
    if even:
        df = df.hint("rebalance")
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_PER_TASK)
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))


def write(df: DataFrame, name: str) -> str:
    """Writes df as a table in the shared folder, under the path that it returns."""
    path = f"{shared_dir(df.sparkSession)}/{TABLES}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


#: Folder of the stored tables inside the shared folder.
TABLES = "tables"


def files_of(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def forget(spark: SparkSession) -> None:
    """Removes all stored tables of the shared folder, once no result is to be read from them any more."""
    for table in spark.catalog.listTables(pattern="trailgraph_*"):
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    files, where = files_of(spark, f"{shared_dir(spark)}/{TABLES}")
    files.delete(where, True)


def stored_once(spark: SparkSession, key: tuple[str, ...], inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """stored(make()), made once a session for a key, as long as the files of the paths `inputs` and the stored table stay."""
    found = []
    for path in inputs:
        files, where = files_of(spark, path)
        found += [f"{x.getPath()}:{x.getLen()}:{x.getModificationTime()}" for x in files.listStatus(where)]
    full = (spark.sparkContext.applicationId, shared_dir(spark), *key, *found)
    if full in _kept:
        path, schema = _kept[full]
        files, where = files_of(spark, path)
        if files.exists(where):
            return spark.read.schema(schema).parquet(path)
    out = make()
    path = write(out, key[-1])
    _kept[full] = path, out.schema
    return spark.read.schema(out.schema).parquet(path)


_kept: dict[tuple[str, ...], tuple] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that their Python workers can import it."""
    if spark.sparkContext.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        target = Path(tempfile.mkdtemp(prefix="trailgraph-code-")) / "trailgraph.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted((root / "trailgraph").rglob("*.py")):
                z.write(f, f.relative_to(root))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(spark.sparkContext.applicationId)


def running(df: DataFrame, order: list[str], sums: dict[str, str], prefix: str = "pos") -> DataFrame:
    """Adds pos, the 0-based place of each row in a total order, and the sums up to and including it: sums[new] = column.

    The rows are range-sorted over many partitions; each takes the totals of those before it from one row per partition, so
    no task sees all rows, unlike a window without keys.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    totals = ranged.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    names = ["n", *sums]
    totals = totals.select(F.col("__part").alias("__of"), *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in names])
    inside = Window.partitionBy("__part").orderBy(*order)
    both = ranged.join(F.broadcast(totals), F.col("__part") == F.col("__of"))
    both = both.withColumn(prefix, F.col("__n") + F.row_number().over(inside) - 1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    for k, c in sums.items():
        both = both.withColumn(k, F.col(f"__{k}") + F.sum(c).over(upto))
    return both.select(*df.columns, prefix, *sums)
