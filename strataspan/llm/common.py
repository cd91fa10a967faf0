"""What the operators share: tables, the shared folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured bytes are below this; beyond, the join shuffles.
BROADCAST_BYTES = 48 << 20

_own_dirs: dict[str, str] = {}


#: Rows are whole texts: batches that cross to Python hold at most so many.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. Arrow batches of this session are held to ARROW_ROWS rows from here on."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may go without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = path = tempfile.mkdtemp(prefix="strataspan-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + _own_dirs[sc.applicationId]


#: Shuffle files of a materialised plan go when it is written: nothing reads them again.
CLEANUP = "spark.sql.shuffleDependency.fileCleanup.enabled"


def _write(writer, spark: SparkSession, path: str) -> None:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, what: str, codec: str = "snappy") -> DataFrame:
    """Write a DataFrame as Parquet in the shared folder and read it back: it is computed once, and a lost
    executor costs no recomputation of what stands before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _write(df.write.option("compression", codec), spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_scratch"] = path
    return out


def materialise_kinds(df: DataFrame, what: str, column: str, kinds: tuple[int, ...], codec: str = "snappy") -> list[DataFrame]:
    """Materialise the rows of each kind (a value of an integer column) apart, so each can be discarded by itself; the column is left out."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _write(df.write.partitionBy(column).option("compression", codec), spark, path)
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    schema, out = df.drop(column).schema, []
    for kind in kinds:
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={kind}")
        place.getFileSystem(conf).mkdirs(place)  # no rows of this kind, no folder
        found = spark.read.schema(schema).parquet(f"{path}/{column}={kind}")
        found.__dict__["_scratch"] = f"{path}/{column}={kind}"
        out.append(found)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised DataFrames that nothing will read again."""
    for df in frames:
        path = df.__dict__.pop("_scratch")
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def small(df: DataFrame, size: object = 16) -> bool:
    """True if the rows of a materialised DataFrame, `size` bytes each (a number or a column), fit a broadcast."""
    each = F.lit(size) if isinstance(size, int) else size
    total = df.agg(F.sum(each)).first()[0]
    return (total or 0) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, size: object = 16) -> DataFrame:
    """Marks a materialised side for broadcast if its measured size allows it; else Spark shuffles."""
    return F.broadcast(df) if small(df, size) else df.hint("shuffle_merge")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
