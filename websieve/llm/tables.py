"""Shared plumbing: stage tables on the cluster's shared folder, Arrow batches, driver-size checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SCRATCH: dict[str, str] = {}
BATCH_BYTES = 8 << 20


def scratch(spark: SparkSession) -> str:
    """A folder of this application's own below spark.checkpoint.dir.

    Where the setting is missing, a local master gets a temporary folder; a cluster has no
    folder that all executors share by default, so there it is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='websieve-')}"
        _SCRATCH[app] = f"{base.rstrip('/')}/websieve-{uuid.uuid4().hex}"
        atexit.register(discard, spark, _SCRATCH[app])
    return _SCRATCH[app]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder; at interpreter exit the JVM may already be gone."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001
        pass


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{scratch(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Later passes then start from files that outlive lost executors instead of recomputing.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches small enough that many very long texts never meet in memory.

    Spark reads the bound from the session when the plan runs, so it is lowered there for good,
    but only from Spark's default; a bound that somebody has set stays.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB") in ("67108864", "64m"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def keyed(docs: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """Only the columns an operator reads, so that extra columns of any name can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), *(F.col(c).alias(c2) for c, c2 in zip(text_cols, ("text", "text2"))))


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each value, empty for null, some at a time and without a detour over Python str."""
    for k in range(0, len(column), 256):
        yield from (x or b"" for x in column.slice(k, 256).cast(pa.binary()).to_pylist())


def fresh_name(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has a column that is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def left_join(rows: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """A left join whose rows with a null key spread over all tasks instead of meeting in one.

    Both sides grow with the input, so it is a sort-merge join at every size.
    """
    extra, null = fresh_name(rows, "spread"), F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    apart = F.when(null, F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    return rows.withColumn(extra, apart).join(right.withColumn(extra, F.lit(0).cast("long")).hint("merge"), [*keys, extra], "left").drop(extra)


def one_of_each(rows: DataFrame, key: str, again: DataFrame) -> DataFrame:
    """rows with one of those that share a key listed in ``again`` (its one column, not null); the others stay as they are."""
    if again.isEmpty():
        return rows
    name = fresh_name(rows, "again")
    again = staged(again.toDF(name), "again")
    same = F.col(key) == F.col(name)
    once = rows.join(again, same, "left_semi").groupBy(key).agg(F.first(F.struct(*(F.col(c) for c in rows.columns))).alias(name)).select(f"{name}.*")
    return rows.join(again, same, "left_anti").unionByName(once)


def partitions_for(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def thinned(rows: DataFrame, n: int) -> DataFrame:
    """About n of the rows, all if there are fewer, for the driver: those with the least hash of
    doc_id. The hash is compared with a bound, so no task sends more than its share. Rows are
    in the hash's order, which doesn't depend on how the table is dealt out."""
    share = min(1.0, n / max(1, rows.count()))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    return rows.withColumn("_draw", draw).where(F.col("_draw") < int(share * (1 << 40))).orderBy("_draw", "doc_id").drop("_draw", "doc_id")


def open_path(uri: str):
    """(file system, path) of a URI, on the driver or in a task."""
    return pa.fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> str:
    fs, path = open_path(uri)
    fs.create_dir(path, recursive=True)
    return uri


def attempt_name(tag: str) -> str:
    """A file name that no other attempt of this task uses; readers go by the manifest."""
    context = TaskContext.get()
    return f"{tag}-{context.partitionId():06d}-{uuid.uuid4().hex[:10]}"
